"""Packing token pieces into fixed sequences by cutting-stock column generation.

Whole documents are laid into sequences by patterns: multisets of piece lengths whose sum
needs no padding, the sequence's size or a power of two below it. How often each pattern is
used is a linear program over the histogram of piece lengths, of at most `size` rows
whatever the number of documents. It starts from patterns built longest piece first; new
columns are priced by a bounded knapsack over the duals, and enter by simplex pivots, until
none is worth its sequence or what the program leaves out is within `gap`. Rounded down,
the patterns take pieces by rank. What rounding leaves is laid out end to end and cut where
a sequence ends, its last tokens into powers of two, so no sequence is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm import packing
from voxtally.llm.common import settle

SIZE = 2048
CLOSING = 1
GAP = 0.0005
ROUNDS = 200
MOST_BROADCAST = 20_000
HELD = 1 << 22  # bytes of ids that a task holds before it sends them on
EPSILON = 1e-7


class Pattern(NamedTuple):
    """Pieces of these lengths, so many of each, that fill a sequence without padding."""

    lengths: np.ndarray
    copies: np.ndarray

    @property
    def total(self) -> int:
        return int(self.lengths @ self.copies)


def unpadded(size: int) -> np.ndarray:
    """The totals that need no padding: `size` and the powers of two below it."""
    return np.array(sorted({size, *(1 << k for k in range(size.bit_length()) if 1 << k < size)}))


def _pattern(pieces: list[int]) -> Pattern:
    return Pattern(*np.unique(np.array(pieces), return_counts=True))


def complete(left: np.ndarray, seed: int, size: int, tries: int = 40) -> Pattern | None:
    """A pattern of total `size` around a piece of length `seed`, from the pieces that are left.

    The gap is closed by one piece, by two, or by the longest that leave a gap which two
    close; where none of `tries` does, the longest goes in and the search goes on.
    """
    left = left.copy()
    left[seed] -= 1
    pieces, room = [seed], size - seed

    def pair(room: int) -> list[int] | None:
        lengths = np.flatnonzero(left[: room + 1] >= 1)
        other = room - lengths
        good = (left[other] >= 1) & ((other != lengths) | (left[lengths] >= 2))
        at = np.flatnonzero(good)
        return [int(lengths[at[-1]]), int(other[at[-1]])] if len(at) else None

    while room:
        lengths = np.flatnonzero(left[: room + 1] >= 1)
        if not len(lengths):
            return None
        if lengths[-1] == room:
            return _pattern([*pieces, room])
        if found := pair(room):
            return _pattern([*pieces, *found])
        for length in lengths[::-1][:tries].tolist():
            left[length] -= 1
            found = pair(room - length)
            left[length] += 1
            if found:
                return _pattern([*pieces, length, *found])
        longest = int(lengths[-1])
        left[longest] -= 1
        pieces.append(longest)
        room -= longest
    return _pattern(pieces)


def longest_first(counts: np.ndarray, size: int, whole: bool) -> tuple[list[tuple[Pattern, float, int]], np.ndarray]:
    """(pattern, uses, the length it runs out) of patterns that use up lengths from the longest on, and what is left.

    `whole` uses are integers. Otherwise every pattern is used until a length is gone, and
    lengths are gone in the order of the patterns, so their columns form a triangular basis.
    """
    left = counts.astype(np.float64)
    stuck = np.zeros(len(left), dtype=bool)
    out: list[tuple[Pattern, float, int]] = []
    while True:
        seeds = np.flatnonzero((left >= 1) & ~stuck if whole else (left > EPSILON) & ~stuck)
        if not len(seeds):
            return out, left
        # the linear program may use a length that is nearly gone as if it were whole
        stock = left if whole else np.where(left > EPSILON, counts, 0)
        found = complete(stock, int(seeds[-1]), size)
        if found is None:
            stuck[seeds[-1]] = True
            continue
        share = left[found.lengths] / found.copies
        at = int(np.argmin(share))
        uses = float(np.floor(share[at] + EPSILON)) if whole else float(share[at])
        left[found.lengths] -= uses * found.copies
        if not whole:
            left[found.lengths[at]] = 0
            left[left < EPSILON] = 0
        out.append((found, uses, int(found.lengths[at])))


def cheapest_fill(prices: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """The least price of pieces that fill each total exactly, and the choices behind it.

    A length is used no more often than there are pieces of it: its copies are items of
    1, 2, 4, ... pieces, each taken once at most.
    """
    items: list[tuple[int, int]] = []
    for length in np.flatnonzero(counts > 0).tolist():
        rest, step = min(int(counts[length]), size // length), 1
        while rest:
            n = min(step, rest)
            items.append((length, n))
            rest -= n
            step *= 2
    best = np.full(size + 1, np.inf)
    best[0] = 0
    taken = np.zeros((len(items), size + 1), dtype=bool)
    for k, (length, n) in enumerate(items):
        weight = length * n
        with_it = best[: size + 1 - weight] + n * prices[length]
        better = with_it < best[weight:]
        taken[k, weight:] = better
        best[weight:] = np.where(better, with_it, best[weight:])
    return best, items, taken


def cheapest_pattern(prices: np.ndarray, counts: np.ndarray, size: int) -> tuple[Pattern, float] | None:
    """The unpadded pattern of largest profit: its tokens, less one for the sequence, less its pieces' prices."""
    best, items, taken = cheapest_fill(prices, counts, size)
    totals = unpadded(size)
    profit = totals - 1 - best[totals]
    at = int(np.argmax(profit))
    if not np.isfinite(profit[at]):
        return None
    room, pieces = int(totals[at]), []
    for k in range(len(items) - 1, -1, -1):
        if taken[k, room]:
            length, n = items[k]
            pieces += [length] * n
            room -= length * n
    return _pattern(pieces), float(profit[at])


def column_generation(counts: np.ndarray, size: int, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[Pattern, float]]:
    """Patterns and how often to use them, so that as many tokens as can be are in unpadded patterns.

    Maximises the sum of (total - 1) * uses, where no length is used more often than it has
    pieces. The basis starts triangular, and its inverse follows each pivot.
    """
    lengths = np.flatnonzero(counts > 0)
    if not len(lengths):
        return []
    m = len(lengths)
    row = np.zeros(len(counts), dtype=np.int64)
    row[lengths] = np.arange(m)
    amount = counts[lengths].astype(np.float64)
    start, _ = longest_first(counts, size, whole=False)
    basis: list[Pattern | None] = [None] * m  # what stands in each row; None: pieces of that length left over
    matrix = np.eye(m)
    for pattern, _, gone in start:
        basis[row[gone]] = pattern
        matrix[:, row[gone]] = 0
        matrix[row[pattern.lengths], row[gone]] = pattern.copies
    inverse = np.linalg.inv(matrix)
    del matrix
    profit = np.array([p.total - 1 if p else 0.0 for p in basis])
    uses = np.maximum(inverse @ amount, 0)
    duals = profit @ inverse
    bound = float(amount @ lengths) * (size - 1) / size
    for _ in range(rounds):
        if profit @ uses >= (1 - gap) * bound:
            break
        prices = np.zeros(size + 1)
        prices[lengths] = duals
        found = cheapest_pattern(prices, counts, size)
        pattern, worth = found if found else (None, 0.0)
        short = int(np.argmin(duals))  # a price below zero: better to leave such pieces over
        if worth <= 1e-6 and duals[short] >= -1e-6:
            break
        if pattern is None or -duals[short] > worth:
            pattern, gain = None, 0.0
            column = inverse[:, short].copy()
            reduced = -duals[short]
        else:
            gain, reduced = pattern.total - 1.0, worth
            column = inverse[:, row[pattern.lengths]] @ pattern.copies
        falls = np.flatnonzero(column > 1e-9)
        if not len(falls):
            break
        step = uses[falls] / column[falls]
        out = int(falls[np.lexsort((-column[falls], step))[0]])
        amount_in = uses[out] / column[out]
        uses -= amount_in * column
        uses[out] = amount_in
        np.maximum(uses, 0, out=uses)
        line = inverse[out] / column[out]
        duals = duals + reduced * line
        column[out] -= 1
        touched, within = np.flatnonzero(np.abs(column) > 1e-12), np.flatnonzero(line)
        inverse[np.ix_(touched, within)] -= np.outer(column[touched], line[within])
        basis[out], profit[out] = pattern, gain
    return [(p, float(x)) for p, x in zip(basis, uses, strict=True) if p is not None and x > EPSILON]


class Layout(NamedTuple):
    """Where the pieces of each length go: by patterns up to a rank, then along a stream."""

    length: np.ndarray  # entries of pattern pieces, ordered by (length, first)
    first: np.ndarray  # the first rank
    per: np.ndarray  # pieces of that length in one sequence
    sequence: np.ndarray  # the first sequence
    offset: np.ndarray  # of the first such piece in a sequence
    streamed: np.ndarray  # by length: the first rank that goes along the stream
    stream: np.ndarray  # by length: where that rank begins in the stream
    cuts: np.ndarray  # the stream's last boundaries, after the whole sequences
    sequences: int  # of the patterns
    tokens: int  # of the stream


def lay_out(counts: dict[int, int], size: int = SIZE, gap: float = GAP, rounds: int = ROUNDS) -> Layout:
    """Solve for the histogram, round down, build more patterns from what is left, and stream the rest."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece has {length} ids; a sequence holds {size}")
        left[length] = n
    chosen = [(Pattern(np.array([size]), np.array([1])), int(left[size]))]
    left[size] = 0
    for pattern, uses in column_generation(left, size, gap, rounds):
        n = min(int(uses + EPSILON), int((left[pattern.lengths] // pattern.copies).min()))
        left[pattern.lengths] -= n * pattern.copies
        chosen.append((pattern, n))
    more, _ = longest_first(left, size, whole=True)
    for pattern, uses, _ in more:
        left[pattern.lengths] -= int(uses) * pattern.copies
        chosen.append((pattern, int(uses)))
    done = np.zeros(size + 1, dtype=np.int64)
    entries, sequences = [], 0
    for pattern, n in chosen:
        if not n:
            continue
        offset = 0
        for length, copies in zip(pattern.lengths.tolist()[::-1], pattern.copies.tolist()[::-1], strict=True):
            entries.append((length, int(done[length]), copies, sequences, offset))
            done[length] += n * copies
            offset += length * copies
        sequences += n
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    grid = np.arange(size + 1, dtype=np.int64)
    behind = np.cumsum((left * grid)[::-1])[::-1] - left * grid  # longer pieces come first
    tokens = int((left * grid).sum())
    rest = tokens % size
    powers = [1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]
    cuts = tokens - rest + np.cumsum([0, *powers], dtype=np.int64)
    return Layout(*table.T, done, behind, cuts, sequences, tokens)


def parts(length: np.ndarray, rank: np.ndarray, layout: Layout, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, length, sequence, offset) of the parts of pieces with these lengths and ranks among their length."""
    whole = np.flatnonzero(rank < layout.streamed[length])
    stride = int(max(rank.max(initial=0), layout.first.max(initial=0))) + 1
    at = np.searchsorted(layout.length * stride + layout.first, length[whole] * stride + rank[whole], side="right") - 1
    step = rank[whole] - layout.first[at]
    sequence = layout.sequence[at] + step // layout.per[at]
    offset = layout.offset[at] + step % layout.per[at] * length[whole]
    flowing = np.flatnonzero(rank >= layout.streamed[length])
    begin = layout.stream[length[flowing]] + (rank[flowing] - layout.streamed[length[flowing]]) * length[flowing]
    end = begin + length[flowing]
    full = layout.cuts[0]
    found = [(whole, np.zeros(len(whole), np.int64), length[whole], sequence, offset)]
    piece, low = flowing, begin
    while len(piece):  # a piece is at most `size` long, so it meets two whole sequences and the last few
        nth = np.searchsorted(layout.cuts, low, side="right") - 1
        tail = nth >= 0
        floor = np.where(tail, layout.cuts[np.maximum(nth, 0)], low // size * size)
        ceiling = np.where(tail, layout.cuts[np.minimum(nth + 1, len(layout.cuts) - 1)], floor + size)
        high = np.minimum(end, ceiling)
        where = layout.sequences + np.where(tail, full // size + nth, low // size)
        found.append((piece, low - begin, high - low, where, low - floor))
        more = high < end
        piece, low, begin, end = piece[more], high[more], begin[more], end[more]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, path: str) -> DataFrame:
    """(id, doc_tokens, start, length, ids_crc32, ids, key) of every document's ids and a closing id.

    A document longer than `size` is cut into pieces of that length after a shorter first
    one. `ids` are little-endian unsigned 32-bit ids, `key` tells stored rows apart.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "start", "length", "ids_crc32")), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            raw: list[bytes] = []
            held = 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                at, tokens, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), tokens, start, length, crc, pa.array(raw, pa.binary())], names=schema.names)

            for at, text in enumerate(batch.column(1)):
                ids = np.array([*packing.encode_text(text.as_py() or "", path), CLOSING], dtype="<u4")
                for start, n in packing.cut(len(ids), size):
                    raw.append(ids[start : start + n].tobytes())
                    rows.append((at, len(ids), start, n, zlib.crc32(raw[-1])))
                held += ids.nbytes
                if held > HELD:
                    yield flush()
                    rows, raw, held = [], [], 0
            if rows:
                yield flush()

    return docs.select(id_col, text_col).mapInArrow(encode, schema).withColumn("key", F.monotonically_increasing_id())


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None, gap: float = GAP, rounds: int = ROUNDS, with_ids: bool = False
) -> DataFrame:
    """Every document's pieces with their place in unpadded sequences.

    Returns the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    `with_ids` the piece's ids themselves. A null or empty text is the closing id alone;
    repeated rows are packed each on its own; an empty table stays empty; other columns of
    `docs` are not read. Texts of any length are packed whole. Only documents longer than
    `size` and those that rounding leaves are cut. `gap` is the share of the tokens at
    which the linear program may stop short of its bound, `rounds` its most pivots.
    """
    pieces = settle(token_pieces(docs, id_col, text_col, size, path or packing.vocabulary_path()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = lay_out(counts, size, gap, rounds)
    slim = pieces.select("length", "key", F.col(id_col).alias("id"), F.col("start").alias("begin"), "ids_crc32", "doc_tokens")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("begin", "skipped", "whole", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            length = column["length"].to_numpy(zero_copy_only=False)
            piece, skipped, n, sequence, offset = parts(length, column["rank"].to_numpy(zero_copy_only=False), layout, size)
            rows = batch.take(pa.array(piece))
            kept = dict(zip(rows.schema.names, rows.columns, strict=True))
            out = [kept["key"], kept["id"], kept["begin"], pa.array(skipped), kept["length"], pa.array(n), kept["ids_crc32"], kept["doc_tokens"], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    placed = packing.ranked(slim, counts, ["key"], "rank").mapInArrow(assign, schema)
    columns = [F.col("id").alias(id_col), (F.col("begin") + F.col("skipped")).alias("start"), "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        placed = placed.join(pieces.select("key", "ids"), "key")
        part = F.substring("ids", (4 * F.col("skipped") + 1).cast("int"), (4 * F.col("length")).cast("int"))
        return placed.select(*columns, part.alias("ids")).withColumn("ids_crc32", F.crc32("ids"))
    placed = settle(placed, "placed")
    cut = placed.where("length < whole")
    if -(-layout.tokens // size) + 12 <= MOST_BROADCAST:  # a boundary cuts one piece, so this bounds them
        cut = F.broadcast(cut)
    part = F.substring("ids", (4 * F.col("skipped") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    cut = pieces.select("key", "ids").join(cut, "key").withColumn("ids_crc32", F.crc32(part))
    return placed.where("length = whole").select(*columns).unionByName(cut.select(*columns))
