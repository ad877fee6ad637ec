"""Best-two-fit packing of token pieces into sequences of a fixed length.

Which lengths go together depends only on how many pieces there are of each length, of
which there are at most `size`. So the packing is worked out once from that histogram as
a list of patterns, each used many times; every piece finds its place by its rank among
the pieces of its length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import settle

SIZE = 2048
CELL_ROWS = 50_000
VOCABULARY = "byte_bpe_50k.tiktoken"
# Runs of Unicode's White_Space long enough to be encoded on their own.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a rank file, for text without added tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[re.Pattern[str] | None, dict[str, int]]:
    """What finds the added tokens of a `tokenizers` file in a text, the longest first, and their ids."""
    with open(path, encoding="utf-8") as text:
        found = json.load(text)["added_tokens"]
    for token in found:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"the added token {token['content']!r} takes in or asks for what is around it")
    ids = {token["content"]: token["id"] for token in found}
    longest_first = sorted(ids, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if ids else None, ids


def plain_ids(text: str, bpe) -> list[int]:
    """The ids of a text without added tokens.

    The vocabulary's pattern takes a run of white space without its last character as one
    part, or the whole run at the end of a text, and no part crosses its ends. The pattern's
    own search goes back over a run once for every character, deeper than a stack allows in
    a very long one; so long runs are cut out and encoded as the parts they are.
    """
    out: list[int] = []
    done = 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        out.extend(bpe.encode_ordinary(text[done : run.start()]))
        out.extend(bpe._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        done = end
    out.extend(bpe.encode_ordinary(text[done:] if done else text))
    return out


def encode_text(text: str, path: str) -> list[int]:
    """The ids of a text by the rank file at `path` and the added tokens of the `tokenizers` file beside it.

    An added token is matched wherever its string stands, and the text between is encoded part by part.
    """
    bpe = encoder(path)
    pattern, added = added_tokens(str(Path(path).with_suffix(".json")))
    if pattern is None or not pattern.search(text):
        return plain_ids(text, bpe)
    out: list[int] = []
    for k, part in enumerate(pattern.split(text)):
        out.extend([added[part]] if k % 2 else plain_ids(part, bpe))
    return out


def cut(n_ids: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than `size`."""
    rest = n_ids % size
    starts = [0] * bool(rest) + list(range(rest, n_ids, size))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n_ids], strict=True)]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and a closing id 0.

    Ids are those of the `tokenizers` file of the same name as the rank file at `path`, its
    added tokens included. A null text is empty and gives the closing id alone.
    """
    path = path or vocabulary_path()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            piece: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode_text(text.as_py() or "", path), 0], dtype="<u4")
                for k, (a, n) in enumerate(cut(len(ids), size)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a : a + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


class Plan(NamedTuple):
    """Which ranks of a length go where; each entry covers `copies` sequences of one pattern."""

    length: np.ndarray  # of the pieces, the entries are ordered by (length, first)
    first: np.ndarray  # the first rank of that length
    per: np.ndarray  # pieces of that length in the pattern
    sequence: np.ndarray  # the pattern's first sequence
    offset: np.ndarray  # of the first such piece in a sequence
    sequences: int


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Pack pieces of the given length histogram.

    A sequence is filled greedily with the longest piece that still fits. If room is left,
    its shortest piece (not its only, longest one) gives way to the two unpacked pieces that
    fill the widened gap best, when they fill it better. The same choices come again until a
    length runs out, so a pattern is used as often as its lengths last: the number of
    patterns depends on `size`, not on the number of pieces.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= size:
            raise ValueError(f"a piece has {length} ids; a sequence holds {size}")
        left[length] = n
    grid = np.arange(size + 1)
    done = np.zeros(size + 1, dtype=np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def longest_within() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, grid, 0))

    fits = longest_within()
    while fits[size]:
        bin_: list[int] = []
        room = size

        def put(length: int) -> None:
            nonlocal room, fits
            bin_.append(length)
            room -= length
            left[length] -= 1
            if not left[length]:
                fits = longest_within()

        while room and fits[room]:
            put(int(fits[room]))
        if room and len(bin_) > 1:
            smallest = bin_[-1]
            gap = room + smallest
            one = np.flatnonzero(left[: gap + 1] > 0)
            two = fits[gap - one]
            alone = (two == one) & (left[one] < 2)
            if alone.any():
                shorter = fits[one[alone] - 1]
                two[alone] = np.minimum(shorter, gap - one[alone])
            total = np.where(two > 0, one + two, 0)
            if len(total) and total.max() > smallest:
                best = int(np.flatnonzero(total == total.max())[-1])
                bin_.pop()
                left[smallest] += 1
                room += smallest
                fits = longest_within()
                put(int(one[best]))
                put(int(two[best]))
        used, per = np.unique(bin_, return_counts=True)
        more = int((left[used] // per).min())
        copies = more + 1
        left[used] -= more * per
        if more:
            fits = longest_within()
        offset = 0
        for length, k in sorted(zip(used.tolist(), per.tolist(), strict=True), reverse=True):
            entries.append((length, int(done[length]), k, sequences, offset))
            done[length] += copies * k
            offset += length * k
        sequences += copies
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences)


def place(length: np.ndarray, rank: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks among their length."""
    stride = int(max(rank.max(initial=0), plan.first.max(initial=0))) + 1
    at = np.searchsorted(plan.length * stride + plan.first, length * stride + rank, side="right") - 1
    step = rank - plan.first[at]
    return plan.sequence[at] + step // plan.per[at], plan.offset[at] + step % plan.per[at] * length


def ranked(pieces: DataFrame, counts: dict[int, int], order: list[str], name: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`pieces`, a stored table, with each row's rank from 0 among the rows of its `length`, counted in `counts`.

    Ranks are counted in salted cells of about `cell_rows` rows, so a length that many pieces
    share is not one task. Rows alike in `order` are alike and may trade ranks.
    """
    salts = max(16, -(-max(counts.values(), default=0) // cell_rows))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    cells = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1
    joined = salted.withColumn("__inner", inner).join(cells, ["length", "__salt"])
    return joined.select(*pieces.columns, (F.col("__before") + F.col("__inner")).cast("long").alias(name))


def pack(pieces: DataFrame, size: int = SIZE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`pieces`, a stored table with a `length` from 1 to `size`, with `sequence_id` and `offset`.

    Rows of equal length are interchangeable, and find their place by their rank. An empty
    table stays empty. Columns of the input are kept; one of the two new names is replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_two_fit(histogram, size)
    order = [c for c in pieces.columns if c != "length"]
    places = ranked(pieces, histogram, order, "__rank", cell_rows)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = pieces.columns.index("length")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(batch.column(at).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), plan)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return places.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id; repeated rows are packed each on its own;
    a long text is cut, never dropped. Other columns of `docs` are not read.
    """
    return pack(settle(token_pieces(docs, id_col, text_col, size, path), "pieces"), size)
