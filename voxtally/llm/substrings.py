"""Removal of long passages that an earlier document holds, by a log-structured suffix index.

Every string of `LENGTH` bytes is filed under the smallest hash of the `SEED`-byte strings
in it, so that equal strings are always filed together; neighbouring strings mostly share
their smallest seed and travel as one stretch. A first pass over the seeds alone finds
those that occur more than once. Only stretches under such seeds go to the index.

The index of a bucket of seeds is a family of sorted suffix arrays. A new batch of
stretches gets its suffix array, cut at `LENGTH` bytes, is merge-scanned against each level
for equal strings, and joins as a new level; levels of like size are merged, so a bucket of n
strings has about log n of them. Of equal strings those of the smallest document stay,
in whatever order batches come.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from voxtally.llm.common import mix64, settle

LENGTH = 50
SEED = 20
CHUNK = 2 << 20
BATCH = 2 << 20
BUCKET = 3 << 20  # bytes of text for each bucket, so that what one holds does not grow with the input
TAG = 4
_CODEC = pa.Codec("zstd", compression_level=3)
LONGEST = 64
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_NULL_ID = np.iinfo(np.int64).max


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; `_unpack` needs their types."""
    sizes = np.array([a.nbytes for a in arrays], dtype="<i8").tobytes()
    return _zip(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw = _unzip(data)
    cuts = np.cumsum([8 * len(types), *np.frombuffer(raw, "<i8", len(types))])
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(cuts[:-1], cuts[1:], types, strict=True)]


def seeds(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For each byte the smallest seed hash of the string that starts there; all ones where none fits."""
    n = len(data)
    if n < length:
        return np.full(n, _LAST)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view("<u8").ravel()
    count = n - seed + 1
    hashes = np.zeros(count, dtype=np.uint64)
    for k, at in enumerate([*range(0, seed - 8, 8), seed - 8]):
        hashes = (hashes ^ (eight[at : at + count] + np.uint64(k))) * np.uint64(0x9FB21C651E98DF25)
        hashes ^= hashes >> np.uint64(32)
    hashes = mix64(hashes)
    width, span = length - seed + 1, 1
    while span * 2 <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    if width > span:
        hashes = np.minimum(hashes[: len(hashes) - (width - span)], hashes[width - span :])
    found = np.full(n, _LAST)
    found[: len(hashes)] = np.minimum(hashes, _LAST - np.uint64(1))
    for end in offsets[1:]:
        found[max(end - length + 1, 0) : end] = _LAST
    return found


def stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share a seed, of at most `LONGEST`: first start, number, scrambled seed."""
    n = len(found)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = found[1:] != found[:-1]
    at = np.flatnonzero(fresh)
    size = np.diff([*at, n])
    parts = np.where(found[at] == _LAST, 0, -(-size // LONGEST))
    first = np.repeat(at, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
    number = np.minimum(np.repeat(at + size, parts) - first, LONGEST)
    return first, number, mix64(found[first])


def _tags(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each seed in the upper bits, `TAG` other bytes of it in the lower."""
    return ((keys % np.uint64(buckets)) << np.uint64(8 * TAG)) | (keys >> np.uint64(64 - 8 * TAG))


class SuffixLevels:
    """The index of one bucket: levels of sorted strings with the documents that hold them first."""

    def __init__(self) -> None:
        self.levels: list[list[np.ndarray]] = []

    @staticmethod
    def _sorted(rows: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(rows[0], kind="stable")
        return [x[order] for x in rows]

    def add(self, strings: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """File a batch of strings; returns the places, new or old, that a smaller document covers.

        Of equal strings in the family those of the smallest document live, at all their places.
        """
        covered = []
        by_doc = np.argsort(docs, kind="stable")
        new = self._sorted([strings[by_doc], docs[by_doc], places[by_doc]])
        first = np.ones(len(new[0]), dtype=bool)
        first[1:] = new[0][1:] != new[0][:-1]
        least = new[1][np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        late = new[1] > least
        covered.append(new[2][late])
        new = [x[~late] for x in new]
        for k, level in enumerate(self.levels):
            both = np.concatenate([level[0], new[0]])
            order = np.argsort(both, kind="stable")
            row = both[order]
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = row[1:] != row[:-1]
            group = np.cumsum(fresh) - 1
            least = np.full(int(group[-1]) + 1 if len(group) else 0, _NULL_ID)
            doc = np.concatenate([level[1], new[1]])[order]
            np.minimum.at(least, group, doc)
            late = np.zeros(len(row), dtype=bool)
            late[order] = doc > least[group]
            n = len(level[0])
            covered += [level[2][late[:n]], new[2][late[n:]]]
            self.levels[k] = [x[~late[:n]] for x in level]
            new = [x[~late[n:]] for x in new]
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted([np.concatenate(pair) for pair in zip(before, last, strict=True)]))
        return np.concatenate(covered)


def _later(raw: bytes, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which of some strings a smaller document holds among them."""
    names: dict[bytes, int] = {}
    name = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    least = np.full(len(names), _NULL_ID)
    np.minimum.at(least, name, docs)
    return docs > least[name]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First numbers and lengths of the runs in some numbers."""
    places = np.unique(places)
    at = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1])) if len(places) else np.zeros(0, np.int64)
    return places[at], np.diff([*at, len(places)])


def covered_places(chunks: DataFrame, buckets: int, length: int, seed: int, batch: int) -> DataFrame:
    """(chunk, payload) rows: runs of starts in the chunk whose strings a smaller document holds."""
    def texts(row: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(_unpack(row, "<i8", "<i8", "u1"))

    def file_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for chunk, payload in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                _, offsets, data = texts(payload.as_py())
                _, _, keys = stretches(seeds(data, offsets, length, seed))
                tags, counts = np.unique(_tags(keys, buckets), return_counts=True)
                at = np.searchsorted(tags, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(8 * TAG))
                some = np.flatnonzero(np.diff(at))
                low = tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAG]
                packed = [low[at[b] : at[b + 1]].tobytes() + np.packbits(counts[at[b] : at[b + 1]] > 1).tobytes() for b in some]
                sizes = np.diff(at)[some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "chunk", "n", "tags"])

    def find_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which seeds of each chunk are held more than once in their bucket."""
        bucket, held = None, []

        def flush() -> pa.RecordBatch:
            sizes = [n for _, n, _ in held]
            raw = b"".join(t[: TAG * n] for _, n, t in held)
            tags = np.zeros((sum(sizes), 8), dtype=np.uint8)
            tags[:, :TAG] = np.frombuffer(raw, np.uint8).reshape(-1, TAG)
            tags = tags.view("<u8").ravel()
            order = np.argsort(tags, kind="stable")
            same = tags[order][1:] == tags[order][:-1]
            shared = np.zeros(len(tags), dtype=bool)
            shared[order[1:]] |= same
            shared[order[:-1]] |= same
            shared |= np.concatenate([np.unpackbits(np.frombuffer(t[TAG * n :], np.uint8), count=n).astype(bool) for _, n, t in held])
            bits = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in held], pa.int64()), pa.array([1] * len(held), pa.int32()), pa.array([bucket] * len(held), pa.int32()), pa.array(bits, pa.binary())], names=["chunk", "kind", "bucket", "payload"])

        for rows in batches:
            for b, c, n, t in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    if held:
                        yield flush()
                    bucket, held = b, []
                held.append((c, n, t))
        if held:
            yield flush()

    def send(payload: bytes, flags: dict[int, bytes], chunk: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, kind, payload) of a chunk's stretches under shared seeds; kind 1 is covered already."""
        ids, offsets, data = texts(payload)
        first, number, keys = stretches(seeds(data, offsets, length, seed))
        tags, inverse = np.unique(_tags(keys, buckets), return_inverse=True)
        at = np.searchsorted(tags, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(8 * TAG))
        shared = np.zeros(len(tags), dtype=bool)
        for b, bits in flags.items():
            shared[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=at[b + 1] - at[b])
        use = np.flatnonzero(shared[inverse])
        first, number, tag = first[use], number[use], inverse[use]
        doc = ids[np.searchsorted(offsets, first, side="right") - 1]
        raw = data.tobytes()
        ends = first + number + length - 1
        late = _later(raw, first, ends, doc)
        if late.any():
            yield chunk % buckets, 1, _pack(first[late].astype("<i4"), number[late].astype("<i4"))
        bucket = (tags[tag] >> np.uint64(8 * TAG)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[~late[order]]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                body = b"".join([raw[first[i] : ends[i]] for i in part.tolist()])
                yield int(bucket[part[0]]), 0, _pack(doc[part].astype("<i8"), first[part].astype("<i4"), number[part].astype("<i4"), np.frombuffer(body, np.uint8))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The seeds' flags of a chunk come before its texts."""
        current, flags = None, {}
        for rows in batches:
            for chunk, kind, bucket, payload in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
                if chunk != current:
                    current, flags = chunk, {}
                if kind == 1:
                    flags[bucket] = payload.as_py()
                    continue
                out = list(send(payload.as_py(), flags, chunk))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.int64()), pa.array([k for _, k, _ in out], pa.int32()), pa.array([p for _, _, p in out], pa.binary())], names=["bucket", "chunk", "kind", "payload"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "payload"]
        bucket, held, size, levels = None, [], 0, SuffixLevels()

        def file() -> pa.RecordBatch:
            """A batch: of equal stretches only those of the smallest document get their suffixes sorted."""
            parts = [_unpack(payload, "<i8", "<i4", "<i4", "u1") for _, payload in held]
            doc = np.concatenate([x[0] for x in parts])
            number = np.concatenate([x[2] for x in parts]).astype(np.int64)
            owner = len(chunks_seen) + np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            place = (owner << 40) | np.concatenate([x[1] for x in parts]).astype(np.int64)
            body = np.concatenate([x[3] for x in parts])
            ends = np.cumsum(number + length - 1)
            lead = ends - (number + length - 1)
            late = _later(body.tobytes(), lead, ends, doc)
            early = np.flatnonzero(~late)
            step = np.arange(number[early].sum()) - np.repeat(np.cumsum(number[early]) - number[early], number[early])
            view = np.lib.stride_tricks.sliding_window_view(body, length)
            strings = np.ascontiguousarray(view[np.repeat(lead[early], number[early]) + step]).view(f"S{length}").ravel()
            found = levels.add(strings, np.repeat(doc[early], number[early]), np.repeat(place[early], number[early]) + step)
            gone = np.repeat(place[late], number[late]) + np.arange(number[late].sum()) - np.repeat(np.cumsum(number[late]) - number[late], number[late])
            covered = np.concatenate([found, gone])
            chunks_seen.extend(c for c, _ in held)
            covered.sort()
            owners = covered >> 40
            cuts = np.flatnonzero(np.diff(owners)) + 1
            out = [(chunks_seen[int(x[0] >> 40)], _pack(*(y.astype("<i4") for y in _runs(x & ((1 << 40) - 1))))) for x in np.split(covered, cuts) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], names=names)

        chunks_seen: list[int] = []
        for rows in batches:
            ready = []
            for b, chunk, kind, payload in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == 1:
                    ready.append((chunk, payload))
                    continue
                if b != bucket:
                    if held:
                        yield file()
                    bucket, held, size, levels, chunks_seen = b, [], 0, SuffixLevels(), []
                held.append((chunk, payload))
                size += int.from_bytes(payload[:8], "little")
                if size >= batch:
                    yield file()
                    held, size = [], 0
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in ready], pa.int64()), pa.array([p for _, p in ready], pa.binary())], names=names)
        if held:
            yield file()

    filed = chunks.select("chunk", "payload").mapInArrow(file_seeds, "bucket int, chunk long, n int, tags binary")
    flags = filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(find_shared, "chunk long, kind int, bucket int, payload binary")
    both = flags.unionByName(chunks.select("chunk", F.lit(2).alias("kind"), F.lit(-1).alias("bucket"), "payload"))
    chosen = both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(choose, "bucket int, chunk long, kind int, payload binary")
    return chosen.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(index, "chunk long, payload binary")


def make_chunks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Whole rows of `docs` in stored chunks of about `size` bytes of text: chunk, payload, rest.

    The payload holds the ids (a null is the largest), offsets and text bytes; the rest all
    columns as an Arrow stream, with whether the text is null in its place.
    """
    names = docs.columns
    at_id, at_text = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def chunk(table: pa.Table, blobs: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            ids = np.array([_NULL_ID if x is None else x for x in table.column(at_id).to_pylist()], dtype="<i8")
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).astype("<i8")
            payload = _pack(ids, offsets, np.frombuffer(b"".join(blobs), np.uint8))
            rest = table.set_column(at_text, text_col, table.column(at_text).is_null())
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([payload], pa.binary()), pa.array([_zip(sink.getvalue())], pa.binary())], names=["chunk", "payload", "rest"])

        held: list[pa.Table] = []
        blobs: list[bytes] = []
        total = 0
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(at_text).to_pylist()]
            start = 0
            for i, text in enumerate(texts):
                blobs.append(text)
                total += len(text)
                if total >= size:
                    held.append(pa.Table.from_batches([batch.slice(start, i + 1 - start)]))
                    yield chunk(pa.concat_tables(held), blobs)
                    held, blobs, total, start = [], [], 0, i + 1
            if start < batch.num_rows:
                held.append(pa.Table.from_batches([batch.slice(start)]))
        if blobs:
            yield chunk(pa.concat_tables(held), blobs)

    return settle(docs.mapInArrow(run, "chunk long, payload binary, rest binary"), "chunks")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, length: int = LENGTH, seed: int = SEED, chunk: int = CHUNK, batch: int = BATCH, bucket: int = BUCKET) -> DataFrame:
    """`docs` without the bytes of every `length`-byte string that a smaller id's text holds.

    Strings are judged on the input and never cross rows. With `report`, (id, n_bytes,
    n_removed, n_spans, kept_sha256) of every row instead; otherwise all columns, the text
    being what is left, where characters that lost some of their bytes go altogether. Ids are
    integers; a null one counts as larger than any, and rows of one id never cover each other.
    Null texts are empty, and stay null in the output texts. A column named n_bytes and so
    on in the input clashes with nothing: the report carries the id alone.
    """
    if report:
        docs = docs.select(id_col, text_col)
    chunks = make_chunks(docs, id_col, text_col, chunk)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, -(-chunks.count() * chunk // bucket))
    places = covered_places(chunks, buckets, length, seed, batch)
    at_text = docs.columns.index(text_col)
    id_field = docs.schema[id_col]
    reported = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    schema = reported if report else docs.schema

    def assemble(payload: bytes, rest: bytes, runs: list[bytes]) -> pa.Table:
        _, offsets, data = _unpack(payload, "<i8", "<i8", "u1")
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        for run in runs:
            first, number = _unpack(run, "<i4", "<i4")
            np.add.at(edge, first, 1)
            np.add.at(edge, first + number + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        table = pa.ipc.open_stream(_unzip(rest)).read_all()
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        kept = data[~gone].tobytes()
        left = offsets - total[offsets]
        texts = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        if not report:
            null = table.column(at_text).to_numpy()
            return table.set_column(at_text, text_col, pa.array([x.decode("utf-8", "ignore") for x in texts], pa.string(), mask=null))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begin = offsets[:-1][offsets[:-1] < len(data)]
        opens[begin] = gone[begin]
        spans = np.concatenate([[0], np.cumsum(opens)])
        return pa.table([table.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], names=reported.names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs = None, []
        for rows in batches:
            for c, kind, payload, rest in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), rows.column(3), strict=True):
                if c != current:
                    current, runs = c, []
                if kind == 1:
                    runs.append(payload.as_py())
                else:
                    yield from assemble(payload.as_py(), rest.as_py(), runs).to_batches()

    ends = places.select("chunk", F.lit(1).alias("kind"), "payload", F.lit(None).cast("binary").alias("rest"))
    both = ends.unionByName(chunks.select("chunk", F.lit(2).alias("kind"), "payload", "rest"))
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(finish, schema)
