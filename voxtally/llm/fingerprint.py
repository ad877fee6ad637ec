"""Order-independent document fingerprints: a homomorphic hash of a multiset of paragraphs.

A fingerprint is the sum of a wide vector for each paragraph: `EQUAL` lanes modulo 2**64
hashed from the whole paragraph, and `NEAR` lanes modulo 2**16 to which each of its phrases
adds +1 or -1 in four lanes. Sums do not depend on order, and paragraphs can be added
to or taken from a fingerprint (`combine`). The first part tells texts apart; the second
keeps inner products, so it also tells how much two texts share. A phrase ends where a
word's hash says so, or after `LONGEST` words, so an edit changes only the phrases it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from voxtally.llm.common import mix64, powers, settle, text_chunks, words

EQUAL = 4
NEAR = 128
HANDS = 4
PHRASE = 3
LONGEST = 16
BYTES = EQUAL * 8 + NEAR * 2


def vectors(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text as a row of BYTES bytes, little-endian lanes.

    Paragraphs are what line feeds separate; each line feed counts too. A null text is
    empty and has the zero vector.
    """
    rows = [np.zeros((0, BYTES), np.uint8)]
    salts = mix64(np.arange(1, EQUAL + 1, dtype=np.uint64))
    for first, end, data, offsets in text_chunks(column):
        n = end - first
        whole, starts, _, bounds = words(data, offsets, lower=False, between=b"\n")
        owner = np.repeat(np.arange(n), np.diff(bounds))
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        equal = np.zeros((n, EQUAL), dtype=np.uint64)
        for lane in range(EQUAL):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(whole ^ salts[lane]))])
            equal[:, lane] = sums[bounds[1:]] - sums[bounds[:-1]]
            equal[:, lane] += np.diff(feeds[offsets]).astype(np.uint64) * salts[lane]
        hashes, starts, _, bounds = words(data, offsets, lower=False)
        near = np.zeros(n * NEAR, dtype=np.int64)
        if len(hashes):
            owner = np.repeat(np.arange(n), np.diff(bounds))
            opens = np.ones(len(hashes), dtype=bool)
            line = feeds[starts]
            opens[1:] = (hashes[:-1] % np.uint64(PHRASE) == 0) | (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(opens)
            place = (np.arange(len(hashes)) - np.repeat(at, np.diff([*at, len(hashes)]))) % LONGEST
            at = np.flatnonzero(place == 0)
            phrase = mix64(np.add.reduceat(hashes * powers(int(place.max()) + 1)[place], at))
            for hand in range(HANDS):
                bits = (phrase >> np.uint64(16 * hand)) & np.uint64(0xFFFF)
                lanes = owner[at] * NEAR + (bits % NEAR).astype(np.int64)
                near += np.bincount(lanes, weights=np.where(bits & np.uint64(0x8000), 1.0, -1.0), minlength=n * NEAR).astype(np.int64)
        rows.append(np.hstack([equal.astype("<u8").view(np.uint8), near.astype("<i2").reshape(n, NEAR).view(np.uint8)]))
    return np.concatenate(rows)


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprint after the paragraphs behind `b` are added (1) or taken away (-1)."""
    wide = a[..., : EQUAL * 8].copy().view("<u8")
    near = a[..., EQUAL * 8 :].copy().view("<i2")
    if sign > 0:
        wide, near = wide + b[..., : EQUAL * 8].copy().view("<u8"), near + b[..., EQUAL * 8 :].copy().view("<i2")
    else:
        wide, near = wide - b[..., : EQUAL * 8].copy().view("<u8"), near - b[..., EQUAL * 8 :].copy().view("<i2")
    return np.concatenate([wide.view(np.uint8), near.view(np.uint8)], axis=-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much each row of `a` shares with the same row of `b`: 0 to 1, and 1 if they are equal."""
    x = a[:, EQUAL * 8 :].copy().view("<i2").astype(np.float64)
    y = b[:, EQUAL * 8 :].copy().view("<i2").astype(np.float64)
    most = np.maximum((x * x).sum(1), (y * y).sum(1))
    shared = np.clip((x * y).sum(1) / np.maximum(most, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, shared)


def edit(text: str, following: str) -> str:
    """`text` whose last third gives way to as many first code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row, the fingerprint in lowercase hexadecimal; repeated rows repeat."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes().hex() for v in vectors(batch.column(1))], pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _compared(ids: pa.Array, texts: list[str], following: list[str]) -> list[pa.Array]:
    edited = [edit(a, b) for a, b in zip(texts, following, strict=True)]
    own, other, nxt = (vectors(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    return [
        ids,
        pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array([v.tobytes() for v in own], pa.binary()),
        pa.array([v.tobytes() for v in other], pa.binary()),
        pa.array(likeness(own, other), pa.float64()),
        pa.array(likeness(own, nxt), pa.float64()),
    ]


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document.

    The next document is the one with the next smaller id (nulls are last, equal ids in the
    order of their texts), after the last the first; a lone document is its own. Texts are
    dealt once, by ranges of the id. A range's last document waits for the first of the next
    range that has any; these few are joined afterwards. Null texts are empty.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    found = T.StructType([T.StructField(id_col, id_type), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    schema = T.StructType([*found.fields, T.StructField("__range", T.IntegerType()), T.StructField("__end", T.StringType()), T.StructField("__text", T.StringType())])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[pa.Array, str] | None = None

        def edge(ids: pa.Array, text: str, end: str) -> pa.RecordBatch:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([ids, *blank, pa.array([part], pa.int32()), pa.array([end]), pa.array([text], pa.string())], names=schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
                if held is None:
                    yield edge(ids.slice(0, 1), texts[0], "first")
                else:
                    ids, texts = pa.concat_arrays([held[0], ids]), [held[1], *texts]
                n = len(texts) - 1
                if n:
                    yield pa.RecordBatch.from_arrays([*_compared(ids.slice(0, n), texts[:n], texts[1:]), *[pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.string())]], names=schema.names)
                held = ids.slice(n, 1), texts[n]
        if held is not None:
            yield edge(held[0], held[1], "last")

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(id_col).desc_nulls_last()
    dealt = docs.select(id_col, text_col).repartitionByRange(n, key).sortWithinPartitions(key, text_col)
    stored = settle(dealt.mapInArrow(ranges, schema), "fingerprints")
    edges = stored.where("__end is not null")
    order = Window.orderBy("__range")
    follows = edges.where("__end = 'first'").select("__range").withColumn("__from", F.lag("__range").over(order))
    follows = follows.withColumn("__from", F.coalesce("__from", F.max("__range").over(Window.partitionBy())))
    heads = edges.where("__end = 'first'").select("__range", F.col("__text").alias("__next")).join(follows, "__range").select(F.col("__from").alias("__range"), "__next")
    tails = edges.where("__end = 'last'").select(id_col, "__range", "__text").join(heads, "__range").select(id_col, "__text", "__next")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(_compared(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()), names=found.names)

    every = stored.where("__end is null").select(*found.names).unionByName(tails.mapInArrow(join_ends, found))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
