"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set of word shingles is sketched in rounds: in each round every shingle is
thrown into one of `coordinates` bins, and an empty bin takes the smallest value that falls
into it; after as many rounds as there are bins, each further round offers all shingles to
one bin, so every coordinate is filled even for the smallest set. Sketches agree in a share
of their coordinates close to the sets' similarity. Documents of equal sets are one class;
classes whose sketches agree on a whole band are compared on their full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import mix64, powers, settle, text_chunks, words
from voxtally.llm.components import components

WIDTH = 5
BANDS = 48
ROWS = 8
PERCENT = 85
BLOCK = 256
FAN = 64
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: their sets of shingle hashes, joined, and the set sizes.

    Words are lower-cased (A-Z); a text of fewer than `width` words is one shingle, one
    without words has none. Each set is in order.
    """
    for first, end, data, offsets in text_chunks(column):
        hashes, _, _, bounds = words(data, offsets)
        n = end - first
        count = np.diff(bounds)
        size = np.where(count == 0, 0, np.minimum(count, width))
        each = np.maximum(count - size + 1, 0) * (count > 0)
        owner = np.repeat(np.arange(n), each)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + bounds[:-1][owner]
        value = np.zeros(len(owner), dtype=np.uint64)
        for k, power in enumerate(powers(width + 1)[1:]):
            inside = k < size[owner]
            value += np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] * power, np.uint64(0)) if len(hashes) else value
        value = mix64(value + size[owner].astype(np.uint64))
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        yield value[fresh], np.bincount(owner[fresh], minlength=n)


def sketches(values: np.ndarray, sizes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The sketch of each set, one row each; an empty set's row is all ones."""
    n, t = len(sizes), coordinates
    sketch = np.full(n * t, _NONE, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    empty = np.where(sizes > 0, t, 0)
    for turn in range(2 * t):
        if not len(values):
            break
        thrown = mix64(values ^ mix64(np.array([turn + 1], dtype=np.uint64)))
        bins = (thrown % np.uint64(t)).astype(np.int64) if turn < t else np.full(len(values), turn - t)
        at = owner * t + bins
        open_ = sketch[at] == _NONE
        at, thrown = at[open_], thrown[open_]
        order = np.argsort(thrown, kind="stable")[::-1]
        at, thrown = at[order], thrown[order]
        sketch[at] = np.minimum(mix64(thrown), _NONE - np.uint64(1))
        empty -= np.bincount(np.unique(at) // t, minlength=n)
        keep = empty[owner] > 0
        if not keep.all():
            values, owner = values[keep], owner[keep]
    return sketch.reshape(n, t)


def bands(sketch: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """A hash of each band of each sketch; equal bands of different places differ."""
    rows = sketch.reshape(len(sketch), n_bands, -1)
    power = powers(rows.shape[2] + 1)[1:]
    return mix64((rows * power).sum(axis=2, dtype=np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64))


def _digests(values: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The digest and the bytes of each set."""
    cuts = np.cumsum(sizes).tolist()
    raw = [values[b - n : b].tobytes() for b, n in zip(cuts, sizes.tolist(), strict=True)]
    return [hashlib.blake2b(x, digest_size=16).digest() for x in raw], raw


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, width: int, n_bands: int, rows: int) -> DataFrame:
    """(id, n, digest of the set, band hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, sizes in shingle_sets(batch.column(1), width):
                found = bands(sketches(values, sizes, n_bands * rows), n_bands).view(np.int64)
                digests, _ = _digests(values, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_bands), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["id", "n", "digest", "bands"])
                at += len(sizes)

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(digest, set) of the rows with these ids; the set is its hashes in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values, sizes in shingle_sets(batch.column(0), width):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in _digests(values, sizes)], names=["digest", "set"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(ids, "id", "left_semi").select("text").mapInArrow(run, "digest binary, set binary").dropDuplicates(["digest"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of two ordered sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int, fan: int = FAN) -> DataFrame:
    """The pairs (a, b), a a leader, whose full sets are similar.

    Each member's set is sent to its leader once. A leader's members are dealt over `fan`
    tasks, and its own set goes to each, so a leader with many members is not one task.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(fan)).cast("int")
    members = pairs.join(sets.withColumnRenamed("digest", "b"), "b").select("a", salt.alias("salt"), F.lit(1).alias("kind"), "b", "set")
    cells = pairs.select("a", salt.alias("salt")).distinct()
    leaders = cells.join(sets.withColumnRenamed("digest", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "set")
    dealt = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            kinds, raw = batch.column(2).to_pylist(), batch.column(4)
            keep = []
            for row, kind in enumerate(kinds):
                held = np.frombuffer(raw[row].as_py(), dtype=np.uint64)
                if kind == 0:
                    leader = held
                elif similar(leader, held, percent):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(3).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def link_forest(labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links enough to join all labels whose sets are similar, compared each with each.

    A row is passed by once every other row is in its tree or of an unfit size, so a block
    whose rows are all alike costs one comparison a row.
    """
    names, tree = np.unique(np.array(labels, dtype=object), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.zeros(len(shingles), dtype=np.int64)
    links = []
    for i in range(len(sets)):
        fit = (tree != tree[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not fit.any():
            continue
        own = code[starts[i] : starts[i] + sizes[i]]
        seen[own] = 1
        shared = np.add.reduceat(seen[code], starts)
        seen[own] = 0
        hit = fit & (100 * shared >= percent * (sizes + sizes[i] - shared))
        for other in np.unique(tree[hit]).tolist():
            links.append((names[tree[i]], names[other]))
            tree[tree == other] = tree[i]
    return links


def cross_links(rows: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components that share a bucket.

    `rows` are (bucket, digest, n, component). A bucket's rows are compared within cells of
    fitting set sizes, a cell of more than `block` rows in pairs of blocks. Every pair of
    rows of one bucket that sizes and components leave open meets in some task, and a task
    returns links that join trees only.
    """
    base = max(math.log(100 / percent), 1e-6) * 1.0001
    level = F.floor(F.log(F.col("n")) / base)
    spread = rows.withColumn("home", level).withColumn("cell", F.explode(F.array(F.col("home"), F.col("home") - 1))).withColumn("own", F.col("home") == F.col("cell"))
    cells = spread.groupBy("bucket", "cell").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("own").alias("owned")).where("owned and size > 1 and low <> high").select("bucket", "cell", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = spread.join(cells, ["bucket", "cell"]).withColumn("salt", F.pmod(F.xxhash64("digest"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", "cell", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "component", "digest").join(sets, "digest")
    keys = ["bucket", "cell", "i", "j"]
    dealt = dealt.select(*keys, "component", "set").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, labels, sets_ = None, [], []

        def flush() -> pa.RecordBatch:
            found = link_forest(labels, sets_, percent) if len(set(labels)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for *new, label, raw in zip(*columns, strict=True):
                if new != key:
                    if labels:
                        yield flush()
                    key, labels, sets_ = new, [], []
                labels.append(label)
                sets_.append(np.frombuffer(raw, dtype=np.uint64))
        if labels:
            yield flush()

    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Rows whose sets satisfy 100 * intersection >= percent * union are linked, and a
    component's id is the smallest id in it. Null and empty texts have no shingles and are
    linked with nothing. Rows of equal sets are one class, and repeated rows repeat. A null
    id is no smallest id: where a component has no other, its id is null and its rows stay.
    Two similar sets share no band with a chance under one in a million at the threshold,
    and less above it.
    """
    sketched = settle(sketch_documents(docs, id_col, text_col, width, n_bands, rows), "sketches")
    classes = settle(sketched.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    exploded = classes.select("digest", "n", F.explode("bands").alias("bucket"))
    shared = classes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    multi = settle(exploded.join(shared, "bucket"), "buckets")
    marks = multi.groupBy("bucket").agg(F.min(F.struct("digest", "n")).alias("leader"), F.first("size").alias("size"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    once = marks.groupBy("leader", "size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "leader")
    members = settle(multi.select("bucket", "digest", "n").join(once, "bucket"), "members")
    fits = 100 * F.least("n", F.col("leader.n")) >= percent * F.greatest("n", F.col("leader.n"))
    pairs = settle(members.where(fits).select(F.col("leader.digest").alias("a"), F.col("digest").alias("b")).where("a <> b").distinct(), "pairs")
    wanted = members.select("digest").distinct().join(classes, "digest").select("id")
    sets = settle(full_sets(docs, wanted, id_col, text_col, width), "sets")
    stars = components(star_links(pairs, sets, percent))
    labelled = members.select("bucket", "digest", "n").join(stars.withColumnRenamed("node", "digest"), "digest", "left").select("bucket", "digest", "n", F.coalesce("component", "digest").alias("component"))
    labelled = settle(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    across = components(cross_links(labelled.join(mixed, "bucket"), sets, percent))
    known = classes.select("digest", "id").join(stars.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "id", F.coalesce("component", "digest").alias("at"))
    known = known.join(across.select(F.col("node").alias("at"), F.col("component").alias("to")), "at", "left").select("digest", "id", F.coalesce("to", "at").alias("root"))
    known = settle(known, "roots")
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    named = known.join(least, "root").select("digest", "component_id")
    whole = sketched.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return whole.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: those whose id heads a component.

    Rows that repeat an id share its fate; an id with several texts goes if any of them goes.
    Rows with a null id stay.
    """
    gone = near_duplicates(docs, id_col, text_col, **settings).where(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")


def near_duplicates_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """`near_duplicates` of `documents` (doc_id, text), whose ids are unique, in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END AS s FROM words),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    each AS (SELECT doc_id, unnest(s) AS x FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= {percent} * (p.n + q.n - k)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.id WHERE r.root < w.b),
    least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT s.doc_id, s.n::BIGINT AS n_shingles, l.root AS component_id, s.doc_id = l.root AS kept FROM sizes s JOIN least l ON l.id = s.doc_id
    """
