"""Nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Each block of the index posts
its vectors, by their place in that order, in an inverted file for each pivot. A query reads
the files of its own nearest pivots, only the places that differ less than `WINDOW` from its
own, ranks the block's vectors by the footrule distance of the two orders, in which larger
differences count as `WINDOW`, and compares its original vector with the best ranked.

Over all blocks about `POOL` times the square root of the number of rows are compared, so
the share of the rows that is compared falls as a table grows. Orders tell angles, and the
largest inner products are those of the smallest angles only among vectors of one length. So
blocks hold vectors of alike lengths, each gets a component that brings it to the length of
its block's longest, and longer blocks are given more of the pool.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import mix64, settle

PIVOTS = 384
POSTED = 64  # nearest pivots under which a vector is posted
READ = 64  # nearest pivots whose files a query reads
WINDOW = 48
POOL = 16.0
LONGER = 6  # a row's part of the pool goes with this power of its length
BLOCK = 8192
CELLS = 8  # blocks at least, so that lengths within one are alike
QUERIES = 4096
ROUNDING = 1e-9  # by which computed lengths are raised, so that a bound is never too small


def orders(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first; ties go to the first pivot.

    Nearness to a pivot is the inner product with the vector at length one.
    """
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.argsort(-((vectors / length) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)


def levelled(vectors: np.ndarray, square: float) -> np.ndarray:
    """The vectors with one more component, so that each has this squared length, the largest of all."""
    lacking = np.sqrt(np.maximum(square - (vectors * vectors).sum(1, keepdims=True), 0))
    return np.hstack([vectors, lacking])


class InvertedFiles:
    """One file a pivot: the rows of a block that have it among their nearest, by its place among these."""

    def __init__(self, found: np.ndarray, pivots: int) -> None:
        self.rows, self.posted = found.shape
        cell = found.astype(np.int64) * self.posted + np.arange(self.posted)
        order = np.argsort(cell, axis=None, kind="stable")
        self.posting = (order // self.posted).astype(np.int32)
        self.cuts = np.searchsorted(cell.ravel()[order], np.arange(pivots * self.posted + 1))

    def footrule(self, order: np.ndarray, window: int) -> np.ndarray:
        """Each row's distance from this order: the differences in place of its pivots, each at most `window`.

        A pivot that a row does not post counts as `window`; each posting within the window
        takes off what it is nearer.
        """
        rows, nearer = [], []
        for place, pivot in enumerate(order.tolist()):
            low, high = max(0, place - window + 1), min(self.posted, place + window)
            if low >= high:
                continue
            cuts = self.cuts[pivot * self.posted + low : pivot * self.posted + high + 1]
            rows.append(self.posting[cuts[0] : cuts[-1]])
            nearer.append(np.repeat(window - np.abs(np.arange(low, high) - place), np.diff(cuts)))
        if not rows:
            return np.full(self.rows, len(order) * window)
        return len(order) * window - np.bincount(np.concatenate(rows), np.concatenate(nearer), self.rows).astype(np.int64)


class Search(NamedTuple):
    """How an index is laid out and read."""

    k: int = 20
    pivots: int = PIVOTS
    posted: int = POSTED
    read: int = READ
    window: int = WINDOW
    pool: float = POOL
    exact: bool = False


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, how: Search, rows: int, weight: float, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's `k` best in a block.

    The block's part of the pool of a table of `rows` rows is its part of `weight`, the sum
    of all rows' lengths against the `longest` to the power LONGER. With `exact`, every row
    long enough for the score of the k-th is compared as well. Pivots are the block's vectors
    whose ids hash lowest. Ties in rank and in score go to the smaller id.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    length = np.sqrt((vectors * vectors).sum(1))
    level = levelled(vectors, float(length.max()) ** 2)
    drawn = np.argsort(mix64(ids.view(np.uint64) + np.uint64(1)), kind="stable")[: how.pivots]
    pivots = level[np.sort(drawn)]
    pivots = pivots / np.sqrt((pivots * pivots).sum(1, keepdims=True))
    files = InvertedFiles(orders(level, pivots, min(how.posted, len(pivots))), len(pivots))
    flat = np.hstack([queries, np.zeros((len(queries), 1))])
    share = ((length / longest) ** LONGER).sum() / weight
    most = min(len(ids), max(1, math.ceil(share * (how.pool * math.sqrt(rows) + how.k))))
    reach = length * (1 + ROUNDING)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, own, order in zip(queries, query_ids.tolist(), orders(flat, pivots, min(how.read, len(pivots))), strict=True):
        rank = files.footrule(order, how.window) * len(ids) + np.arange(len(ids))
        rank[ids == own] = np.iinfo(np.int64).max
        best = np.argpartition(rank, most - 1)[:most]
        best = np.sort(best[ids[best] != own])
        score = np.einsum("ij,j->i", vectors[best], query)
        if how.exact:
            kth = np.partition(score, len(score) - how.k)[len(score) - how.k] if len(score) >= how.k else -np.inf
            rest = reach * np.sqrt(query @ query) >= kth
            rest[best] = False
            rest &= ids != own
            more = np.flatnonzero(rest)
            best = np.concatenate([best, more])
            score = np.concatenate([score, np.einsum("ij,j->i", vectors[more], query)])
        top = np.lexsort((ids[best], -score))[: how.k]
        out.append((np.full(len(top), own), ids[best][top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def length_blocks(base: DataFrame, rows: int, block: int) -> DataFrame:
    """The rows with `at`, (cell, part) as one number: cells hold vectors of alike lengths, of about `block` rows.

    Cells are cut at quantiles of the squared length. Lengths that many rows share leave
    their cell large; it is dealt into parts by the hash of the id.
    """
    n = max(CELLS, -(-rows // block))
    cuts = [F.lit(k / n) for k in range(1, n)]
    bounds = base.agg(F.percentile_approx("square", F.array(*cuts), F.lit(20 * n)).alias("cuts")).first()["cuts"] if cuts else []
    cell = F.lit(0)
    if bounds:
        limits = F.array(*[F.lit(float(c)) for c in bounds])
        cell = F.size(F.filter(limits, lambda c: c < F.col("square")))
    celled = base.withColumn("cell", cell.cast("long"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))  # a row a cell
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))
    return celled.join(F.broadcast(sizes), "cell").withColumn("at", F.col("cell") * (1 << 32) + part).drop("cell", "parts")


def _packed(rows: DataFrame, block: str, kind: str) -> DataFrame:
    """Blocks of (id, vector) rows as one row each: the ids and the vectors as bytes, in numpy's `kind` of number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(vectors).astype(kind).tobytes()])], names=["block", "ids", "vectors"])

        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if current is not None and blocks[a] != current:
                    yield flush()
                    ids, vectors = [], []
                current = int(blocks[a])
                part = batch.slice(a, b - a)
                ids.append(part.column(1).to_numpy(zero_copy_only=False))
                vectors.append(part.column(2).flatten().to_numpy(zero_copy_only=False))
        if ids:
            yield flush()

    dealt = rows.select(F.col(block).alias("block"), "id", "vector").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "block long, ids binary, vectors binary")


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, block: int = BLOCK, query_block: int = QUERIES, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` vectors of largest inner product found for each query row.

    `settings` are those of `Search`; with `exact` the result is that of comparing every
    row, and otherwise its recall is what the pool reaches. Every valid vector is indexed, in
    blocks of about `block` rows; an index block goes to each block of queries. A query never
    finds rows of its own id. Rows whose id is null, or whose vector is null, zero, of another
    length than most, or holds a null or a number that is not finite, take no part. Rows that
    repeat an id and its vector count once; of an id with several vectors the largest counts,
    in the order of arrays. Equal scores go to the smaller id.
    """
    how = Search(**settings)
    single = vectors.schema[vector_col].dataType.simpleString() == queries.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"  # what is sent between tasks; all sums are in double precision
    valid = F.col("vector").isNotNull() & F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))") & F.expr("exists(vector, x -> x <> 0)")

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null").where(valid)
        square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
        return rows.groupBy("id").agg(F.max("vector").alias("vector")).withColumn("square", square).where("square > 0")

    base = settle(clean(vectors), "vectors")
    sizes = base.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("count"), F.max("square").alias("square")).orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    width, rows, longest = sizes["n"], sizes["count"], math.sqrt(sizes["square"])
    base = base.where(F.size("vector") == width)
    weight = base.agg(F.sum(F.pow(F.sqrt("square") / longest, F.lit(LONGER))).alias("w")).first()["w"]
    asked = clean(queries).where(F.size("vector") == width)
    n_query = max(1, -(-asked.count() // query_block))
    dealt = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_query)).cast("long")
    index = _packed(length_blocks(base, rows, block), "at", kind)
    ask = _packed(asked.withColumn("at", dealt), "at", kind)
    blocks = settle(index.withColumnRenamed("block", "i"), "blocks")
    names = sorted(r["i"] for r in blocks.select("i").collect())  # one number a block
    index = blocks.select("i", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("q"), F.lit(1).alias("kind"), "ids", "vectors")
    ask = ask.select(F.col("block").cast("int").alias("q"), F.lit(0).alias("kind"), "ids", "vectors").withColumn("i", F.explode(F.array(*[F.lit(i).cast("long") for i in names])))
    met = ask.select("i", "q", "kind", "ids", "vectors").unionByName(index).repartition("i", "q").sortWithinPartitions("i", "q", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                i, q, role = (batch.column(c)[row].as_py() for c in range(3))
                ids = np.frombuffer(batch.column(3)[row].as_py(), dtype="<i8")
                numbers = np.frombuffer(batch.column(4)[row].as_py(), dtype=kind).astype(np.float64).reshape(-1, width)
                if role == 0:
                    key, held = (i, q), (ids, numbers)
                elif key == (i, q):
                    found = search_block(ids, numbers, *held, how, rows, weight, longest)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(run, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")
