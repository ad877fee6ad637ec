"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier of the words that a text holds is trained in numpy from texts that are
confirmed toxic and texts whose label is not known. The risk of calling unlabelled texts
toxic is corrected by the class prior, and where the corrected part falls below zero, which
only over-fitting can bring about, the step goes back up. The training sample is bounded by
`positives` and `unlabelled`; every row is scored, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.llm.common import text_chunks, words

POSITIVES = 4000
UNLABELLED = 12_000
FEATURES = 4096
BUCKETS = 1 << 22
BETWEEN = b" \t\n\v\f\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Classifier(NamedTuple):
    """Weights of the chosen word buckets, which are in order, and a bias."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of each text, in order, and how many each text has."""
    sets: list[np.ndarray] = []
    sizes: list[np.ndarray] = [np.zeros(0, np.int64)]
    for first, end, data, offsets in text_chunks(column):
        hashes, _, _, bounds = words(data, offsets, lower=True, between=BETWEEN)
        owner = np.repeat(np.arange(end - first), np.diff(bounds))
        pairs = np.unique(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
        sets.append(pairs % BUCKETS)
        sizes.append(np.bincount(pairs // BUCKETS, minlength=end - first))
    return np.concatenate([np.zeros(0, np.int64), *sets]), np.concatenate(sizes)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(buckets: np.ndarray, sizes: np.ndarray, positive: np.ndarray, prior: float, features: int = FEATURES, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Classifier:
    """Fit to word sets as `word_sets` gives them; `positive` marks the confirmed texts.

    The words kept are those whose share among confirmed texts is farthest above or below
    their share among the unlabelled, in standard errors. Without texts of either kind the
    classifier gives the prior.
    """
    n_pos, n_un = int(positive.sum()), int((~positive).sum())
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not n_pos or not n_un:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), base)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    vocabulary, column = np.unique(buckets, return_inverse=True)
    in_pos = np.bincount(column[positive[owner]], minlength=len(vocabulary))
    in_un = np.bincount(column[~positive[owner]], minlength=len(vocabulary))
    shared = (in_pos + in_un + 1) / (n_pos + n_un + 2)
    apart = (in_pos / n_pos - in_un / n_un) / np.sqrt(shared * (1 - shared) * (1 / n_pos + 1 / n_un))
    keep = np.sort(np.argsort(-np.abs(apart), kind="stable")[:features])
    keep = keep[np.abs(apart[keep]) >= 4]
    to = np.full(len(vocabulary), -1)
    to[keep] = np.arange(len(keep))
    held = to[column] >= 0
    owner, column = owner[held], to[column[held]]
    weights = np.zeros(len(keep) + 1)
    weights[-1] = base
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=weights[column], minlength=len(sizes)) + weights[-1]
        p = _logistic(z)
        loss_clean = np.logaddexp(0, z)
        clean_risk = loss_clean[~positive].mean() - prior * loss_clean[positive].mean()
        slope = np.where(positive, -prior * p / n_pos, p / n_un)
        if clean_risk >= 0:
            slope = slope + np.where(positive, prior * (p - 1) / n_pos, 0)
        else:
            slope = -slope
        gradient = np.append(np.bincount(column, weights=slope[owner], minlength=len(keep)), slope.sum())
        gradient[:-1] += decay * weights[:-1] / len(weights)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Classifier(vocabulary[keep], weights[:-1], float(weights[-1]))


def scores(column: pa.Array, classifier: Classifier) -> np.ndarray:
    """The probability of toxicity of each text; an empty or null text has the bias alone."""
    buckets, sizes = word_sets(column)
    at = np.searchsorted(classifier.buckets, buckets)
    at[at == len(classifier.buckets)] = 0
    value = np.zeros(len(buckets))
    if len(classifier.buckets):
        value = np.where(classifier.buckets[at] == buckets, classifier.weights[at], 0.0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return _logistic(np.bincount(owner, weights=value, minlength=len(sizes)) + classifier.bias)


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from training: crc-32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Train on rows that are not held out: at most so many confirmed toxic and unlabelled texts.

    The sample takes the ids that hash lowest. Null ids and null labels are left out; a
    document that is labelled twice is toxic if any of its rows says so. The prior is the
    share of toxic documents among all labelled ones that are not held out.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__id is not null and __label is not null").where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__label").alias("__label"))
    counts = known.agg(F.count("*").alias("n"), F.sum((F.col("__label") == 1).cast("long")).alias("toxic")).first()
    prior = (counts["toxic"] or 0) / max(counts["n"], 1)
    lowest = F.xxhash64("__id")
    toxic = known.where("__label = 1").select("__id").orderBy(lowest, "__id").limit(positives).withColumn("__positive", F.lit(True))
    every = docs.select(F.col(id_col).alias("__id")).where("__id is not null").where(~held_out(F.col("__id")))
    unknown = every.orderBy(F.xxhash64("__id", F.lit(1)), "__id").limit(unlabelled).withColumn("__positive", F.lit(False))
    chosen = toxic.unionByName(unknown)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, sizes = word_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<i4").tobytes() for x in np.split(buckets, np.cumsum(sizes)[:-1])] if batch.num_rows else [], pa.binary())], names=["p", "b"])

    rows = texts.select("__positive", "__text").mapInArrow(featurise, "p boolean, b binary").toArrow()
    sets = [np.frombuffer(x, dtype="<i4") for x in rows.column("b").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (not rows.column("p")[i].as_py(), sets[i].tobytes()))
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    buckets = np.concatenate([np.zeros(0, np.int64), *[sets[i] for i in order]]).astype(np.int64)
    return train(buckets, sizes, np.array([rows.column("p")[i].as_py() for i in order], dtype=bool), prior)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with the score of every row's whole text; an old column of that name is replaced."""
    kept = docs.drop(score_col)
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(at), classifier), pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row of `docs`; repeated rows repeat, a null id is held out."""
    classifier = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(id_col, text_col), classifier, text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
