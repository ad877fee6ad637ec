from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A maker of documents from (doc_id, text) pairs, with columns whose names operators use themselves."""

    def make(rows, extra=("n", "length", "piece", "bucket", "digest", "key", "score", "shard", "slot", "id", "chunk")):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


PROSE = [
    "the quick brown fox jumps over the lazy dog while rivers run slowly to the grey northern sea",
    "seven sailors sang a song about silver ships that never came back from the southern straits",
    "a map of every street in the old town hung on the wall behind the counter of the bakery",
    "nobody remembered who had planted the orchard but everyone came to pick the apples in autumn",
]


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a null id, several scripts and a long text."""
    return [
        (1, PROSE[0]),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, PROSE[0]),
        (6, PROSE[1] + "\n" + PROSE[2]),
        (6, PROSE[1] + "\n" + PROSE[2]),
        (None, PROSE[3]),
        (8, "ß中文😀 naïve ﬁne x"),
        (9, PROSE[0].upper()),
        (10, " ".join(f"w{i}" for i in range(6000))),
        (11, PROSE[0] + " and more"),
        (12, "a"),
    ]
