from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxtally.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The nodes by following every conversation turn by turn."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, convs in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(convs) - 1) * size
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in convs if paths[c] == p)
        out.append((convs[0], len(p), members[p[:-1]][0] if p else None, len(convs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df, **settings):
    got = prefix_trie.trie(df, **settings)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()), key=repr)


def some_rows(seed, convs=60, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        conv = c * 2 if c % 7 else c * 2 + 1
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), f"word {rng.randrange(words)} é"))
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 4}, {"most_cells": 64}])
def test_nodes_are_those_of_a_turn_by_turn_walk(spark, settings):
    rows = some_rows(3) + [(500 + k, t, "user", f"copy {t}") for k in range(40) for t in range(10)]
    assert nodes(spark.createDataFrame(rows, SCHEMA), **settings) == brute(rows)


def test_a_conversation_of_many_turns_and_a_common_one(spark):
    rows = [(0, t, "user", f"line {t % 50}") for t in range(300)]
    rows += [(5 + k, t, "user", f"line {t}") for k in range(200) for t in range(3)]
    rows += [(1005, t, "user", f"line {t % 50}") for t in range(250)]
    assert nodes(spark.createDataFrame(rows, SCHEMA), block=16) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 400_000
    rows = [
        (1, 0, None, None),
        (1, 1, "", ""),
        (2, None, "user", "before all others"),
        (2, 3, "user", "a"),
        (2, -1, "user", "b"),
        (None, 0, "user", "nobody's"),
        (-7, 0, "user", "a negative number"),
        (-10, 0, "user", "the first of its group"),
        (10, 0, "user", long),
        (11, 0, "user", long),
        (12, 0, "a", "bc"),
        (13, 0, "ab", "c"),
        (20, 0, "user", "said twice"),
        (20, 0, "user", "said twice"),
    ]
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("a", "b", "n", "depth", "digest", "place", "x", "key"):
        clash = clash.withColumn(name, F.lit("clash"))
    assert nodes(clash) == brute(rows)
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    assert nodes(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == []


def test_the_sketch_never_counts_too_little(spark):
    rows = spark.range(5000).select((F.col("id") % 4000 * 7919 + 1).alias("a"))
    counts = prefix_trie.sketch(rows, 1 << 10)
    import numpy as np

    words = np.array([r["a"] for r in rows.collect()], dtype=np.int64)
    seen, n = np.unique(words, return_counts=True)
    assert (counts[prefix_trie.cells_of(seen.view(np.uint64), 1 << 10)].min(0) >= np.minimum(n, 2)).all()


def test_conversations_whose_turns_are_all_replaced(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in range(25) for t in range(1 + c % 3)] + [(c, 0, "user", "alone") for c in (31, 32, 33)]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
