from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxtally.llm import near_dedup
from voxtally.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    tree = list(range(len(rows)))

    def find(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                tree[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return [(doc_id, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]


def check(got, rows, percent=85):
    want = sorted(brute(rows, percent), key=repr)
    mine = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr)
    assert mine == want


def near_rows():
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(500)}" for _ in range(rng.randrange(5, 300))]
        for _ in range(30):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words[: rng.choice([len(words), len(words), len(words) * 9 // 10])]))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(documents):
    rows = near_rows()
    check(near_dedup.near_duplicates(documents(rows)), rows)


def test_odd_rows(documents, odd_rows):
    check(near_dedup.near_duplicates(documents(odd_rows)), odd_rows)


def test_empty_table_and_no_links(documents):
    assert near_dedup.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
    check(near_dedup.near_duplicates(documents([(1, "a b c"), (2, "d")])), [(1, "a b c"), (2, "d")])


def test_one_of_each_group_stays(documents):
    rows = near_rows()
    df = documents(rows)
    stay = near_dedup.deduplicate(df)
    assert stay.columns == df.columns
    assert {r["doc_id"] for r in stay.collect()} == {c for _, _, c in brute(rows, 85)}


def test_blocks_lose_no_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(100)[:96]], rng.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(40)]
    labels = [bytes([i]) for i in range(40)]
    tree = {x: x for x in labels}

    def find(x):
        while tree[x] != x:
            x = tree[x]
        return x

    for a, b in near_dedup.link_forest(labels, sets, 85):
        tree[find(a)] = find(b)
    for i in range(40):
        for j in range(i):
            if near_dedup.similar(sets[i], sets[j], 85):
                assert find(labels[i]) == find(labels[j])


@pytest.mark.parametrize("block", [2, 5])
def test_small_blocks_give_the_same(spark, block):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(60)[:57]], rng.integers(0, 2**63, 2).astype(np.uint64)])) for _ in range(20)]
    rows = spark.createDataFrame([(1, bytes([i]), len(s), bytes([i])) for i, s in enumerate(sets)], "bucket long, digest binary, n long, component binary")
    stored = spark.createDataFrame([(bytes([i]), s.tobytes()) for i, s in enumerate(sets)], "digest binary, set binary")

    def labels(links):
        found = {bytes(r["node"]): bytes(r["component"]) for r in components(links).collect()}
        return [found.get(bytes([i]), bytes([i])) for i in range(20)]

    assert labels(near_dedup.cross_links(rows, stored, 85, block)) == labels(near_dedup.cross_links(rows, stored, 85, 256))


def test_sketches_are_full_and_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    tiny = np.array([7], dtype=np.uint64)
    found = near_dedup.sketches(np.concatenate([a, b, tiny]), np.array([len(a), len(b), 1]))
    assert (found != near_dedup._NONE).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((found[0] == found[1]).mean() - true) < 0.1
    alone = near_dedup.sketches(b, np.array([len(b)]))
    assert (alone[0] == found[1]).all()


def test_sets_do_not_depend_on_neighbours():
    texts = ["a b c d e f", "a b c", None, "A B C D E F"]
    sizes = np.concatenate([s for _, s in near_dedup.shingle_sets(pa.array(texts, pa.string()))])
    assert sizes.tolist() == [2, 1, 0, 2]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(100)}


def test_sql_twin_finds_the_same_components():
    import duckdb

    rows = [*near_rows()[:90], (1000, None), (1001, ""), (1002, "a b c"), (1003, "A B C")]
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    link.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = link.execute(near_dedup.near_duplicates_sql()).fetchall()
    assert sorted(r[:3] for r in got) == sorted(brute(rows, 85))
    assert all(kept == (doc_id == component) for doc_id, _, component, kept in got)
