from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from voxtally.llm import substrings


def brute(rows, length=50):
    """(id, bytes, removed mask) by comparing every string with those of smaller ids."""
    holders = {}
    ids = [np.iinfo(np.int64).max if i is None else i for i, _ in rows]
    for i, (_, text) in zip(ids, rows, strict=True):
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            holders[piece] = min(i, holders.get(piece, i))
    for i, (doc_id, text) in zip(ids, rows, strict=True):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - length + 1):
            if holders[raw[s : s + length]] < i:
                gone[s : s + length] = True
        yield doc_id, raw, gone


def check(df, rows, **settings):
    want = []
    for doc_id, raw, gone in brute(rows):
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        want.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(df, report=True, **settings).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def passages():
    rng = random.Random(3)
    letters = "abcdefgh éß中"
    shared = ["".join(rng.choice(letters) for _ in range(n)) for n in (49, 50, 51, 120, 700, 60)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append("".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))))
            whole = rng.choice(shared)
            parts.append(whole[rng.randrange(0, 20) :] if rng.random() < 0.4 else whole)
        rows.append((i, "".join(parts)))
    rows += [(100, "z" * 400), (101, "z" * 130), (102, "zy" * 60), (103, rows[0][1]), (50, rows[50][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [{}, {"chunk": 300, "batch": 400}, {"chunk": 2000, "batch": 1, "seed": 16}])
def test_every_repeated_string_goes(documents, settings):
    rows = passages()
    check(documents(rows).repartition(3), rows, **settings)


def test_odd_rows(documents, odd_rows):
    check(documents(odd_rows), odd_rows)


def test_texts_keep_their_columns_and_whole_characters(documents):
    rows = passages()
    df = documents(rows)
    got = substrings.remove_repeats(df, chunk=500)
    assert got.schema == df.schema
    want = sorted(np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for _, raw, gone in brute(rows))
    assert sorted(r["text"] for r in got.collect()) == want


def test_null_texts_stay_null(documents):
    assert [r["text"] for r in substrings.remove_repeats(documents([(1, None), (2, "")])).orderBy("doc_id").collect()] == [None, ""]


def test_empty_table(documents):
    assert substrings.remove_repeats(documents([(1, "x")]).limit(0), report=True).count() == 0


def test_levels_are_few_and_batches_may_come_in_any_order():
    rng = np.random.default_rng(0)
    strings = np.array([bytes(rng.integers(97, 100, 4).astype(np.uint8)) for _ in range(600)], dtype="S4")
    docs = rng.integers(0, 40, 600)
    index = substrings.SuffixLevels()
    covered = np.concatenate([index.add(strings[a : a + 20], docs[a : a + 20], np.arange(a, a + 20)) for a in range(0, 600, 20)])
    least = {s: docs[strings == s].min() for s in set(strings.tolist())}
    assert sorted(covered.tolist()) == [i for i in range(600) if docs[i] > least[strings[i]]]
    assert len(index.levels) <= 8
