from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxtally.llm import cutting_stock as stock


def histogram(lengths):
    values, counts = np.unique(lengths, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120), st.sampled_from([0.0, 0.0005, 0.2]))
def test_parts_tile_unpadded_sequences(lengths, gap):
    counts = histogram(lengths)
    layout = stock.lay_out(counts, 32, gap)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(c) for c in counts.values()])
    piece, skipped, n, sequence, offset = stock.parts(length, rank, layout, 32)
    assert (n > 0).all()
    taken = sorted((s, o + k) for s, o, m in zip(sequence.tolist(), offset.tolist(), n.tolist(), strict=True) for k in range(m))
    assert len(set(taken)) == len(taken) == sum(lengths)
    totals = np.unique([s for s, _ in taken], return_counts=True)[1]
    assert set(totals.tolist()) <= set(stock.unpadded(32).tolist())
    ends = {s: max(o for t, o in taken if t == s) for s in {s for s, _ in taken}}
    assert all(ends[s] + 1 == sum(t == s for t, _ in taken) for s in ends)
    own = sorted((p, f + k) for p, f, m in zip(piece.tolist(), skipped.tolist(), n.tolist(), strict=True) for k in range(m))
    assert own == sorted((p, k) for p, m in enumerate(length.tolist()) for k in range(m))


def patterns(size, counts):
    """All multisets of the pieces that need no padding."""
    lengths = sorted(counts)
    found = []
    for uses in itertools.product(*[range(min(counts[n], size // n) + 1) for n in lengths]):
        total = sum(n * k for n, k in zip(lengths, uses, strict=True))
        if total in set(stock.unpadded(size).tolist()):
            found.append(uses)
    return lengths, found


def most_packed(size, counts):
    """The most (tokens less sequences) of whole packings, by trying all."""
    lengths, found = patterns(size, counts)
    best = {tuple(counts[n] for n in lengths): 0}
    for uses in found:
        worth = sum(n * k for n, k in zip(lengths, uses, strict=True)) - 1
        for left in sorted(best, reverse=True):
            at, value = left, best[left]
            while all(a >= k for a, k in zip(at, uses, strict=True)):
                at, value = tuple(a - k for a, k in zip(at, uses, strict=True)), value + worth
                best[at] = max(best.get(at, 0), value)
    return max(best.values())


@pytest.mark.parametrize("counts", [{3: 4, 5: 5, 7: 2}, {6: 3, 10: 4, 4: 3}, {11: 4, 5: 4, 1: 3}, {9: 5, 7: 2, 8: 2}])
def test_the_linear_program_reaches_the_best_whole_packing(counts):
    dense = np.zeros(17, dtype=np.int64)
    for n, k in counts.items():
        dense[n] = k
    chosen = stock.column_generation(dense, 16, gap=0.0)
    value = sum((p.total - 1) * x for p, x in chosen)
    assert value >= most_packed(16, counts) - 1e-6
    used = np.zeros(17)
    for p, x in chosen:
        used[p.lengths] += x * p.copies
        assert p.total in stock.unpadded(16)
    assert (used <= dense + 1e-6).all()


def test_knapsack_prices_are_those_of_all_patterns():
    rng = np.random.default_rng(3)
    counts = {2: 3, 3: 2, 7: 2, 9: 1}
    dense = np.zeros(17, dtype=np.int64)
    for n, k in counts.items():
        dense[n] = k
    for _ in range(20):
        prices = rng.uniform(0, 10, size=17)
        lengths, found = patterns(16, counts)
        want = max(sum(n * k for n, k in zip(lengths, u, strict=True)) - 1 - sum(prices[n] * k for n, k in zip(lengths, u, strict=True)) for u in found if any(u))
        pattern, worth = stock.cheapest_pattern(prices, dense, 16)
        assert worth == pytest.approx(want)
        assert pattern.total - 1 - prices[pattern.lengths] @ pattern.copies == pytest.approx(worth)


@pytest.mark.parametrize("most", [stock.MOST_BROADCAST, 0])
def test_documents_are_whole_and_ids_are_the_tokenizers(documents, odd_rows, monkeypatch, most):
    monkeypatch.setattr(stock, "MOST_BROADCAST", most)
    rows = [r for r in odd_rows if r[0] not in (6, None)] + [(20 + k, f"word {k} " * (9 * k + 1)) for k in range(60)] + [(90, "a <|endoftext|> b")]
    got = stock.pack_documents(documents(rows)).toPandas()
    assert list(got.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = got[got.doc_id == doc_id].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() in stock.unpadded(stock.SIZE)
    assert got.sequence_id.nunique() <= got.length.sum() // stock.SIZE + 40


def test_ids_come_along_and_odd_tables(documents, odd_rows):
    got = stock.pack_documents(documents(odd_rows), with_ids=True).collect()
    assert sum(r["doc_id"] is None for r in got) >= 1
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 6)
    assert stock.pack_documents(documents([(1, "x")]).limit(0)).count() == 0


def test_very_long_texts(documents):
    texts = {1: " " * 1_500_000, 2: "\n" * 1_500_000, 3: "b" * 1_500_000, 4: "some words " * 200_000}
    got = stock.pack_documents(documents(list(texts.items()))).toPandas()
    tokens = {i: g.length.sum() for i, g in got.groupby("doc_id")}
    assert (got.groupby("doc_id").doc_tokens.first() == got.groupby("doc_id").length.sum()).all()
    assert set(tokens) == set(texts)
