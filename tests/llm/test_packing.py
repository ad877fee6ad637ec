from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxtally.llm import packing


def test_pieces_are_the_tokenizers_ids_and_fill_sequences(documents, odd_rows):
    got = packing.pack_documents(documents(odd_rows)).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in dict((r for r in odd_rows if r[0])).items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got.doc_id == doc_id]
        assert mine.length.sum() == len(ids) * sum(i == doc_id for i, _ in odd_rows)
        for row in mine.itertuples():
            assert row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= packing.SIZE
    assert got.sequence_id.nunique() <= -(-got.length.sum() // packing.SIZE) + 1


def test_added_tokens_in_a_text_have_their_own_id(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}\n y", f"<|endoftext{end}|>", "<|endoftext|", "<|ENDOFTEXT|>", f"word {end} " * 1500]
    got = packing.pack_documents(documents(list(enumerate(texts)))).toPandas()
    for doc_id, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert list(zip(mine.start, mine.length, strict=True)) == packing.cut(len(ids), packing.SIZE)
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in packing.cut(len(ids), packing.SIZE)]
    assert packing.encode_text(f"a {end} b", packing.vocabulary_path()) == [64, 220, 50256, 275]


def test_long_runs_of_white_space_have_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = packing.vocabulary_path()
    blanks = [" ", "\n", "\t", "\r\n", " \n", "\u3000", "\u2028 ", "\xa0", "\x1c", "\x85", "\u200b"]
    for blank in blanks:
        for n in (999, 1000, 1001, 1777):
            run = blank * n
            for text in (run, f"a{run}", f"{run}b", f"a{run}b", f"a {run}'s 7{run}?{run}", f"x{run}<|endoftext|>{run}y"):
                assert packing.encode_text(text, path) == tokenizer.encode(text, add_special_tokens=False).ids, (blank, n)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "w" * 2_000_000, "7!" * 500_000, "a " + " \n" * 1_000_000 + " b"])
def test_very_long_texts_have_the_tokenizers_ids(documents, text):
    ids = np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
    got = packing.pack_documents(documents([(1, text), (2, "short")])).toPandas()
    mine = got[got.doc_id == 1].sort_values("piece")
    assert list(zip(mine.start, mine.length, strict=True)) == packing.cut(len(ids), packing.SIZE)
    assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in packing.cut(len(ids), packing.SIZE)]


def fewest(lengths, size):
    """The fewest sequences of whole pieces, by trying every place for each piece."""
    best = len(lengths)

    def put(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= lengths[at]}.values()):
            put(at + 1, [*rooms[:k], rooms[k] - lengths[at], *rooms[k + 1 :]])
        put(at + 1, [*rooms, size - lengths[at]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_packing_is_near_the_fewest_sequences(lengths):
    lengths = sorted(lengths, reverse=True)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_two_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), 12)
    assert fewest(lengths, 12) <= plan.sequences <= fewest(lengths, 12) + 1


def test_only_long_documents_are_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_empty_table(documents):
    assert packing.pack_documents(documents([(1, "x")]).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120))
def test_every_piece_has_a_place_of_its_own(lengths):
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.best_two_fit(dict(zip(values.tolist(), counts.tolist(), strict=True)), 32)
    length = np.repeat(values, counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = packing.place(length, rank, plan)
    taken = sorted((s, o + k) for s, o, n in zip(sequence, offset, length, strict=True) for k in range(n))
    assert len(set(taken)) == len(taken) == sum(lengths)
    assert max(o for _, o in taken) < 32
    assert set(sequence.tolist()) == set(range(plan.sequences))
    largest_first = []
    for n in sorted(lengths, reverse=True):
        room = [i for i, b in enumerate(largest_first) if b + n <= 32]
        if room:
            largest_first[room[0]] += n
        else:
            largest_first.append(n)
    assert plan.sequences <= len(largest_first) + max(1, len(largest_first) // 10)


def test_the_smallest_gives_way_to_a_better_pair():
    plan = packing.best_two_fit({60: 1, 30: 1, 20: 1, 19: 1}, 100)
    assert plan.sequences == 2
    first = {int(n) for n, s in zip(plan.length, plan.sequence, strict=True) if s == 0}
    assert first == {60, 20, 19}
