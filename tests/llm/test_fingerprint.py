from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from voxtally.llm import fingerprint


def one(*texts):
    return fingerprint.vectors(pa.array(texts, pa.string()))


def test_order_of_paragraphs_does_not_matter_but_their_words_do():
    a, b, c, d = one("one two\nthree four five", "three four five\none two", "two one\nthree four five", "one two\nthree four five")
    assert (a == b).all()
    assert (a == d).all()
    assert (a != c).any()


def test_paragraphs_can_be_added_and_taken_away():
    whole, first, rest = one("one two\nthree four\n", "one two\n", "three four\n")
    assert (fingerprint.combine(first, rest) == whole).all()
    assert (fingerprint.combine(whole, rest, -1) == first).all()


def test_likeness_follows_what_texts_share():
    words = [f"word{i}" for i in range(900)]
    own, near, far = one(" ".join(words), " ".join(words[:600] + words[:0] + [f"x{i}" for i in range(300)]), " ".join(f"y{i}" for i in range(900)))
    got = fingerprint.likeness(np.stack([own] * 3), np.stack([own, near, far]))
    assert got[0] == 1
    assert 0.4 < got[1] < 0.9
    assert got[2] < 0.3


def test_chunks_do_not_change_fingerprints():
    texts = ["a b c\nd e f", "", None, "x" * 5000, "long words here " * 400]
    assert (one(*texts) == np.concatenate([one(t) for t in texts])).all()


def test_edited_texts_and_neighbours(documents, odd_rows):
    rows = [r for r in odd_rows if r != (6, odd_rows[5][1])] + [odd_rows[5]]
    for parts in (1, 3, 7):
        got = fingerprint.edited_fingerprints(documents(rows), partitions=parts).toPandas()
        order = sorted(rows, key=lambda r: -r[0] if r[0] is not None else 0)
        order = [r for r in order if r[0] is not None] + [r for r in order if r[0] is None]
        assert len(got) == len(order)
        for (i, text), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
            text, nxt = text or "", nxt or ""
            row = (got[got.doc_id.isna()] if i is None else got[got.doc_id == i]).iloc[0]
            edited = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
            assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert row.n_chars == len(text)
            own, other, following = one(text, edited, nxt)
            assert row.fingerprint == own.tobytes().hex()
            assert row.edited_fingerprint == other.tobytes().hex()
            assert row.near_edited == fingerprint.likeness(own[None], other[None])[0]
            assert row.near_next == fingerprint.likeness(own[None], following[None])[0]


def test_lone_document_and_empty_table(documents):
    lone = fingerprint.edited_fingerprints(documents([(1, "abcdef")])).first()
    assert lone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint.edited_fingerprints(documents([(1, "x")]).limit(0)).count() == 0


def test_plain_fingerprints(documents, odd_rows):
    got = fingerprint.fingerprints(documents(odd_rows))
    assert got.columns == ["doc_id", "fingerprint"]
    assert got.count() == len(odd_rows)


def test_a_text_of_one_word_over_and_over_keeps_its_likeness():
    for word in ("Orre", "And", "xyz"):
        own, edited = one(" ".join([word] * 3000), " ".join([word] * 2000 + [f"x{i}" for i in range(1000)]))
        assert 0.5 < fingerprint.likeness(own[None], edited[None])[0] < 0.8


WORD = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & WORD
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & WORD
    return x ^ (x >> 31)


def hashed(word):
    """A polynomial over scrambled bytes, and the length, scrambled."""
    base = 0xD1342543DE82EF95
    total = sum(mixed((b + 1) * 0x9E3779B97F4A7C15 & WORD) * pow(base, k, 1 << 64) for k, b in enumerate(word))
    return mixed((total + len(word)) & WORD)


def plain(text):
    """The fingerprint of a text by adding up its paragraphs one after the other."""
    base = 0xD1342543DE82EF95
    equal, near = [0] * fingerprint.EQUAL, [0] * fingerprint.NEAR
    raw = text.encode()
    salts = [mixed(k + 1) for k in range(fingerprint.EQUAL)]
    for k, salt in enumerate(salts):
        equal[k] += raw.count(b"\n") * salt
        equal[k] += sum(mixed(hashed(p) ^ salt) for p in raw.split(b"\n") if p)
    for paragraph in raw.split(b"\n"):
        phrases, current = [], []
        for word in paragraph.split():
            value = hashed(word)
            current.append(value)
            if value % fingerprint.PHRASE == 0:
                phrases.append(current)
                current = []
        phrases.append(current)
        for phrase in phrases:
            for at in range(0, len(phrase), fingerprint.LONGEST):
                part = phrase[at : at + fingerprint.LONGEST]
                value = mixed(sum(v * pow(base, k, 1 << 64) for k, v in enumerate(part)) & WORD)
                for hand in range(fingerprint.HANDS):
                    bits = value >> (16 * hand) & 0xFFFF
                    near[bits % fingerprint.NEAR] += 1 if bits & 0x8000 else -1
    out = b"".join((v & WORD).to_bytes(8, "little") for v in equal)
    return out + b"".join((v & 0xFFFF).to_bytes(2, "little") for v in near)


def test_fingerprints_are_sums_over_paragraphs():
    texts = ["", "one", "a b c\nd e\n\nf", " \t x \n", "ß 中文 😀\nagain ß", "\n\n", " ".join(f"w{k}" for k in range(300)), "same same same " * 40]
    for text, row in zip(texts, one(*texts), strict=True):
        assert row.tobytes() == plain(text)


def test_very_long_texts():
    for text in ("x" * 3_000_000, " " * 3_000_000, "\n" * 3_000_000, "some words " * 300_000):
        assert (one(text) == one(text + "")).all()
        assert (fingerprint.combine(one(text + "\n"), one("tail")) == one(text + "\ntail")).all()
