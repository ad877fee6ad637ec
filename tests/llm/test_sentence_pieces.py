from __future__ import annotations

import hashlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from voxtally.llm import sentence_pieces

TEXTS = ["hello world", "  a ▁ b", "x▁▁", "中文 emoji 😀 ñ\n\tz", " ", "a  b   c", "\u0000a", "ﬁne ＡＢＣ", "é" * 50]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


def test_ids_and_text_are_the_library_s(documents, odd_rows, library):
    got = sentence_pieces.encode(documents(odd_rows)).toPandas()
    want = {(i, tuple(library.encode(t or "")), library.decode(library.encode(t or "")) if t else "") for i, t in odd_rows}
    assert {(None if i != i else i, tuple(x), d) for i, x, d in zip(got.doc_id, got.ids, got.decoded, strict=True)} == want
    assert len(got) == len(odd_rows)


def test_digests(documents, odd_rows, library):
    got = sentence_pieces.encode(documents(odd_rows), digests=True).where("doc_id = 8").first()
    ids = library.encode(dict(odd_rows)[8])
    assert got["n_tokens"] == len(ids)
    assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_spans_are_the_original_bytes_of_each_piece(spark, library):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in sentence_pieces.encode(rows).collect():
        text = TEXTS[row["doc_id"]]
        pieces = list(library.encode(text, return_type="proto").pieces)
        assert len(pieces) == len(row["span_ends"])
        for piece, end in zip(pieces, row["span_ends"], strict=True):
            assert piece.end == end or (library.is_byte(piece.id) and piece.begin <= end), text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_follows_the_compiled_map(rule):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for k, v in sentence_pieces._fields(theirs.serialized_model_proto()) if k == 3)
    mine = sentence_pieces.Normalizer(spec)
    for text in [*TEXTS, "ﬁne ＡＢＣ  ①  ", "  ½ kg　x", "Ǻ ｶﾞ", "tab\tnew\nline  ", "", "Straße İ"]:
        normal, source = mine(text.encode())
        assert normal.decode() == theirs.normalize(text)
        assert len(source) == len(normal) + 1
        assert sorted(source.tolist()) == source.tolist()
        assert source[-1] <= len(text.encode())


def test_an_empty_map_takes_whole_arrays_to_the_same_end():
    normalizer = sentence_pieces.load(sentence_pieces.model_path()).normalizer
    assert not normalizer.map.units
    for text in [*TEXTS, "", " a", "a ", "▁ ▁", " " * 40]:
        normal, source = normalizer(text.encode())
        out, notes = "▁".encode() if text else b"", [0] * (3 if text else 0)
        for start, _, new in normalizer.steps(text.encode()):
            new = "▁".encode() if new == b" " else new
            out += new
            notes += [start + k * (new != "▁".encode() or text.encode()[start:start + 1] != b" ") for k in range(len(new))]
        assert normal == out
        assert source.tolist() == [*notes, len(text.encode())]


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "w" * 1_000_000, "some words " * 200_000])
def test_very_long_texts(documents, library, text):
    got = sentence_pieces.encode(documents([(1, text)])).first()
    ids = library.encode(text)
    assert got["n_tokens"] == len(ids) and list(got["ids"]) == ids
    assert got["span_ends"][-1] == len(text) and got["decoded"] == library.decode(ids)


def test_empty_table(documents):
    empty = documents([(1, "x")]).where(F.lit(False))
    assert sentence_pieces.encode(empty, digests=True).count() == 0
