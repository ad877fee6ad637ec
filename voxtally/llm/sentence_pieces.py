"""SentencePiece encoding whose pieces carry the byte spans of the original text.

A text is normalised by the longest prefix that the model's compiled character map holds,
noting for every normalised byte the original byte it came from; white space becomes the
meta symbol and a leading one is added, as the model says. The library cuts the text into
pieces, and each piece's bytes are projected back through the notes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
META = "▁"
SPAN_WORDS = 1 << 16


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: a double array over UTF-8 prefixes and its replacements."""

    def __init__(self, raw: bytes) -> None:
        size = int.from_bytes(raw[:4], "little") if raw else 0
        self.units = np.frombuffer(raw[4 : 4 + size], dtype="<u4").tolist() if size else []
        self.texts = raw[4 + size :] if size else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix at a place, if the map has one.

        A unit's lowest bytes are its label, bit 8 says that a value hangs below it, and
        bits 10 and up (times 256 if bit 9 is set) lead to its children.
        """
        units, found = self.units, None
        node, unit = 0, units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normalizer:
    """What the model's normaliser does, with the source of every byte."""

    def __init__(self, spec: bytes) -> None:
        held = dict(_fields(spec))
        self.map = CharacterMap(held.get(2, b""))
        self.prefix = bool(held.get(3, 1))
        self.squeeze = bool(held.get(4, 1))
        self.escape = bool(held.get(5, 1))

    def steps(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, replacement): the map's longest prefix, or else one character."""
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map.units else None
            if hit is None:
                lead = text[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, text[at : at + size]
            yield at, at + hit[0], hit[1]
            at += hit[0]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and the source of each, with the text's end behind the last.

        Squeezing takes leading and trailing spaces away and makes runs of them one.
        """
        space = META.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            return self.unmapped(text, space)
        out = bytearray()
        source: list[int] = []
        steps = list(self.steps(text))
        if self.squeeze:
            while steps and steps[0][2] == b" ":
                steps.pop(0)
        end = len(text)
        if not steps:
            return b"", np.array([end], dtype=np.int64)
        after_space = self.squeeze
        if self.prefix:
            out += space
            source += [steps[0][0]] * len(space)
        for start, _, new in steps:
            if self.squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                for byte in new:
                    piece = space if byte == 32 else bytes([byte])
                    out += piece
                    source += [start] * len(piece)
                after_space = new.endswith(b" ")
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            end = source[-len(space)]
            del source[-len(space) :]
        return bytes(out), np.array([*source, end], dtype=np.int64)


    def unmapped(self, text: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map, in which every character stands for itself: whole arrays at a time."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        lead = space if self.prefix else b""
        wide = np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1)
        source = np.concatenate([np.zeros(len(lead), np.int64), np.repeat(np.arange(len(text)), wide), [len(text)]])
        return lead + text.replace(b" ", space), source


class Model:
    """A model file: the library's processor, its normaliser, and its pieces' lengths."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for number, value in fields if number == 1]
        self.normalizer = Normalizer(next((value for number, value in fields if number == 3), b""))
        kinds = np.array([p.get(3, 1) for p in pieces])
        surfaces = [p[1].decode() for p in pieces]
        self.lengths = np.where(kinds == 6, 1, [len(x.encode()) for x in surfaces]).astype(np.int64)
        self.unknown = kinds == 2

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Where each piece ends in the original UTF-8 bytes; a piece begins where the last ended.

        Pieces tile the normalised bytes, whose sources the normaliser has noted.
        """
        if not len(ids):
            return np.zeros(0, dtype=np.int64)
        normal, source = self.normalizer(text.encode())
        lengths = self.lengths[ids].copy()
        if self.unknown[ids].any():
            proto = self.processor.encode(text, return_type="proto")
            lengths = np.array([len(p.surface.replace(" ", META).encode()) for p in proto.pieces], dtype=np.int64)
        return source[np.minimum(np.cumsum(lengths), len(normal))]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, spans: bool = True, digests: bool = False) -> DataFrame:
    """Each document's ids, spans and decoded text, or with `digests` their sha-256 instead.

    Columns: doc_id, n_tokens; ids and, with `spans`, span_ends (the original byte at which
    each piece ends), decoded; with `digests` ids_sha256, decoded_sha256, and `spans_crc32`
    of the span ends as little-endian 64-bit numbers. A null or empty text has no pieces.
    Rows are handled one by one, so repeated rows repeat. Other columns are not read.
    """
    path = path or model_path()
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    kept = [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_crc32", T.LongType())]
    real = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("span_ends", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType([id_field, T.StructField("n_tokens", T.LongType()), *[f for f in (kept if digests else real) if spans or not f.name.startswith("span")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        model = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                out: dict[str, list] = {f.name: [] for f in schema.fields[1:]}
                for text in texts:
                    ids = model.processor.encode(text)
                    decoded = model.processor.decode(ids) if ids else ""
                    out["n_tokens"].append(len(ids))
                    ends = model.spans(text, np.array(ids, dtype=np.int64)) if spans else None
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                        if spans:
                            out["spans_crc32"].append(zlib.crc32(ends.astype("<i8").tobytes()))
                    else:
                        out["ids"].append(ids)
                        out["decoded"].append(decoded)
                        if spans:
                            out["span_ends"].append(ends)
                arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "span_ends": pa.list_(pa.int64()), "spans_crc32": pa.int64()}
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, arrow.get(k, pa.string())) for k, v in out.items()]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
