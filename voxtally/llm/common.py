"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    A local master needs no shared folder, so one is made there when none is named;
    a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="voxtally-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: (first row, end row, bytes, offsets from 0).

    A null text counts as empty. A text longer than `most` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0xD1342543DE82EF95
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_BASE, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS[:n]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: bytes = b" \t\n\v\f\r") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, their starts and ends, and where each text's words begin.

    A word is a run of bytes other than those in `between`; `lower` folds A-Z. The last
    array has an entry more than there are texts. Words never cross texts.
    """
    n = len(data)
    separator = np.zeros(256, dtype=bool)
    separator[list(between)] = True
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    blank = separator[data]
    first = np.ones(n, dtype=bool)
    first[1:] = blank[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = True
    last = np.ones(n, dtype=bool)
    last[:-1] = blank[1:]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(first & ~blank)
    ends = np.flatnonzero(last & ~blank) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    place = np.arange(n, dtype=np.int64)
    begin = np.zeros(n, dtype=np.int64)
    begin[starts[0]] = starts[0]
    begin[starts[1:]] = starts[1:] - starts[:-1]
    place -= np.cumsum(begin)
    place[blank] = 0
    np.maximum(place, 0, out=place)
    longest = int((ends - starts).max())
    value = (_BYTE_LOWER if lower else _BYTE)[data]
    value[blank] = 0
    value *= powers(longest)[place]
    hashes = mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets)
