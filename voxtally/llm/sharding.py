"""Shards of nearly equal size: the minimax contiguous partition of ordered groups.

Equal texts are a group and stay together. Groups stand in the order of a digest of their
text. The smallest capacity for which greedy filling needs no more than the given number of
shards is found by binary search; shards are cut where that filling cuts. The search works
on sums of ranges of the order, and looks closer only at ranges where a cut may fall, so
the driver holds a bounded number of sums however many groups there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import settle

BITS = 60
FIRST_BITS = 10
NEXT_BITS = 5
CELLS = 1 << 14


class Range(NamedTuple):
    """The groups whose place, without its lowest `shift` bits, is `prefix`."""

    prefix: int
    shift: int
    size: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << self.shift


def shards_needed(ranges: list[Range], capacity: int, fluid: bool) -> int:
    """Greedy filling's number of shards; `fluid` cuts ranges of several groups anywhere."""
    shards, room = 1, capacity
    for r in ranges:
        size = r.size
        if fluid and r.groups > 1:
            if size > room:
                size -= room
                more = -(-size // capacity)
                shards += more
                room = capacity * more - size
            else:
                room -= size
        elif size > capacity:
            return 1 << 62
        elif size > room:
            shards += 1
            room = capacity - size
        else:
            room -= size
    return shards


def smallest_capacity(ranges: list[Range], shards: int, fluid: bool) -> int:
    """Binary search over capacities."""
    total = sum(r.size for r in ranges)
    low, high = max(1, -(-total // shards)), max(1, total)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(ranges, middle, fluid) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def unsure(ranges: list[Range], shards: int, low: int, high: int) -> list[Range]:
    """The ranges of several groups in which a cut of some capacity from `low` to `high` may fall."""
    ends, total = [], 0
    for r in ranges:
        total += r.size
        ends.append(total)
    found = set()
    first = last = 0
    for _ in range(shards - 1):
        i = next((k for k, end in enumerate(ends) if end > first + low), len(ends) - 1)
        first = ends[i] - ranges[i].size
        last = min(last + high, total)
        while i < len(ends) and ends[i] - ranges[i].size <= last:
            if ranges[i].groups > 1:
                found.add(i)
            i += 1
    return [ranges[i] for i in sorted(found)]


def cuts(ranges: list[Range], capacity: int) -> list[int]:
    """The places where greedy filling begins a new shard."""
    found, room = [], capacity
    for r in ranges:
        if r.size > room:
            found.append(r.start)
            room = capacity
        room -= r.size
    return found


def minimax_cuts(groups: DataFrame, shards: int, first: list[Range]) -> tuple[int, list[int]]:
    """(capacity, cuts) of `groups` (place, size); `first` are the sums of their first bits.

    While cuts between ranges alone may not be the best, the ranges in question are summed
    by `NEXT_BITS` more bits, and only their groups are read.
    """
    ranges = sorted(first)
    while True:
        high = smallest_capacity(ranges, shards, fluid=False)
        low = smallest_capacity(ranges, shards, fluid=True)
        split = unsure(ranges, shards, low, high) if low < high else []
        if not split:
            return high, cuts(ranges, high)
        for shift in sorted({r.shift for r in split}):
            old = [r for r in split if r.shift == shift]
            lower = max(shift - NEXT_BITS, 0)
            inside = groups.where(F.shiftright("place", shift).isin([r.prefix for r in old]))
            new = [Range(r["prefix"], lower, r["size"], r["groups"]) for r in _sums(inside, lower).collect()]
            ranges = [r for r in ranges if r not in set(old)] + new
        ranges.sort(key=lambda r: r.start)


def _sums(groups: DataFrame, shift: int) -> DataFrame:
    return groups.groupBy(F.shiftright("place", shift).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.sum("rows").alias("rows"))


def place_of(text: Column) -> Column:
    """A text's place in the order of groups: `BITS` bits of its md5; a null's is its own."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long"), F.lit(0))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, cells: int = CELLS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law `bytes`.

    A row's size is its text's UTF-8 bytes and one; a null text has none. Rows of equal
    texts share a shard. Slots number a shard's rows from 0, gapless: they are counted in
    cells of the order that hold about one in `cells` of all rows, a group of many rows being
    spread over many cells by the hash of its ids. Repeated rows have slots of their own. An
    empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = settle(docs.select(F.col(id_col).alias("__id"), size.alias("size"), crc.alias("crc"), place_of(text).alias("place")), "sized")
    groups = settle(rows.groupBy("place").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    shift = BITS - FIRST_BITS
    sums = _sums(groups, shift).collect()
    _, starts = minimax_cuts(groups, shards, [Range(r["prefix"], shift, r["size"], r["groups"]) for r in sums])
    number = F.lit(0)
    for start in starts:
        number = number + (F.col("place") >= start).cast("int")
    total = max(1, sum(r["rows"] for r in sums))
    spread = [1] * (1 << FIRST_BITS)
    for r in sums:
        spread[r["prefix"]] = max(1, -(-r["rows"] * cells // total))
    prefix = F.shiftright("place", shift).cast("int")
    salts = F.element_at(F.array(*[F.lit(n) for n in spread]), prefix + 1)
    placed = rows.withColumn("shard", number).withColumn("cell", prefix).withColumn("salt", F.pmod(F.xxhash64("__id", "crc"), salts).cast("int"))
    key = ["shard", "cell", "salt"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy(*key).orderBy("__id", "place", "size")) - 1
    found = placed.withColumn("inner", inner).join(counts, key)
    return found.select(F.col("__id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
