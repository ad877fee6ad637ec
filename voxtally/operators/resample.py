"""Distributed resampling.

Samples are cut into blocks of at most ``block_size`` consecutive positions of one group.  A
resample never copies rows: inside a block it is a vector of multiplicities (bootstrap) or of cell
numbers (permutation, split), and one matrix product gives the weighted moments of *all*
resamples of that block.  Only moments are shuffled, as (resample, cell, k, value) with map-side
sums, so the traffic is resamples x cells x moments and does not grow with the samples.

Draws come from a hash of (seed, resample, sample), so they do not depend on partitioning and a lost
executor recomputes the same numbers.  Fixed group sizes are exact: a permutation is the order of
the draws, found through its few cut points (see ``cut_points``), and a bootstrap first draws how
many of the group's slots fall in each block."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxtally.functions import draws as D
from voxtally.functions.columns import draw62
from voxtally.operators.ordering import with_rank

BLOCK_SIZE = 4096
DRAW_BITS = 62
ROUNDS = 4  # doublings of the candidates before rules are given up
SLAB = 10  # splits that share a row of packed moments
DRAW_BUDGET = 2_000_000  # draws held at once in a task
SUMS_SCHEMA = "resample int, cell int, k int, v double"
# Seeds of the independent draw streams of one analysis.
BLOCK_STREAM, IN_BLOCK_STREAM, PERMUTATION_STREAM, CONDITION_STREAM, SPLIT_STREAM, HALF_STREAM = 11, 12, 21, 22, 31, 41


def stream(seed: int, which: int) -> int:
    return seed * 97 + which


# ------------------------------------------------------------------ samples in blocks
@dataclass
class Blocks:
    """``rows(animal_id, group, sid, block, x)``; ``sid`` numbers all samples from 0, group by group."""

    rows: DataFrame
    sizes: list[int]
    block_size: int = BLOCK_SIZE

    @property
    def starts(self) -> list[int]:
        return [int(v) for v in np.concatenate([[0], np.cumsum(self.sizes)[:-1]])]

    @property
    def blocks_per_group(self) -> list[int]:
        return [max(1, -(-n // self.block_size)) for n in self.sizes]

    @property
    def first_block(self) -> list[int]:
        return [int(v) for v in np.concatenate([[0], np.cumsum(self.blocks_per_group)[:-1]])]

    @property
    def n_blocks(self) -> int:
        return sum(self.blocks_per_group)

    def chunks(self) -> int:
        """Resamples are also cut into chunks when there are fewer blocks than task slots."""
        slots = self.rows.sparkSession.sparkContext.defaultParallelism
        return max(1, -(-slots // self.n_blocks))


def numeric_key(df: DataFrame, column: str) -> Column:
    """A numeric sort key for identifiers; strings are ordered by their hash."""
    return F.xxhash64(column) if dict(df.dtypes)[column] == "string" else F.col(column).cast("long")


def with_positions(rows: DataFrame, group: str = "group", key: str = "animal_id") -> DataFrame:
    """Add ``pos``, the 0-based position of a sample in its group in the order of ``key``."""
    value = numeric_key(rows, key)
    return with_rank(rows, [group], value, [value, F.col(key)], name="pos").withColumn("pos", F.col("pos") - 1)


def make_blocks(rows: DataFrame, sizes: Sequence[int], block_size: int = BLOCK_SIZE) -> Blocks:
    """``rows(animal_id, group, x)`` with group numbers 0..G-1."""
    sizes = [int(n) for n in sizes]
    starts = F.array(*[F.lit(int(v)).cast("long") for v in np.concatenate([[0], np.cumsum(sizes)[:-1]])])
    numbered = with_positions(rows).select(
        "animal_id", "group",
        (F.get(starts, F.col("group")) + F.col("pos")).alias("sid"),
        F.floor(F.col("pos") / F.lit(block_size)).cast("int").alias("block"),
        "x",
    )
    return Blocks(numbered.persist(), sizes, block_size)


def fan_out(df: DataFrame, n: int, name: str = "resample", first: int = 0) -> DataFrame:
    """One copy of each row per resample id."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))


Assignment = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, "np.ndarray | None"]]


# ------------------------------------------------------------------ draws as tables
def cut_points(draws: DataFrame, keys: Sequence[str], cuts: DataFrame, bins: int = 256) -> DataFrame:
    """The draws at given ranks: (keys, cut, threshold) for ``cuts(keys, cut, rank)``.

    A histogram of the leading bits finds the bin of each rank; only the rows of those bins are
    sorted.  Neither step holds a whole key in one task."""
    keys = list(keys)
    shift = DRAW_BITS - int(np.log2(bins))
    binned = draws.withColumn("_bin", F.shiftright("draw", shift))
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_to", F.sum("_n").over(upto))
    located = (
        hist.join(cuts, keys)
        .filter((F.col("rank") <= F.col("_to")) & (F.col("rank") > F.col("_to") - F.col("_n")))
        .select(*keys, "_bin", "cut", (F.col("rank") - F.col("_to") + F.col("_n")).alias("_local"))
    )
    wanted = located.select(*keys, "_bin").distinct()
    inside = Window.partitionBy(*keys, "_bin").orderBy("draw")
    ordered = binned.join(wanted, keys + ["_bin"], "left_semi").withColumn("_local", F.row_number().over(inside))
    return located.join(ordered, keys + ["_bin", "_local"]).select(*keys, "cut", F.col("draw").alias("threshold"))


def permutation_draws(blocks: Blocks, n: int, seed: int) -> DataFrame:
    return fan_out(blocks.rows.select("sid", "group"), n).withColumn(
        "draw", draw62(stream(seed, PERMUTATION_STREAM), F.col("resample"), F.col("sid"))
    )


def permutation_cuts(blocks: Blocks, n: int, seed: int, bins: int = 256) -> DataFrame:
    """(resample, cut, threshold): draws at the group boundaries of each permutation.

    Tasks draw in numpy and count draws per leading bits; a second pass returns only the draws of
    the bins in which a boundary lies.  What the driver sees is permutations x groups numbers."""
    bounds = np.cumsum(blocks.sizes)[:-1]
    spark = blocks.rows.sparkSession
    if not len(bounds) or not n:
        return spark.createDataFrame([], "resample int, cut int, threshold long")
    shift, code = 32 - int(np.log2(bins)), stream(seed, PERMUTATION_STREAM)  # of the leading word

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((n, bins), dtype=np.int64)
        for pdf in frames:
            sid = pdf["sid"].to_numpy()
            for ids in D.slabs(n, len(sid)):
                at = np.arange(len(ids))[:, None] * bins + (D.high_word(code, ids[:, None], sid[None, :]) >> shift)
                found[ids] += np.bincount(at.ravel(), minlength=len(ids) * bins).reshape(-1, bins)
        row, column = np.nonzero(found)
        yield pd.DataFrame({"resample": row, "bin": column, "n": found[row, column]})

    sids = blocks.rows.select("sid")
    hist = sids.mapInPandas(count, "resample int, bin int, n long").groupBy("resample", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("resample").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*[F.lit(int(b)) for b in bounds])
    located = (
        hist.withColumn("to", F.sum("n").over(upto)).select("*", F.posexplode(ranks).alias("cut", "rank"))
        .filter((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("n")))
        .select("resample", "bin", "cut", (F.col("rank") - F.col("to") + F.col("n")).alias("local"))
    ).toPandas()
    wanted = np.zeros((n, bins), dtype=bool)
    wanted[located["resample"], located["bin"]] = True

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sid, rows = pdf["sid"].to_numpy(), []
            for ids in D.slabs(n, len(sid)):
                row, column = np.nonzero(wanted[ids[:, None], D.high_word(code, ids[:, None], sid[None, :]) >> shift])
                draw = D.draw62(code, ids[row], sid[column])
                rows.append(pd.DataFrame({"resample": ids[row], "bin": draw >> (shift + D.LOW_BITS), "draw": draw}))
            yield pd.concat(rows)

    inside = Window.partitionBy("resample", "bin").orderBy("draw")
    ordered = sids.mapInPandas(fetch, "resample int, bin int, draw long").withColumn("local", F.row_number().over(inside))
    places = spark.createDataFrame(located.astype("int64"), "resample long, bin long, cut long, local long").select(
        *[F.col(c).cast("int").alias(c) for c in ("resample", "bin", "cut", "local")])
    return places.join(ordered, ["resample", "bin", "local"]).select("resample", "cut", F.col("draw").alias("threshold"))


def order_code(order: np.ndarray) -> np.ndarray:
    """One number for each order of the conditions on the last axis."""
    base = order.shape[-1]
    return (order * base ** np.arange(base)).sum(axis=-1)


def assignment(blocks: Blocks, seed: int, thresholds: np.ndarray, n_cond: int = 1) -> Assignment:
    """What finds the new groups and the condition orders of candidates, in any task."""
    code = stream(seed, PERMUTATION_STREAM)

    def at(ids: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        new = permuted_cells(code, ids, sid, thresholds)
        if n_cond == 1:
            return new, None
        return new, np.stack([permuted_conditions(seed, int(r), sid, n_cond) for r in ids])

    return at


def permutation_marks(blocks: Blocks, n: int, at: Assignment) -> DataFrame:
    """(resample, same, a, b, c): whether a candidate maps a group onto itself, and its signature.

    The signature sums numbers hashed from every subject with its group and conditions, so equal
    sequences have equal signatures."""
    sizes = blocks.sizes
    groups = len(sizes)

    def words(what: np.ndarray, sid: np.ndarray) -> list[np.ndarray]:
        return [D.draw62(101 + k, what, sid) >> 42 for k in range(3)]

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, 3 + groups), dtype=np.int64)  # sums of the whole task
        for pdf in frames:
            sid, group = pdf["sid"].to_numpy(), pdf["group"].to_numpy()
            # what a subject adds in each group; sums below 2**53 are exact
            adds = [np.stack([*words(np.array(g), sid), group == g], axis=1).astype(float) for g in range(groups)]
            for ids in D.slabs(n, len(sid)):
                new, order = at(ids, sid)
                for g in range(groups):
                    part = (new == g).astype(float) @ adds[g]
                    total[ids, 3 + g] += part[:, 3].astype(np.int64)
                    if order is None:
                        total[ids, :3] += part[:, :3].astype(np.int64)
                if order is not None:
                    what = new + groups * order_code(order)
                    total[ids, :3] += np.stack([w.sum(axis=1) for w in words(what, sid[None, :])], axis=1)
        yield pd.DataFrame({"resample": np.arange(n), **{c: total[:, k] for k, c in enumerate(names)}})

    names = [f"w{k}" for k in range(3)] + [f"g{g}" for g in range(groups)]
    counted = blocks.rows.select("sid", "group").mapInPandas(mark, "resample int, " + ", ".join(f"{c} long" for c in names))
    summed = counted.groupBy("resample").agg(*[F.sum(c).alias(c) for c in names])
    same = F.lit(False)
    for g, size in enumerate(sizes if groups > 1 else []):
        same = same | (F.col(f"g{g}") == size)
    return summed.select("resample", same.alias("same"), F.col("w0").alias("a"), F.col("w1").alias("b"), F.col("w2").alias("c"))


def permutation_ids(blocks: Blocks, n_perm: int, seed: int, n_cond: int = 1, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, thresholds) of the permutations to use, among candidates 0, 1, ...

    A candidate that maps a group onto itself or repeats an earlier one is passed over, and more are
    drawn while too few are left.  Where small groups have no more, those passed over are used after
    all, with a warning.  What the driver sees is a row per candidate."""
    groups = len(blocks.sizes)
    count = n_perm + max(10, n_perm // 20)
    for turn in range(rounds):
        cuts = threshold_array(permutation_cuts(blocks, count, seed), (count, groups - 1), ["resample"])
        if not n_perm or (groups == 1 and n_cond == 1):
            return np.arange(n_perm), cuts
        marks = permutation_marks(blocks, count, assignment(blocks, seed, cuts, n_cond)).toPandas().sort_values("resample")
        passed = marks["same"].to_numpy(bool) | marks.duplicated(["a", "b", "c"]).to_numpy()
        ids = marks["resample"].to_numpy()
        if (~passed).sum() >= n_perm or turn == rounds - 1:
            break
        count *= 2
    if (~passed).sum() < n_perm:
        warnings.warn(f"only {(~passed).sum()} of {n_perm} permutations mix the groups and differ", stacklevel=2)
    chosen = np.concatenate([ids[~passed], ids[passed]])[:n_perm]
    return chosen, cuts


def permutation_plan(blocks: Blocks, n_perm: int, seed: int, n_cond: int = 1) -> DataFrame:
    """(perm, sid, group, new_group), and with several conditions ``conditions``, the numbers of the
    conditions in their new order.  Subjects change groups, whose sizes stay; conditions change places
    within a subject."""
    ids, cuts = permutation_ids(blocks, n_perm, seed, n_cond)
    at = assignment(blocks, seed, cuts, n_cond)
    schema = "perm int, sid long, group int, new_group int" + (", conditions array<int>" if n_cond > 1 else "")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, group = (batch.column(c).to_numpy() for c in ("sid", "group"))
            for perms in D.slabs(len(ids), len(sid)):
                new, order = at(ids[perms], sid)
                out = {
                    "perm": np.repeat(perms.astype(np.int32), len(sid)), "sid": np.tile(sid, len(perms)),
                    "group": np.tile(group, len(perms)), "new_group": new.ravel().astype(np.int32),
                }
                if order is not None:
                    ends = np.arange(0, new.size * n_cond + 1, n_cond, dtype=np.int32)
                    out["conditions"] = pa.ListArray.from_arrays(ends, order.ravel().astype(np.int32))
                yield pa.RecordBatch.from_pydict(out)

    return blocks.rows.select("sid", "group").mapInArrow(plan, schema)


def bootstrap_slots(blocks: Blocks, n: int, seed: int) -> DataFrame:
    """(_group, _block, resample, slots): how many of the group's draws fall in each block."""
    sizes, per_group, block_size = blocks.sizes, blocks.blocks_per_group, blocks.block_size
    code = stream(seed, BLOCK_STREAM)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [None] * len(sizes)  # of the whole task: resamples x blocks of each group
        for pdf in frames:
            for group, part in pdf.groupby("group"):
                sid, n_blocks = part["sid"].to_numpy(), per_group[group]
                if total[group] is None:
                    total[group] = np.zeros((n, n_blocks), dtype=np.int64)
                for ids in D.slabs(n, len(sid)):
                    hit = D.draw62(code, ids[:, None], sid[None, :]) % sizes[group] // block_size
                    slots = np.bincount((np.arange(len(ids))[:, None] * n_blocks + hit).ravel(), minlength=len(ids) * n_blocks)
                    total[group][ids] += slots.reshape(-1, n_blocks)
        for group, slots in enumerate(total):
            if slots is not None:
                row, column = np.nonzero(slots)
                yield pd.DataFrame({"_group": group, "_block": column, "resample": row, "slots": slots[row, column]})

    counted = blocks.rows.select("sid", "group").mapInPandas(count, "_group int, _block int, resample int, slots long")
    return counted.groupBy("_group", "_block", "resample").agg(F.sum("slots").cast("int").alias("slots"))


def drawn_until(n: int, draw: Callable[[int], DataFrame], accept: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """``draw(count)`` for as many candidates as give ``n`` that ``accept`` keeps: (draws, kept(resample, place), count).

    ``accept`` numbers them by ``place`` and adds ``_bad`` to those it would rather not have, which come last.  A candidate's
    draws depend on its number alone, so more candidates change none of the earlier.  Where 2**rounds
    times as many do not give enough, the bad ones are used after all, with a warning."""
    spark = None
    count = n + max(10, n // 20)
    for turn in range(rounds):
        draws = draw(count).persist()
        spark = draws.sparkSession
        kept = accept(draws).toPandas().sort_values("place")  # a row per kept candidate
        bad = int(kept["_bad"].sum())
        if not bad or turn == rounds - 1:
            break
        draws.unpersist()
        count *= 2
    if bad:
        warnings.warn(f"{bad} of {n} resamples break the rules; the groups are too small", stacklevel=2)
    return draws, spark.createDataFrame([(int(r), i) for i, r in enumerate(kept["resample"])], "resample int, place int"), count


def block_multiplicities(
    seed: int, resamples: np.ndarray, slots: np.ndarray, n_blocks: int, block_number: int, size: int
) -> np.ndarray:
    """(resamples x samples of the block) bootstrap multiplicities."""
    out = np.zeros((len(resamples), size))
    code = stream(seed, IN_BLOCK_STREAM)
    for i, (r, c) in enumerate(zip(resamples, slots)):
        if c:
            drawn = D.draw62(code, np.array(int(r) * n_blocks + block_number), np.arange(int(c))) % size
            out[i] = np.bincount(drawn, minlength=size)
    return out


def _long(resamples: np.ndarray, cell: int, values: np.ndarray) -> pd.DataFrame:
    r, k = values.shape
    return pd.DataFrame(
        {
            "resample": np.repeat(resamples.astype(np.int32), k),
            "cell": np.full(r * k, cell, dtype=np.int32),
            "k": np.tile(np.arange(k, dtype=np.int32), r),
            "v": values.ravel(),
        }
    )


def _sum_cells(partials: DataFrame) -> DataFrame:
    return partials.groupBy("resample", "cell", "k").agg(F.sum("v").alias("v"))


def _stack(left: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    left = left.sort_values("sid")
    return left["sid"].to_numpy(), np.array(left["x"].tolist(), dtype=float).reshape(len(left), -1)


def products(z: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[1 | z | z_i z_j for the wanted pairs]."""
    i, j = pairs
    return np.hstack([np.ones((len(z), 1)), z, z[:, i] * z[:, j]])


NO_PAIRS = (np.zeros(0, dtype=int), np.zeros(0, dtype=int))
PAIR_BUDGET = 2_000_000  # numbers of one products() slice


def _pair_slices(n_samples: int, pairs) -> list[tuple[np.ndarray, np.ndarray]]:
    step = max(1, PAIR_BUDGET // max(1, n_samples))
    return [(pairs[0][s:s + step], pairs[1][s:s + step]) for s in range(0, len(pairs[0]), step)]


def weighted_moments(w: np.ndarray, z: np.ndarray, pairs) -> np.ndarray:
    """w @ products(z, pairs), built in slices of pairs."""
    parts = [w @ products(z, NO_PAIRS)]
    for i, j in _pair_slices(len(z), pairs):
        parts.append(w @ (z[:, i] * z[:, j]))
    return np.hstack(parts)


def signature(sid: np.ndarray) -> np.ndarray:
    """Three integers below 2**20 for each sample; their weighted sums identify a draw."""
    return np.stack([D.draw62(k, np.array(0), sid) >> 42 for k in range(3)], axis=1).astype(float)


MARKS = 4  # the number of distinct samples and the signature


@dataclass
class Prepare:
    """``numbers(kind(resample), z)`` replaces a block's numbers in a resample; few kinds serve many resamples."""

    kind: Callable[[int], tuple]
    numbers: Callable[[tuple, np.ndarray], np.ndarray]


def plain_sums(blocks: Blocks, pairs=NO_PAIRS) -> DataFrame:
    """Moments of the data themselves (resample -1), per group: k = 0 count, then sums, products."""

    def one(key, left: pd.DataFrame) -> pd.DataFrame:
        _, z = _stack(left)
        return _long(np.array([-1]), int(key[0]), weighted_moments(np.ones((1, len(z))), z, pairs))

    return _sum_cells(blocks.rows.groupBy("group", "block").applyInPandas(one, SUMS_SCHEMA))


def bootstrap_sums(
    blocks: Blocks, n: int, seed: int, pairs=NO_PAIRS, prepare: Prepare | None = None
) -> DataFrame:
    """Moments of each bootstrap candidate per group; the last ``MARKS`` k are the number of distinct samples
    and the signature.  ``prepare`` may replace the block's numbers per resample."""
    n_blocks, first, sizes = blocks.n_blocks, blocks.first_block, blocks.sizes
    chunks = blocks.chunks()

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        group, block, chunk = (int(v) for v in key)
        ids = np.arange(n)[chunk::chunks]
        if not len(left) or not len(ids):
            return pd.DataFrame({"resample": [], "cell": [], "k": [], "v": []})
        sid, z = _stack(left)
        by_id = dict(zip(right["resample"], right["slots"]))
        slots = np.array([by_id.get(int(r), 0) for r in ids])
        w = block_multiplicities(seed, ids, slots, n_blocks, first[group] + block, len(z))
        if prepare is None:
            moments = weighted_moments(w, z, pairs)
        else:
            kinds: dict[tuple, list[int]] = {}
            for i, r in enumerate(ids):
                kinds.setdefault(prepare.kind(int(r)), []).append(i)
            moments = np.empty((len(ids), 1 + prepare.numbers(next(iter(kinds)), z).shape[1] + len(pairs[0])))
            for kind, at in kinds.items():
                moments[at] = weighted_moments(w[at], prepare.numbers(kind, z), pairs)
        extra = np.column_stack([(w > 0).sum(axis=1), w @ signature(sid)])
        return _long(ids, group, np.hstack([moments, extra]))

    rows = fan_out(blocks.rows, chunks, "chunk").groupBy("group", "block", "chunk")
    slots = bootstrap_slots(blocks, n, seed).withColumn("_chunk", F.pmod("resample", F.lit(chunks)))
    return _sum_cells(rows.cogroup(slots.groupBy("_group", "_block", "_chunk")).applyInPandas(one, SUMS_SCHEMA))


def accepted_bootstraps(sums: DataFrame, sizes: Sequence[int], n_moments: int, n_boot: int, n_cond: int = 1) -> DataFrame:
    """(resample) of the first ``n_boot`` candidates whose groups all hold at least half as many
    distinct subjects as the smallest group has rows.  A repeat of an earlier draw of a group comes
    last, as small groups have no other draws; candidates with too few are ``_bad``."""
    minimum = int(np.ceil(min(sizes) * 0.5))
    distinct = sums.filter(F.col("k") == n_moments).groupBy("resample").agg(
        (F.min("v") < minimum).alias("_few")
    )
    first = Window.partitionBy("cell", *[f"_w{i}" for i in range(MARKS - 1)]).orderBy("resample")
    words = [F.max(F.when(F.col("k") == n_moments + 1 + i, F.col("v"))).alias(f"_w{i}") for i in range(MARKS - 1)]
    repeats = (
        sums.filter(F.col("k") > n_moments).groupBy("resample", "cell").agg(*words)
        .withColumn("_i", F.row_number().over(first))
        .groupBy("resample").agg((F.max("_i") > 1).alias("_repeat"))
    )
    order = Window.orderBy("_few", "_repeat", "resample")  # one row per candidate
    return (
        distinct.join(repeats, "resample")
        .withColumn("place", F.row_number().over(order) - 1)
        .filter(F.col("place") < n_boot)
        .select("resample", "place", F.col("_few").alias("_bad"))
    )


def bootstrap_plan(blocks: Blocks, n: int, seed: int) -> DataFrame:
    """(resample, sid, group, weight) with positive weights: the multiplicities themselves.

    Resamples are numbered from 0 in the order of ``accepted_bootstraps``: candidates with too few distinct
    subjects in a group are left out, and those that repeat a group's draw come last."""
    n_blocks, first, sizes = blocks.n_blocks, blocks.first_block, blocks.sizes
    schema = "resample int, sid long, group int, weight int"
    bare = Blocks(blocks.rows.withColumn("x", F.array().cast("array<double>")), sizes, blocks.block_size)
    marks, kept, count = drawn_until(n, lambda c: bootstrap_sums(bare, c, seed), lambda s: accepted_bootstraps(s, sizes, 1, n))
    marks.unpersist()
    ids = np.array([r["resample"] for r in kept.orderBy("place").collect()], dtype=int)

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        group, block = (int(v) for v in key)
        if not len(left):
            return pd.DataFrame({"resample": [], "sid": [], "group": [], "weight": []})
        sid = np.sort(left["sid"].to_numpy())
        by_id = dict(zip(right["resample"], right["slots"]))
        slots = np.array([by_id.get(int(r), 0) for r in ids])
        w = block_multiplicities(seed, ids, slots, n_blocks, first[group] + block, len(sid))
        r, s = np.nonzero(w)
        return pd.DataFrame({"resample": r, "sid": sid[s], "group": group, "weight": w[r, s].astype(int)})

    slots = bootstrap_slots(blocks, count, seed)
    return (
        blocks.rows.select("group", "block", "sid").groupBy("group", "block")
        .cogroup(slots.groupBy("_group", "_block")).applyInPandas(one, schema)
    )


def threshold_array(cuts: DataFrame, shape: Sequence[int], keys: Sequence[str]) -> np.ndarray:
    """Thresholds as an array indexed by (keys..., cut).  Their number is resamples x groups: it is set
    by parameters and does not grow with the data."""
    out = np.full(tuple(shape), np.iinfo(np.int64).max, dtype=np.int64)
    for row in cuts.select(*keys, "cut", "threshold").collect():
        out[tuple(row[:-1])] = row[-1]
    return out


def permuted_cells(code: int, resamples: np.ndarray, sid: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(resamples x samples) new group numbers."""
    limits = thresholds[resamples]
    new = np.zeros((len(resamples), len(sid)), dtype=np.uint8 if limits.shape[1] < 256 else np.int64)
    tops = np.minimum(limits >> D.LOW_BITS, (1 << 32) - 1).astype(np.uint32)
    for at in D.slabs(len(resamples), len(sid)):
        high = D.high_word(code, resamples[at][:, None], sid[None, :])
        for c in range(limits.shape[1]):
            top = tops[at, c][:, None]
            new[at] += high > top
            row, column = np.nonzero(high == top)  # the rest of the draw decides
            new[at[row], column] += D.draw62(code, resamples[at[row]], sid[column]) > limits[at[row], c]
    return new


def permuted_conditions(seed: int, resample: int, sid: np.ndarray, n_cond: int) -> np.ndarray:
    """(samples x conditions) order of the conditions inside each subject."""
    code = stream(seed, CONDITION_STREAM)
    drawn = D.draw62(code, np.array(resample), sid[:, None] * n_cond + np.arange(n_cond)[None, :])
    return np.argsort(drawn, axis=1, kind="stable")


def in_order(z: np.ndarray, order: np.ndarray, n_cond: int) -> np.ndarray:
    """The condition blocks of each sample's numbers in a new order."""
    cube = z.reshape(len(z), n_cond, -1)
    return np.take_along_axis(cube, order[:, :, None], axis=1).reshape(len(z), -1)


def permutation_sums(blocks: Blocks, ids: np.ndarray, seed: int, thresholds: np.ndarray, n_cond: int = 1) -> DataFrame:
    """First moments per new group for the candidates ``ids``, as resamples 0, 1, ..."""
    chunks, groups = blocks.chunks(), len(blocks.sizes)
    at = assignment(blocks, seed, thresholds, n_cond)

    def one(key, left: pd.DataFrame) -> pd.DataFrame:
        _, _, chunk = (int(v) for v in key)
        own = np.arange(len(ids))[chunk::chunks]
        sid, z = _stack(left)
        new, order = at(ids[own], sid)
        frames = []
        shuffled = None if order is None else [in_order(z, o, n_cond) for o in order]
        for g in range(groups):
            mask = (new == g).astype(float)
            if shuffled is None:
                moments = weighted_moments(mask, z, NO_PAIRS)
            else:
                moments = np.vstack([weighted_moments(mask[i:i + 1], zr, NO_PAIRS) for i, zr in enumerate(shuffled)])
            frames.append(_long(own, g, moments))
        return pd.concat(frames)

    rows = fan_out(blocks.rows, chunks, "chunk").groupBy("group", "block", "chunk")
    return _sum_cells(rows.applyInPandas(one, SUMS_SCHEMA))


# ------------------------------------------------------------------ paired permutations
def paired_ids(blocks: Blocks, n_perm: int, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """(perm, sid, to): the sample ``sid`` goes to the place of ``to``; perm 0 .. n_perm - 1.

    The rules are those of ``permutation_ids``.  This is the one resampler that shuffles samples x
    permutations, as rows of three numbers; ``paired_sums`` does without."""
    base = blocks.rows.select(F.col("sid").alias("to"), F.col("group").alias("to_group"))
    size = F.array(*[F.lit(int(n)).cast("long") for n in blocks.sizes])
    count = n_perm + max(10, n_perm // 20)
    for turn in range(rounds):
        moved = with_rank(permutation_draws(blocks, count, seed), ["resample"], F.col("draw"), [F.col("draw")], name="to")
        moved = moved.select("resample", "sid", "group", (F.col("to") - 1).alias("to")).persist()
        inside = moved.join(base, "to").groupBy("resample", "group").agg(
            F.count_if(F.col("group") == F.col("to_group")).alias("n"), F.bit_xor(F.xxhash64("sid", "to")).alias("word"))
        marks = inside.groupBy("resample").agg(
            F.max(F.col("n") == F.get(size, F.col("group"))).alias("same"), F.bit_xor("word").alias("word")).toPandas().sort_values("resample")
        passed = marks.duplicated(["word"]).to_numpy()
        if len(blocks.sizes) > 1:
            passed |= marks["same"].to_numpy(bool)
        ids = marks["resample"].to_numpy()
        if (~passed).sum() >= n_perm or turn == rounds - 1:
            break
        moved.unpersist()
        count *= 2
    if (~passed).sum() < n_perm:
        warnings.warn(f"only {(~passed).sum()} of {n_perm} permutations mix the groups and differ", stacklevel=2)
    chosen = np.concatenate([ids[~passed], ids[passed]])[:n_perm]
    table = blocks.rows.sparkSession.createDataFrame([(int(r), i) for i, r in enumerate(chosen)], "resample int, perm int")
    return moved.join(F.broadcast(table), "resample").select("perm", "sid", "to")  # a row a permutation is broadcast


def with_permuted(blocks: Blocks, n_perm: int, seed: int, n_x: int) -> DataFrame:
    """``blocks.rows`` with ``py``, the y parts of ``x = [x | y]`` that each permutation brings to the sample.

    Only y parts move; an array holds one for each permutation."""
    y = blocks.rows.select("sid", F.slice("x", n_x + 1, F.size("x")).alias("y"))
    moved = paired_ids(blocks, n_perm, seed).join(y, "sid")
    gathered = moved.groupBy(F.col("to").alias("sid")).agg(F.array_sort(F.collect_list(F.struct("perm", "y"))).alias("py"))
    return blocks.rows.join(gathered.select("sid", F.flatten("py.y").alias("py")), "sid")


PLACE_NUMBERS = 1 << 22  # numbers of x that a task of ``paired_sums`` holds


def packed_blocks(blocks: Blocks, n_x: int) -> DataFrame:
    """(number, sid, x, y): a row per block, its samples' numbers as doubles."""
    first = blocks.first_block

    def pack(key, left: pd.DataFrame) -> pd.DataFrame:
        sid, z = _stack(left)
        return pd.DataFrame([(first[int(key[0])] + int(key[1]), sid.astype("<i8").tobytes(), z[:, :n_x].tobytes(), z[:, n_x:].tobytes())], columns=["number", "sid", "x", "y"])

    return blocks.rows.groupBy("group", "block").applyInPandas(pack, "number int, sid binary, x binary, y binary")


def draw_part(high: np.ndarray, parts: int) -> np.ndarray:
    """Which of equal ranges of the leading words a draw is in."""
    return (high.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)


def part_starts(packed: DataFrame, n: int, code: int, parts: int) -> np.ndarray:
    """(permutations x parts + 1) ranks at which the ranges of the draws begin: parameters, not samples."""
    starts = np.zeros((n, parts + 1), dtype=np.int64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros((n, parts), dtype=np.int64)
        for pdf in frames:
            for sid in pdf["sid"]:
                sid = np.frombuffer(sid, dtype="<i8")
                for ids in D.slabs(n, len(sid)):
                    at = np.arange(len(ids))[:, None] * parts + draw_part(D.high_word(code, ids[:, None], sid[None, :]), parts).astype(np.int64)
                    found[ids] += np.bincount(at.ravel(), minlength=len(ids) * parts).reshape(-1, parts)
        row, column = np.nonzero(found)
        yield pd.DataFrame({"resample": row, "part": column, "n": found[row, column]})

    hist = packed.select("sid").mapInPandas(count, "resample int, part int, n long").groupBy("resample", "part").agg(F.sum("n").alias("n")).toPandas()
    starts[hist["resample"], hist["part"] + 1] = hist["n"]
    return starts.cumsum(axis=1)


def candidate_sums(blocks: Blocks, packed: DataFrame, n: int, seed: int, n_x: int, n_y: int, pairs) -> DataFrame:
    """Sums per candidate and group of the y parts at their places and of ``pairs``, then ``MARKS`` more: how
    many samples stay in the group, and words that identify the candidate.

    A task holds the y parts of all samples and the x of the places in one range of the draws."""
    sizes, starts = np.array(blocks.sizes), np.array(blocks.starts)
    code, total = stream(seed, PERMUTATION_STREAM), int(sizes.sum())
    slots = blocks.rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-total * n_x // PLACE_NUMBERS))
    chunks = min(n, max(1, -(-4 * slots // parts)))
    ranks = part_starts(packed, n, code, parts) if parts > 1 else np.tile([0, total], (n, 1))
    low, high = ranks[:, :-1].min(axis=0), ranks[:, 1:].max(axis=0)
    ends = np.concatenate([[start + min(size, (b + 1) * blocks.block_size) for b in range(k)] for start, size, k in zip(starts, sizes, blocks.blocks_per_group)])
    begins = np.concatenate([[0], ends[:-1]])
    reach = [(i, p) for p in range(parts) for i in np.flatnonzero((begins < high[p]) & (ends > low[p])).tolist()]
    mixed = pairs[0] < n_x

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part, chunk = (int(v) for v in key)
        ids = np.arange(n)[chunk::chunks]
        if not len(left) or not len(right) or not len(ids):
            return pd.DataFrame({"resample": [], "cell": [], "k": [], "v": []})
        place = np.concatenate([np.frombuffer(v, dtype="<i8") for v in left["sid"]])
        base = place.min()
        x = np.zeros((place.max() + 1 - base, n_x))
        x[place - base] = np.concatenate([np.frombuffer(v, dtype=float) for v in left["x"]]).reshape(-1, n_x)
        sid = np.concatenate([np.frombuffer(v, dtype="<i8") for v in right["_sid"]])
        y = np.concatenate([np.frombuffer(v, dtype=float) for v in right["_y"]]).reshape(-1, n_y)
        group = np.searchsorted(starts, sid, side="right") - 1
        found = np.zeros((len(sizes), len(ids), n_y + len(pairs[0]) + MARKS))
        for i, r in enumerate(ids):
            inside = np.concatenate([a + np.flatnonzero(draw_part(D.high_word(code, np.array(r), sid[a:a + D.SLAB]), parts) == part) for a in range(0, len(sid), D.SLAB)])
            order = inside[np.argsort(D.draw62(code, np.array(r), sid[inside]))]
            first = ranks[r, part] - base
            moved = np.zeros((len(x), n_y))
            moved[first:first + len(order)] = y[order]
            word = D.draw62(101, np.arange(len(order)) + ranks[r, part], sid[order])
            for g, (a, b) in enumerate(zip(starts - base, starts + sizes - base)):
                a, b = max(a, first), min(b, first + len(order))
                if a < b:
                    own, of = moved[a:b], slice(a - first, b - first)
                    cross, square = x[a:b].T @ own, own.T @ own
                    products = [cross[k, l - n_x] if m else square[k - n_x, l - n_x] for k, l, m in zip(*pairs, mixed)]
                    marks = [(group[order[of]] == g).sum(), *[((word[of] >> shift) & 0xFFFFF).sum() for shift in (0, 20, 40)]]
                    found[g, i] = np.concatenate([own.sum(axis=0), products, marks])
        return pd.concat([_long(ids, g, v) for g, v in enumerate(found)])

    near = packed.select("number", "sid", "x").join(F.broadcast(blocks.rows.sparkSession.createDataFrame(reach, "number int, part int")), "number")
    tasks = parts * chunks  # few bytes, much work
    near = fan_out(near, chunks, "chunk").repartition(tasks, "part", "chunk")
    far = fan_out(fan_out(packed.select(F.col("sid").alias("_sid"), F.col("y").alias("_y")), parts, "_part"), chunks, "_chunk").repartition(tasks, "_part", "_chunk")
    return _sum_cells(near.groupBy("part", "chunk").cogroup(far.groupBy("_part", "_chunk")).applyInPandas(one, SUMS_SCHEMA))


def paired_sums(blocks: Blocks, n_perm: int, seed: int, n_x: int, n_y: int, pairs, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Moments per permutation and group that depend on the y parts, and their places among all moments.

    The permutations are those of ``paired_ids``: samples go to the places of their draws' ranks.  Moments of
    x alone are those of the data.  What the driver sees is a few numbers per candidate and group."""
    spark = blocks.rows.sparkSession
    of_y = np.flatnonzero((pairs[0] >= n_x) | (pairs[1] >= n_x))
    own = (pairs[0][of_y], pairs[1][of_y])
    width = n_y + len(of_y)
    packed = packed_blocks(blocks, n_x).persist()
    count = n_perm + max(10, n_perm // 20)
    for turn in range(rounds):
        sums = candidate_sums(blocks, packed, count, seed, n_x, n_y, own).persist()
        marks = sums.filter(F.col("k") >= width).toPandas().pivot(index=["resample", "cell"], columns="k", values="v").reset_index()
        marks["same"] = marks[width].to_numpy() == np.array(blocks.sizes)[marks["cell"]]
        per = marks.groupby("resample").agg({"same": "max", **{width + k: "sum" for k in range(1, MARKS)}})
        passed = per.duplicated([width + k for k in range(1, MARKS)]).to_numpy()
        if len(blocks.sizes) > 1:
            passed |= per["same"].to_numpy(bool)
        if (~passed).sum() >= n_perm or turn == rounds - 1:
            break
        sums.unpersist()
        count *= 2
    if (~passed).sum() < n_perm:
        warnings.warn(f"only {(~passed).sum()} of {n_perm} permutations mix the groups and differ", stacklevel=2)
    ids = per.index.to_numpy()
    chosen = np.concatenate([ids[~passed], ids[passed]])[:n_perm]
    table = spark.createDataFrame([(int(r), i) for i, r in enumerate(chosen)], "resample int, perm int")
    kept = sums.filter(F.col("k") < width).join(F.broadcast(table), "resample")
    return kept.select(F.col("perm").alias("resample"), "cell", "k", "v"), of_y


def moments_with(observed: np.ndarray, drawn: np.ndarray, n_x: int, of_y: np.ndarray) -> np.ndarray:
    """All moments of a paired permutation, from those of the data and the drawn ones of the y parts."""
    n_y = drawn.shape[1] - len(of_y)
    out = observed.copy()
    out[:, 1 + n_x:1 + n_x + n_y] = drawn[:, :n_y]
    out[:, 1 + n_x + n_y + of_y] = drawn[:, n_y:]
    return out


# ------------------------------------------------------------------ halves of permuted samples
def half_shares(counts: np.ndarray, halves: np.ndarray, seed: int, family: int) -> np.ndarray:
    """(blocks x splits x groups): how many of a block's samples in a group are in the first half.

    ``counts`` (blocks x groups) are the samples there, ``halves`` (splits x groups) the sizes of the
    first halves: hypergeometric draws, as if whole groups were halved at random."""
    rng = np.random.default_rng([seed, HALF_STREAM, family])
    out = np.zeros((len(counts), *halves.shape), dtype=np.int32)
    for g in range(halves.shape[1]):
        for size in np.unique(halves[:, g]):
            which = np.flatnonzero(halves[:, g] == size)
            out[:, which, g] = rng.multivariate_hypergeometric(counts[:, g], int(size), len(which), method="marginals").T
    return out


def half_moments(code: int, family: int, sid: np.ndarray, new: np.ndarray, shares: np.ndarray, full: np.ndarray) -> np.ndarray:
    """(1 + splits x groups x moments) sums over all samples of a block and over each first half, in each
    group those of the smallest draws.  The leading words of the draws order them; ties take whole draws."""
    n_split, groups = shares.shape
    order = np.argsort(new, kind="stable")
    ends = np.searchsorted(new[order], np.arange(groups + 1))
    sid, full = sid[order], full[order]
    splits = np.arange(n_split)
    ids = family * n_split + splits
    out = np.zeros((1 + n_split, groups, full.shape[1]))
    for g in range(groups):
        own, numbers, k = sid[ends[g]:ends[g + 1]], full[ends[g]:ends[g + 1]], shares[:, g]
        if not len(own):
            continue
        drawn = D.high_word(code, ids[:, None], own[None, :])
        ranked = np.sort(drawn, axis=1)
        last = ranked[splits, np.maximum(k, 1) - 1]
        mask = drawn <= last[:, None]
        mask[k == 0] = False
        for s in np.flatnonzero((k > 0) & (k < len(own)) & (ranked[splits, np.minimum(k, len(own) - 1)] == last)):
            whole = D.draw62(code, ids[s], own)
            mask[s] = whole <= np.partition(whole, k[s] - 1)[k[s] - 1]
        out[0, g] = numbers.sum(axis=0)
        out[1:, g] = mask.astype(float) @ numbers
    return out


HALF_BUNDLES = 16  # groups of blocks whose sums are shuffled, whatever the number of samples
BUNDLE_NUMBERS = 1 << 23  # most numbers of the samples of a bundle


def half_sums(
    blocks: Blocks, rows: DataFrame, n: int, n_split: int, seed: int, at: Callable, moments: Callable, width: int, slab: int = SLAB
) -> DataFrame:
    """(perm, slab, v): packed moments of the families 0 .. n - 1 of halves, summed over all blocks.

    ``at(families, sid, group)`` gives the (families x samples) groups of a block and ``moments(left)`` what
    gives a family's (samples x moments) numbers.  A row holds, for ``slab`` splits, the moments per group of all
    samples and then of each first half.  Which samples a block gives to a half needs only the
    block counts of its family; no sample meets another, and no cut point reaches the driver.  Tasks sum
    over a bundle of blocks, whose samples have ``width`` numbers each, before anything is shuffled."""
    groups, slots = len(blocks.sizes), blocks.rows.sparkSession.sparkContext.defaultParallelism
    most = max(1, BUNDLE_NUMBERS // (blocks.block_size * width))
    bundle = min(most, -(-blocks.n_blocks // HALF_BUNDLES))
    chunks = min(n, max(1, -(-16 * slots // -(-blocks.n_blocks // bundle))))
    first = F.array(*[F.lit(b) for b in blocks.first_block])
    halves = split_sizes(blocks.sizes, n_split, seed, 0.5)
    code = stream(seed, SPLIT_STREAM)
    numbered = rows.withColumn("number", (F.get(first, F.col("group")) + F.col("block")).cast("int"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for number, part in pdf.groupby("number"):
                sid, group = part["sid"].to_numpy(), int(part["group"].iloc[0])
                found = np.zeros((n, groups), dtype=np.int64)
                for ids in D.slabs(n, len(sid)):
                    cells = np.arange(len(ids))[:, None] * groups + at(ids, sid, group)
                    found[ids] = np.bincount(cells.ravel(), minlength=len(ids) * groups).reshape(-1, groups)
                yield pd.DataFrame({"perm": np.repeat(np.arange(n), groups), "number": number, "g": np.tile(np.arange(groups), n), "n": found.ravel()})

    counts = numbered.select("number", "sid", "group").mapInPandas(count, "perm int, number int, g int, n long")
    counts = counts.groupBy("perm", "number", "g").agg(F.sum("n").alias("n"))

    def share(key, pdf: pd.DataFrame) -> pd.DataFrame:
        perm = int(key[0])
        numbers, at_number = np.unique(pdf["number"], return_inverse=True)
        table = np.zeros((len(numbers), groups), dtype=np.int64)
        table[at_number, pdf["g"]] = pdf["n"]
        found = half_shares(table, halves, seed, perm)
        return pd.DataFrame({"_bundle": numbers // bundle, "_chunk": perm % chunks, "number": numbers, "perm": perm, "shares": [v.astype("<i4").tobytes() for v in found]})

    shares = counts.groupBy("perm").applyInPandas(share, "_bundle int, _chunk int, number int, perm int, shares binary")

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"perm": [], "slab": [], "v": []})
        own = {}
        for number, part in left.groupby("number"):
            part = part.sort_values("sid")
            own[number] = part["sid"].to_numpy(), int(part["group"].iloc[0]), moments(part)
        out = []
        for perm, parts in right.groupby("perm"):
            total = 0
            for number, packed in zip(parts["number"], parts["shares"]):
                sid, group, numbers = own[number]
                share = np.frombuffer(packed, dtype="<i4").reshape(n_split, groups)
                total = total + half_moments(code, perm, sid, at(np.array([perm]), sid, group)[0], share, numbers(perm))
            for s in range(0, n_split, slab):
                out.append((perm, s // slab, np.concatenate([total[:1], total[1 + s:1 + s + slab]]).astype("<f8").tobytes()))
        return pd.DataFrame(out, columns=["perm", "slab", "v"])

    dealt = fan_out(numbered.withColumn("bundle", F.floor(F.col("number") / F.lit(bundle)).cast("int")), chunks, "chunk")
    tasks = chunks * -(-blocks.n_blocks // bundle)  # few bytes, much work: by their bytes they would be few tasks
    dealt, shares = dealt.repartition(tasks, "bundle", "chunk"), shares.repartition(tasks, "_bundle", "_chunk")
    packed = dealt.groupBy("bundle", "chunk").cogroup(shares.groupBy("_bundle", "_chunk")).applyInPandas(one, "perm int, slab int, v binary")

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for pdf in frames:
            for perm, part, v in zip(pdf["perm"].tolist(), pdf["slab"].tolist(), pdf["v"].tolist()):
                new = np.frombuffer(v, dtype="<f8")
                held[perm, part] = held[perm, part] + new if (perm, part) in held else new
            if len(held) > 2000:
                yield pd.DataFrame([(*k, v.tobytes()) for k, v in held.items()], columns=["perm", "slab", "v"])
                held = {}
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in held.items()], columns=["perm", "slab", "v"])

    met = packed.mapInPandas(add, "perm int, slab int, v binary").groupBy("perm", "slab")
    return met.applyInPandas(lambda pdf: pdf.iloc[:1].assign(v=[sum(np.frombuffer(v, dtype="<f8") for v in pdf["v"]).tobytes()]), "perm int, slab int, v binary")


# ------------------------------------------------------------------ stratified splits
def split_sizes(sizes: Sequence[int], n_split: int, seed: int, test_size: float) -> np.ndarray:
    """(splits x groups) sizes of the first part: ceil or floor of (1 - test_size) n at random."""
    exact = np.asarray(sizes, dtype=float)[None, :] * (1.0 - test_size)
    coin = D.draw62(stream(seed, SPLIT_STREAM + 1), np.arange(n_split)[:, None], np.arange(len(sizes))[None, :])
    up = (coin >> 40) % 2 == 0
    return np.where(up, np.ceil(np.round(exact, 9)), np.floor(np.round(exact, 9))).astype(int)


def split_draws(assigned: DataFrame, n_split: int, seed: int) -> DataFrame:
    """``assigned(perm, sid, group)`` fanned out over splits, with a draw per sample."""
    family = F.col("perm").cast("long") * F.lit(n_split) + F.col("split")
    return fan_out(assigned, n_split, "split").withColumn(
        "draw", draw62(stream(seed, SPLIT_STREAM), family, F.col("sid"))
    )


def split_cuts(assigned: DataFrame, n_assigned: int, sizes: Sequence[int], n_split: int, seed: int, test_size: float) -> DataFrame:
    """(perm, split, group, cut, threshold) of the first part of each stratified split."""
    spark = assigned.sparkSession
    counts = split_sizes(sizes, n_split, seed, test_size)
    table = [(s, g, 0, int(counts[s, g])) for s in range(n_split) for g in range(len(sizes)) if counts[s, g] > 0]
    cuts = fan_out(spark.createDataFrame(table, "split int, group int, cut int, rank long"), n_assigned, "perm")
    return cut_points(split_draws(assigned, n_split, seed), ["perm", "split", "group"], cuts, bins=64)


def split_plan(blocks: Blocks, n_split: int, seed: int, test_size: float = 0.5) -> DataFrame:
    """(split, sid, group, first): membership of the first part, exact sizes per group."""
    rows = blocks.rows.select(F.lit(0).alias("perm"), "sid", "group")
    cuts = split_cuts(rows, 1, blocks.sizes, n_split, seed, test_size)
    return split_draws(rows, n_split, seed).join(
        cuts.select("perm", "split", "group", "threshold"), ["perm", "split", "group"], "left"
    ).select("split", "sid", "group", F.coalesce(F.col("draw") <= F.col("threshold"), F.lit(False)).alias("first"))
