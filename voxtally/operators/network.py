"""Correlation networks between structures.

Pairwise-complete correlations come from six kinds of products (counts, sums, squares and cross
products over the subjects that have both).  The structures are cut into tiles; a pair block is two
tiles, and its products are packed matrices keyed by (resample, pair block).  A task holds one pair
block of some subjects at a time, and correlations and bootstrap counts are finished per block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.columns import number
from voxtally.functions.special import t_pvalue
from voxtally.operators import resample as RS
from voxtally.operators.resample import Blocks
from voxtally.operators.stats import Matrix, adjust_pvalues
from voxtally.session import ensure_checkpoint_dir

PAIR_SCHEMA = "i int, j int, n double, r double"
PACKED = "resample int, pair int, v binary"
TILE = 32  # structures of one tile: a packed block is 6 x 32 x 32 numbers
WAYS = 16  # parts in which a block's bootstrap counts are added up first


def network_blocks(rows: DataFrame, n_rows: int, width: int, block_size: int = RS.BLOCK_SIZE) -> Blocks:
    """``rows(animal_id, x)`` as one group; values are centred first so that products stay small, and a
    missing value is NaN."""
    means = [
        F.avg(F.get("x", F.lit(k))).alias(f"m{k}") for k in range(width)
    ]
    first = rows.agg(*means).collect()[0]  # one number per structure
    shifts = F.array(*[number(0.0 if v is None else v) for v in first])
    shifted = F.zip_with("x", shifts, lambda v, m: F.coalesce(v - m, F.lit(float("nan"))))
    return RS.make_blocks(rows.select("animal_id", F.lit(0).alias("group"), shifted.alias("x")), [n_rows], block_size)


def tile_pairs(width: int, tile: int = TILE) -> list[tuple[int, int]]:
    """The first structures of both tiles of each pair block."""
    starts = range(0, width, tile)
    return [(a, b) for a in starts for b in starts if a <= b]


def block_products(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(resamples x 6 x tile x tile): weighted n, sum x, sum y, sum xx, sum yy, sum xy of the complete pairs."""
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(has_x, x, 0.0), np.where(has_y, y, 0.0)
    left = [has_x.astype(float), x, has_x.astype(float), x * x, has_x.astype(float), x]
    right = [has_y.astype(float), has_y.astype(float), y, has_y.astype(float), y * y, y]
    out = np.empty((len(w), 6, x.shape[1], y.shape[1]))
    step = max(1, RS.PAIR_BUDGET // max(1, y.size))  # structures of x whose products are held at once
    for k, (a, b) in enumerate(zip(left, right)):
        for i in range(0, x.shape[1], step):
            each = (a[:, i:i + step, None] * b[:, None, :]).reshape(len(x), -1)
            out[:, k, i:i + step] = (w @ each).reshape(len(w), -1, y.shape[1])
    return out


def block_correlations(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts and correlations of one packed block; NaN where a side is constant."""
    n, sx, sy, sxx, syy, sxy = products
    with np.errstate(all="ignore"):
        vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
        scale = np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
        floor = 1e-12 * np.sqrt(np.maximum(sxx * syy, 1e-300))
        r = np.where(scale > floor, c / scale, np.nan)
    return n, np.clip(r, -1.0, 1.0)


def pair_sums(blocks: Blocks, width: int, n_boot: int = 0, seed: int = 0, tile: int = TILE) -> DataFrame:
    """(resample, pair, v): the packed products of every pair block, of the data (resample -1) or of
    ``n_boot`` bootstraps of the subjects.  Only the two tiles of a block travel with it."""
    pairs = tile_pairs(width, tile)
    chunks, n_blocks = (blocks.chunks() if n_boot else 1), blocks.n_blocks
    tiles = F.array(*[F.struct(F.lit(k).alias("pair"), F.slice("x", a + 1, tile).alias("xi"), F.slice("x", b + 1, tile).alias("xj")) for k, (a, b) in enumerate(pairs)])
    rows = RS.fan_out(blocks.rows.select("sid", "block", F.inline(tiles)), chunks, "chunk").groupBy("pair", "block", "chunk")

    def matrices(left: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        left = left.sort_values("sid")
        return tuple(np.array(left[c].tolist(), dtype=float).reshape(len(left), -1) for c in ("xi", "xj"))

    def packed(ids: np.ndarray, pair: int, products: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"resample": ids, "pair": pair, "v": [p.astype("<f8").tobytes() for p in products]})

    if not n_boot:
        def plain(key, left: pd.DataFrame) -> pd.DataFrame:
            x, y = matrices(left)
            return packed(np.array([-1]), int(key[0]), block_products(np.ones((1, len(x))), x, y))

        parts = rows.applyInPandas(plain, PACKED)
    else:
        def drawn(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            pair, block, chunk = (int(v) for v in key)
            ids = np.arange(n_boot)[chunk::chunks]
            if not len(left) or not len(ids):
                return pd.DataFrame({"resample": [], "pair": [], "v": []})
            x, y = matrices(left)
            by_id = dict(zip(right["resample"], right["slots"]))
            slots = np.array([by_id.get(int(r), 0) for r in ids])
            w = RS.block_multiplicities(seed, ids, slots, n_blocks, block, len(x))
            return packed(ids, pair, block_products(w, x, y))

        slots = RS.bootstrap_slots(blocks, n_boot, seed).withColumn("_chunk", F.pmod("resample", F.lit(chunks)))
        slots = slots.withColumn("_pair", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))))
        parts = rows.cogroup(slots.groupBy("_pair", "_block", "_chunk")).applyInPandas(drawn, PACKED)
    if n_blocks == 1:
        return parts
    add = lambda pdf: pdf.iloc[:1].assign(v=[sum(np.frombuffer(v, dtype="<f8") for v in pdf["v"]).tobytes()])
    return parts.groupBy("resample", "pair").applyInPandas(add, PACKED)


def _unpacked(packed: bytes, a: int, b: int, width: int, tile: int) -> np.ndarray:
    return np.frombuffer(packed, dtype="<f8").reshape(6, min(tile, width - a), min(tile, width - b))


def correlation(blocks: Blocks, width: int, min_periods: int = 3, tile: int = TILE) -> DataFrame:
    """(i, j, n, r) for i < j: pairwise complete Pearson, NULL under ``min_periods`` or when
    a structure is constant."""
    starts = tile_pairs(width, tile)

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for pair, packed in zip(pdf["pair"].tolist(), pdf["v"].tolist()):
                a, b = starts[pair]
                n, r = block_correlations(_unpacked(packed, a, b, width, tile))
                i, j = np.indices(n.shape)
                keep = (i + a) < (j + b)
                yield pd.DataFrame({"i": (i + a)[keep], "j": (j + b)[keep], "n": n[keep], "r": np.where(n >= min_periods, r, np.nan)[keep]})

    pairs = pair_sums(blocks, width, tile=tile).mapInPandas(finish, PAIR_SCHEMA)
    return pairs.select("i", "j", F.col("n").cast("long").alias("n"), F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def edge_pvalues(pairs: DataFrame, n_rows: int, method: str | None = "fdr_bh") -> DataFrame:
    """Edges are the pairs with a non-zero correlation; t from r with df of *all* rows; adds p and
    pvalue (corrected).  r = +-1 has p = 0."""
    df = float(n_rows - 2)
    r = F.col("r")
    t = F.try_divide(r * number(np.sqrt(max(df, 0.0))), F.sqrt(number(1) - r * r))
    edges = pairs.filter(r.isNotNull() & (r != 0))
    with_p = edges.withColumn(
        "p", F.when(F.abs(r) >= 1, number(0)).otherwise(t_pvalue(t, number(df)))
    )
    return adjust_pvalues(with_p, "p", (), method, out="pvalue").drop("reject")


def edge_bootstrap(
    blocks: Blocks, width: int, observed: DataFrame, n_boot: int, seed: int, method: str | None = "fdr_bh", tile: int = TILE
) -> DataFrame:
    """(i, j, exceed, null_p, null_pvalue): share of row bootstraps with a strictly larger
    absolute correlation, corrected over all pairs.  A pair without correlation counts as 0."""
    starts = tile_pairs(width, tile)
    # each block's observed correlations, in the order of its matrix
    place = F.lit(0)
    for k, (a, b) in enumerate(starts):
        inside = F.col("i").between(a, a + tile - 1) & F.col("j").between(b, b + tile - 1)
        place = F.when(inside, k).otherwise(place)
    known = observed.select("i", "j", F.coalesce("r", number(0)).alias("r"), place.alias("pair"))
    known = known.groupBy("pair").agg(F.collect_list(F.struct("i", "j", "r")).alias("known"))  # at most a block
    sums = pair_sums(blocks, width, n_boot, seed, tile).join(known, "pair").withColumn("way", F.pmod("resample", F.lit(WAYS)))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for pair, way, packed, rows in zip(pdf["pair"].tolist(), pdf["way"].tolist(), pdf["v"].tolist(), pdf["known"].tolist()):
                a, b = starts[pair]
                _, r = block_correlations(_unpacked(packed, a, b, width, tile))
                limit = np.full(r.shape, np.inf)
                for row in rows:
                    limit[row["i"] - a, row["j"] - b] = abs(row["r"])
                out.append((pair, way, 1, (np.abs(np.nan_to_num(r)) > limit).astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["pair", "way", "n", "v"])

    counted = sums.select("pair", "way", "v", "known").mapInPandas(compare, "pair int, way int, n long, v binary")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, dtype="<i8") for v in pdf["v"])
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "way": [pdf["way"].iloc[0]], "n": [pdf["n"].sum()], "v": [total.tobytes()]})

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = starts[int(pdf["pair"].iloc[0])]
        total = sum(np.frombuffer(v, dtype="<i8") for v in pdf["v"]).reshape(min(tile, width - a), -1)
        i, j = np.indices(total.shape)
        keep = (i + a) < (j + b)
        return pd.DataFrame({"i": (i + a)[keep], "j": (j + b)[keep], "exceed": total[keep], "_n": int(pdf["n"].sum())})

    parts = counted.groupBy("pair", "way").applyInPandas(add, "pair int, way int, n long, v binary")
    counted = parts.groupBy("pair").applyInPandas(rows_of, "i int, j int, exceed long, _n long")
    counted = counted.withColumn("null_p", F.col("exceed") / F.col("_n")).drop("_n")
    return adjust_pvalues(counted, "null_p", (), method, out="null_pvalue").drop("reject")


def nodes(features: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(features)), "id int, name string")


def network(
    matrix: Matrix, n_boot: int = 1000, seed: int = 0, method: str | None = "fdr_bh",
    max_pvalue: float | None = None, block_size: int = RS.BLOCK_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """Nodes(id, name) and edges(source, target, weight, pvalue, null_pvalue) with i < j.
    ``max_pvalue`` keeps only significant edges."""
    width, n_rows = len(matrix.features), sum(matrix.sizes)
    blocks = network_blocks(matrix.rows, n_rows, width, block_size)
    pairs = correlation(blocks, width).persist()
    edges = edge_pvalues(pairs, n_rows, method)
    if n_boot > 0:
        null = edge_bootstrap(blocks, width, pairs, n_boot, seed, method).select("i", "j", "null_pvalue")
        edges = edges.join(null, ["i", "j"], "left")
    else:
        edges = edges.withColumn("null_pvalue", F.lit(None).cast("double"))
    if max_pvalue is not None:
        edges = edges.filter(F.col("pvalue") <= number(max_pvalue))
    out = edges.select(
        F.col("i").alias("source"), F.col("j").alias("target"), F.col("r").alias("weight"), "pvalue", "null_pvalue"
    )
    return nodes(matrix.features, matrix.rows.sparkSession), out


def region_pairs(results: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(a, b, n_animals): structure pairs and the number of animals that have both, of ``features`` or of all."""
    if features is not None:
        results = results.filter(F.col("acronym").isin(*features))
    ensure_checkpoint_dir(results.sparkSession)
    present = results.groupBy("animal_id").agg(
        F.collect_set("acronym").alias("_s")  # at most the number of structures
    ).checkpoint()
    if features is None:
        features = sorted(r[0] for r in present.select(F.explode("_s")).distinct().collect())  # bounded by the atlas
    flags = F.array(*[F.array_contains("_s", f).cast("double") for f in features])
    names = F.array(*[F.lit(f) for f in features])
    a, b = np.triu_indices(len(features), k=1)

    def partial(frames):
        total = np.zeros((len(features), len(features)))
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["x"].tolist())
                total += x.T @ x
        yield pd.DataFrame({"i": a, "j": b, "n": total[a, b].astype(np.int64)})

    sums = present.select(flags.alias("x")).mapInPandas(partial, "i int, j int, n long")
    return sums.groupBy("i", "j").agg(F.sum("n").alias("n_animals")).select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n_animals"
    )


def matrix_to_graph(matrix: DataFrame) -> DataFrame:
    """Edges of a square long matrix ``(i, j, weight)``: no self-loops, no zeros."""
    return matrix.filter((F.col("i") != F.col("j")) & (F.col("weight") != 0))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The GraphML text as (part, key, line), to be written in that order."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    head = [
        '<?xml version="1.0" encoding="utf-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        '<key id="d0" for="node" attr.name="name" attr.type="string"/>',
        *[f'<key id="d{k}" for="edge" attr.name="{n}" attr.type="double"/>'
          for k, n in ((1, "weight"), (2, "pvalue"), (3, "null_pvalue"))],
        '<graph edgedefault="undirected">',
    ]
    spark = nodes.sparkSession
    fixed = spark.createDataFrame(
        [(0, i, 0, t) for i, t in enumerate(head)] + [(3, 0, 0, "</graph>"), (3, 1, 0, "</graphml>")],
        "part int, a int, b int, line string",
    )
    node_lines = nodes.select(
        F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).alias("b"),
        F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('"><data key="d0">'), esc(F.col("name")), F.lit("</data></node>")).alias("line"),
    )
    data = [
        F.when(F.col(n).isNotNull(), F.concat(F.lit(f'<data key="d{k}">'), F.col(n).cast("string"), F.lit("</data>")))
        for k, n in ((1, "weight"), (2, "pvalue"), (3, "null_pvalue"))
    ]
    edge_lines = edges.select(
        F.lit(2).alias("part"), F.col("source").alias("a"), F.col("target").alias("b"),
        F.concat_ws(
            "",
            F.lit('<edge source="'), F.col("source").cast("string"), F.lit('" target="'), F.col("target").cast("string"), F.lit('">'),
            *data, F.lit("</edge>"),
        ).alias("line"),
    )
    return fixed.unionByName(node_lines).unionByName(edge_lines)
