"""Embedding whitening by shifted CholeskyQR.

Embeddings become whole numbers on a grid, so that equal vectors are told exactly and sums
are exact. With the centred distinct vectors as rows of A, distributed passes sum the Gram
matrix of A times the inverse of the triangular factor found so far; its Cholesky factor,
shifted first so that rounding cannot make it fail, is composed into that factor. When the
Gram matrix is the identity, A = Q R with orthonormal Q, and the singular value
decomposition of the small R gives the principal components and their variances.

Nothing wider than a vector times a vector leaves a task: matrices of partial sums are
added up by Spark, cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import settle

SCALE = 64
LIFT = 1_000_000
COMPONENTS = 16
PASSES = 6
CLOSE = 1e-13  # of a Gram matrix to the identity, beside the rounding of its own sums
FLAT = 1e-13  # of a component's standard deviation to the largest, below which it has no variance
LARGEST = 1 << 40  # to which an entry on the grid is held, so that its sums stay whole


def on_grid(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, lift: int = LIFT) -> DataFrame:
    """(id, x): every vector whose entries are all finite numbers, on the grid floor(scale * c) + lift."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.expr("forall(vector, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    held = F.transform("vector", lambda c: (F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-2.0**50)), F.lit(2.0**50))), F.lit(-LARGEST)), F.lit(LARGEST)) + lift).cast("long"))
    return rows.where("vector is not null").where(fine).select("id", held.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(points: DataFrame, width: int, cells: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of `work` of a batch's vectors, which gives `cells` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                total += work(matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = points.select("x").mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("cell", "value"))
    out = np.zeros(cells)
    for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, each entry rounded once: the difference n * x - sums is taken in whole numbers."""
    return deviations(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; as Python's integers where 64 bits may not hold it."""
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    away = x - np.array(middle, dtype=np.int64)
    if not away.size or n * (int(np.abs(away).max()) + 1) < 1 << 62:
        return away * n - np.array(rest, dtype=np.int64)
    return away.astype(object) * n - np.array(rest, dtype=object)


def squared_lengths(moved: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row, null where a long does not hold it."""
    if moved.dtype != object and (not moved.size or int(np.abs(moved).max()) ** 2 * moved.shape[1] < 1 << 63):
        return (moved * moved).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in moved]
    return [v if v < 1 << 63 else None for v in exact]


def forward(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows * factor^-1 for an upper triangular factor, a column at a time."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def triangular_factor(points: DataFrame, width: int, n: int, sums: list[int], passes: int = PASSES) -> np.ndarray:
    """R of A = Q R for the centred rows A, by repeated shifted CholeskyQR.

    Only the first factor is shifted; each further one takes out what shift and rounding left
    of the one before. A direction without any spread stays zero behind the first factor, so
    no second one exists: the square root of that Gram matrix ends the product instead.
    """
    factors: list[np.ndarray] = []
    unit = np.finfo(np.float64).eps / 2
    whole = np.eye(width)
    for _ in range(passes):
        held = list(factors)

        def work(x: np.ndarray, held: list[np.ndarray] = held) -> np.ndarray:
            rows = centred(x, n, sums)
            for factor in held:
                rows = forward(rows, factor)
            return (rows.T @ rows).ravel()

        gram = summed(points, width, width * width, work).reshape(width, width)
        gram = (gram + gram.T) / 2
        if not factors:
            norm = float(np.linalg.norm(gram, 2))
            if not norm:
                return gram
            shift = 11 * (width * n + width * (width + 1)) * unit * norm
            factors.append(np.linalg.cholesky(gram + min(shift, norm) * np.eye(width)).T)
            whole = factors[-1]
            continue
        try:
            factors.append(np.linalg.cholesky(gram).T)
        except np.linalg.LinAlgError:
            value, direction = np.linalg.eigh(gram)
            return (direction * np.sqrt(np.maximum(value, 0))) @ direction.T @ whole
        whole = factors[-1] @ whole
        if float(np.abs(gram - np.eye(width)).max()) < CLOSE * max(1.0, n**0.5):
            break
    return whole


def principal(factor: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(directions as rows, variances) of R, by falling variance; the largest entry of a direction is positive."""
    _, deviation, directions = np.linalg.svd(factor)
    directions = directions[:components]
    sign = np.sign(np.take_along_axis(directions, np.abs(directions).argmax(1)[:, None], 1))
    return directions * np.where(sign == 0, 1, sign), (deviation[:components] / n**0.5) ** 2


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, lift: int = LIFT, passes: int = PASSES) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every valid row and leading component.

    The components are those of the distinct vectors on the grid, so copies, however many,
    do not move them. Rows whose vector is null, empty or holds a null or a number that is
    not finite take no part, nor do those of another length than most (the shorter length,
    on a tie). Rows that repeat stay; ids may be null. Entries beyond 2^40 on the grid are
    held there. A component without variance has null `whitened` and counts 0 in
    `explained`, which is null only if no component has any; `deviation` is null where a
    long does not hold it. Fewer dimensions than `components` give that many components; an
    empty table stays empty. Columns of other names are not read.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    grid = settle(on_grid(vectors, id_col, vector_col, scale, lift).where(F.size("x") > 0), "grid")
    most = grid.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "width").first()
    if most is None:
        return spark.createDataFrame([], schema)
    width = most["width"]
    grid = grid.where(F.size("x") == width)
    points = settle(grid.select("x").distinct(), "points")
    entries = points.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).collect()
    n, sums = entries[0]["n"], [0] * width
    for r in entries:
        sums[r["at"]] = int(r["total"])
    factor = triangular_factor(points, width, n, sums, passes)
    directions, variance = principal(factor, n, min(components, width))
    trace = float((factor * factor).sum()) / n
    live = np.sqrt(variance) > FLAT * np.sqrt(variance[0]) if trace else np.zeros(len(variance), dtype=bool)
    onto = np.where(live[:, None], directions / np.sqrt(np.where(live, variance, 1))[:, None], 0).T
    count = int(live.sum())
    if count:
        covariance = summed(points, width, count * count, lambda x: (lambda z: (z.T @ z).ravel())(centred(x, n, sums) @ onto[:, live])).reshape(count, count) / n
        error = float(np.abs(covariance - np.eye(count)).max())
    else:
        error = 0.0
    share = np.where(live, variance, 0) / trace if trace else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(variance)
        for batch in batches:
            moved = deviations(matrix(batch.column(1), width), n, sums)
            z = (moved.astype(np.float64) / n) @ onto
            rows = np.repeat(np.arange(batch.num_rows), k)
            blank = np.tile(~live, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(rows), n, dtype=np.int64)),
                    pa.array(squared_lengths(moved), pa.int64()).take(pa.array(rows, pa.int64())),
                    pa.array(z.ravel(), pa.float64(), mask=blank),
                    pa.array(np.tile(share, batch.num_rows), pa.float64()) if trace else pa.nulls(len(rows), pa.float64()),
                    pa.array(np.full(len(rows), error)),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return grid.select("id", "x").mapInArrow(run, schema)
