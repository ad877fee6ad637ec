"""The analyses of a whole project, as a user calls them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators import pls as L
from voxtally.operators import slices as S
from voxtally.operators import stats as T


def project_pls(
    documents: DataFrame,
    subjects: DataFrame,
    results: DataFrame,
    condition: str,
    values: str,
    min_group_size: int,
    conditions: Sequence[str] | None = None,
    subject_condition: str | None = None,
    n_perm: int = 1000,
    n_boot: int = 1000,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """The sheets of mean-centred PLS of a project: values, lv_p_value, estimated_lv1 and pls_salience.

    ``documents`` are its slices with their registration, ``subjects`` have a map of conditions, and
    ``results`` is the results table.  Where a valid slice misses a registration step, a subject misses
    ``subject_condition`` (else ``condition``) or there are not two values of it, this is an error."""
    ready = S.can_calculate_contrast(documents, subjects, subject_condition or condition).first()
    if not ready["ready"]:
        raise RuntimeError(
            f"parameters complete: {ready['params_complete']}, every subject has the condition: {ready['all_have_condition']},"
            f" values: {ready['n_values']}")
    matrix = T.build_matrix(results, values, condition, min_group_size, conditions)
    result = L.meancentered_pls(matrix, n_perm=n_perm, n_boot=n_boot, seed=seed)
    numbers = [F.get("x", F.lit(k)).alias(name) for k, name in enumerate(matrix.features)]
    return L.pls_sheets(result, matrix.rows.select("animal_id", condition, *numbers))
