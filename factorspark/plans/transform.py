"""Latent coordinates of rows for a given factor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorspark.functions.columns import names, subtract
from factorspark.matrix import SparseMatrix
from factorspark.operators.factors import orthonormal_basis, posterior_map
from factorspark.operators.products import mean_times_factor, multiply

BASES = ("factor", "orthonormal", "posterior")


def transform(
    matrix: SparseMatrix,
    factor: DataFrame,
    k: int,
    basis: str = "factor",
    ss: float | None = None,
    means: DataFrame | None = None,
) -> DataFrame:
    """Rows times a basis, `(row_id, x_0 ..)` for the rows that have cells.

    factor       the raw rows times the factor as it is
    orthonormal  the raw rows times the orthonormal components
    posterior    expected latent rows of the noise model: centred, needs `ss` and `means`
    """
    if basis == "factor":
        return multiply(matrix, factor, k)
    if basis == "orthonormal":
        turned = orthonormal_basis(factor, k).selectExpr("col_id", *[f"u_{j} as w_{j}" for j in range(k)])
        return multiply(matrix, turned, k)
    if basis != "posterior":
        raise ValueError(f"basis must be one of {BASES}")
    if ss is None or means is None:
        raise ValueError("the posterior basis needs ss and means")
    encode, _ = posterior_map(factor.select("col_id", *names("w", k)), k, ss)
    offset = list(mean_times_factor(means, encode, k).first())
    return subtract(multiply(matrix, encode, k), "x", offset, "x", keep=matrix.row_keys)
