"""Sums over cells, latent rows and factor rows, mean-centred without filling in zeros."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import names, subtract, weighted_sums
from factorspark.matrix import SparseMatrix
from factorspark.operators.joins import lookup
from factorspark.operators.small import products


def col_stats(matrix: SparseMatrix, digest: bool = False) -> DataFrame:
    """Per column: stored cells, their sum, the mean over all rows and the squared
    deviation from it over all rows, empty ones included. With sites: per site and column.

    `digest` adds a digest of the cells, places and values, whatever their order.
    """
    keys = ["site", "col_id"] if matrix.has_sites else ["col_id"]
    stats = matrix.checked_entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_nonzero"),
        F.sum("value").alias("total"),
        F.var_pop("value").alias("spread"),
        *([F.bit_xor(F.xxhash64("row_id", "col_id", "value")).alias("digest")] if digest else []),
    )
    if matrix.has_sites:
        sites = matrix.site_rows.select("site", "n_rows")
        if matrix.limits.fits(matrix.n_sites, 1):
            sites = F.broadcast(sites)
        unknown = F.raise_error(F.concat(F.lit("site_rows lacks the site "), F.col("site").cast("string"))).cast("bigint")
        stats = stats.join(sites, "site", "left").withColumn("n_rows", F.coalesce(F.col("n_rows").cast("bigint"), unknown))
    else:
        stats = stats.withColumn("n_rows", F.lit(matrix.n_rows).cast("bigint"))
    n, stored = F.col("n_rows").cast("double"), F.col("n_nonzero").cast("double")
    mean, own = F.col("total") / n, F.col("total") / stored
    deviation = stored * F.col("spread") + stored * (own - mean) * (own - mean) + (n - stored) * mean * mean
    told = ["digest"] if digest else []
    return stats.select(*keys, "n_nonzero", "total", mean.alias("mean"), deviation.alias("deviation"), *told)


def col_means(matrix: SparseMatrix) -> DataFrame:
    """Column sums divided by the number of rows."""
    sums = matrix.entries.groupBy("col_id").agg(
        F.count(F.lit(1)).alias("n_nonzero"), F.sum("value").alias("total")
    )
    return sums.withColumn("mean", F.col("total") / F.lit(float(matrix.n_rows)))


def centered_frobenius(stats: DataFrame) -> DataFrame:
    """Sum of squares of the centred matrix from `col_stats`, one row."""
    return stats.agg(F.coalesce(F.sum("deviation"), F.lit(0.0)).alias("norm2"))


def latent_sum(latent: DataFrame, k: int) -> DataFrame:
    return latent.agg(*[F.sum(c).alias(c) for c in names("x", k)])


def gramian(latent: DataFrame, k: int, n_rows: int, shift: Sequence[float] | None = None) -> DataFrame:
    """`X'X` of the latent rows after subtracting `shift`, as `(i, j, value)`.

    Rows missing from the table are zero rows of the matrix; with a shift they count as
    `-shift`. Subtracting before multiplying keeps large means from cancelling.
    """
    shift = np.zeros(k) if shift is None else np.asarray(shift, dtype=float)
    centred = subtract(latent, "x", shift, "c")
    c, ones = names("c", k), ["one"] * k
    sums = products(centred.withColumn("one", F.lit(1.0)), {"xx": (c, c), "rows": (ones, ones)})
    outer = F.array(*[F.array(*[F.lit(float(a * b)) for b in shift]) for a in shift])
    inner = F.sum(F.when(F.col("kind") == "xx", F.col("value")))
    present = F.sum(F.when(F.col("kind") == "rows", F.col("value")))
    return (
        sums.groupBy("i", "j")
        .agg(inner.alias("inner"), present.alias("present"))
        .select(
            "i",
            "j",
            (F.col("inner") + (F.lit(float(n_rows)) - F.col("present")) * outer[F.col("i")][F.col("j")]).alias("value"),
        )
    )


def cross_moment(
    matrix: SparseMatrix, latent: DataFrame, k: int, shift: Sequence[float] | None = None
) -> DataFrame:
    """`Y'X` with both sides centred, `(col_id, m_0 ..)`.

    Centring X is enough: its columns then sum to zero over all rows, so the means of Y
    drop out and only stored cells matter.
    """
    shift = np.zeros(k) if shift is None else np.asarray(shift, dtype=float)
    centred = subtract(latent, "x", shift, "c", keep=matrix.row_keys)
    pairs = lookup(matrix, centred, matrix.row_keys, matrix.n_rows, k)
    return weighted_sums(pairs, ["col_id"], "value", "c", k, "m")


def factor_gramian(factor: DataFrame, k: int) -> DataFrame:
    """`W'W` as `(i, j, value)`."""
    w = names("w", k)
    return products(factor, {"ww": (w, w)}).select("i", "j", "value")


def noise_variance(norm2: float, xtx: np.ndarray, ctc: np.ndarray, n_rows: int, n_cols: int) -> float:
    """Variance left after an M-step.

    Right after the update `Y'X = C X'X`, so the third sum of the textbook form is the
    trace too and no pass over the data is needed.
    """
    return float((norm2 - np.trace(xtx @ ctc)) / (float(n_rows) * float(n_cols)))


def matrix_profile(matrix: SparseMatrix) -> DataFrame:
    """Rows with cells, cells, cells per row and density, one row."""
    rows = matrix.entries.groupBy(*matrix.row_keys).agg(F.count(F.lit(1)).alias("cells"))
    area = float(matrix.n_rows) * float(matrix.n_cols)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows_stored"), F.coalesce(F.sum("cells"), F.lit(0)).alias("n_nonzero")
    ).select(
        "n_rows_stored",
        "n_nonzero",
        (F.col("n_nonzero") / F.col("n_rows_stored")).alias("avg_per_row"),
        (F.col("n_nonzero") / F.lit(area)).alias("density"),
    )
