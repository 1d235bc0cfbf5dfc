"""EM over several sites that keep their rows and exchange sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import names
from factorspark.matrix import SparseMatrix
from factorspark.operators.accumulate import accumulate_partials, long, wide
from factorspark.operators.params import FitParams
from factorspark.operators.products import mean_times_factor
from factorspark.operators.small import products
from factorspark.plans.em import Fit, Loop, _start, wide_update
from factorspark.plans.layout import Layout, Shift, gram_product, prepare
from factorspark.sources.tables import read_partials, write_partials

CENTRES = ("site", "global")


def site_shift(layout: Layout, factor: DataFrame, k: int, center: str) -> Shift:
    """What latent rows are centred by: each site's own `mu' W`, or the one of all rows."""
    if center not in CENTRES:
        raise ValueError(f"center must be one of {CENTRES}")
    if center == "site":
        return mean_times_factor(layout.stats, factor, k)
    totals = layout.stats.groupBy("col_id").agg(F.sum("total").alias("total"))
    means = totals.selectExpr("col_id", f"total / {float(layout.matrix.n_rows)!r}D as mean")
    return list(mean_times_factor(means, factor, k).first())


def site_partials(layout: Layout, factor: DataFrame, k: int, r: int, center: str = "site") -> DataFrame:
    """What the sites send in round `r`: `X'X` and `Y'X` of their own rows, as cells.

    `X'X` is `W' (Y'X)`, so one pass over the data gives both.
    """
    shift = site_shift(layout, factor, k, center)
    moments = gram_product(layout, factor, k, shift, by_site=True)
    # Gramian, cells and their counts are read from one pass.
    beside = factor.select("col_id", *names("w", k))
    near = F.broadcast(beside) if layout.matrix.limits.fits(layout.matrix.n_cols, k) else beside
    both = layout.kept(moments.join(near, "col_id", "left"))
    gram = products(both, {"XtX": (names("w", k), names("p", k))}, by="site").withColumn("i", F.col("i").cast("bigint"))
    tall = long(both.drop(*names("w", k)), k, "col_id", "p").withColumn("kind", F.lit("YtX"))
    every = gram.unionByName(tall).withColumn("round", F.lit(r))
    return every.select("round", "site", "kind", "i", "j", "value")


def ppca_em_sites(
    matrix: SparseMatrix,
    params: FitParams,
    init: str | DataFrame = "uniform",
    center: str = "site",
    exchange: str = "direct",
    layout: Layout | None = None,
    folder: str | None = None,
    resume: bool = False,
    track_change: bool = False,
) -> Fit:
    """Zero-noise EM where every site centres its rows with its own mean and row count.

    `direct` sums the sites inside the round's aggregation. `partials` writes what each site
    would send to a table first and sums complete rounds from there; the result is the same.
    """
    if not matrix.has_sites:
        raise ValueError("the matrix has no site column")
    params = params.checked(matrix.n_rows, matrix.n_cols)
    k = params.n_components
    layout = layout or prepare(matrix, k, folder=folder)

    def direct(factor: DataFrame, width: int, r: int) -> DataFrame:
        return gram_product(layout, factor, width, site_shift(layout, factor, width, center))

    def through_table(factor: DataFrame, width: int, r: int) -> DataFrame:
        path = f"{layout.folder}/partials/attempt={r}"
        write_partials(site_partials(layout, factor, width, r, center), path, mode="overwrite")
        sums = accumulate_partials(read_partials(matrix.spark, path), matrix.n_sites, announced=True)
        return wide(sums.filter(F.col("kind") == "YtX"), width)

    ways = {"direct": direct, "partials": through_table}
    if exchange not in ways:
        raise ValueError(f"exchange must be one of {sorted(ways)}")
    loop = Loop(
        layout,
        k,
        wide_update,
        product=ways[exchange],
        max_rounds=params.max_rounds,
        tolerance=params.tolerance,
        track_change=track_change,
        method=f"sites, {center}",
    )
    return loop.run(_start(matrix, params, init), resume=resume)
