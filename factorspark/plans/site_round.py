"""Rounds of a fit over sites that run as jobs of their own and share nothing but a folder.

The folder holds `factor/round=r`, the `partials` that sites add, and `stop` once the fit is over. A site reads the factor of a
round and adds the sums over its own rows; whoever accumulates finds out whether all sites are there, and writes the factor of the
next round. A table counts once it is complete, so a job that breaks is run again; it waits for nobody.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.columns import combine, names
from factorspark.functions.smalldense import solve
from factorspark.matrix import SparseMatrix
from factorspark.operators.accumulate import accumulate_partials, wide
from factorspark.operators.factors import compare_factors, factor_change, init_factor
from factorspark.operators.moments import factor_gramian
from factorspark.plans.layout import prepare
from factorspark.plans.sites import site_partials
from factorspark.session import claim, path_exists, table_done
from factorspark.sources.tables import load_factor, read_partials, save_factor, write_partials


@dataclass(frozen=True)
class RoundState:
    """What a call of `accumulate_round` found: `waiting` for sites, `next` round ready, or `stopped`."""

    state: str
    round: int
    dw: float | None = None


def stopped(spark: SparkSession, exchange: str) -> bool:
    return path_exists(spark, f"{exchange}/stop")


def begin(spark: SparkSession, exchange: str, n_cols: int, k: int, init: str | DataFrame = "uniform", seed: int = 42) -> None:
    """Write the factor that the first round starts from, unless it is there."""
    if not table_done(spark, f"{exchange}/factor/round=0"):
        start = init if isinstance(init, DataFrame) else init_factor(spark, n_cols, k, init, seed)
        save_factor(start, f"{exchange}/factor", 0, n_cols)


def site_round(matrix: SparseMatrix, exchange: str, r: int, k: int, folder: str | None = None) -> bool:
    """Add the sums of this site's rows for round `r`; False if the fit is over or the factor of the round is not there yet.

    The matrix holds the rows of the site, in a column `site`, and its own row count. Sent twice, sums count once.
    """
    spark = matrix.spark
    if stopped(spark, exchange) or not table_done(spark, f"{exchange}/factor/round={r}"):
        return False
    layout = prepare(matrix, k, folder=folder)
    factor = load_factor(spark, f"{exchange}/factor", r, k)
    write_partials(site_partials(layout, factor, k, r), f"{exchange}/partials")
    layout.release()
    return True


def _square(sums: DataFrame, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for row in sums.select("i", "j", "value").collect():
        out[row["i"], row["j"]] = row["value"]
    return out


def next_factor(sums: DataFrame, factor: DataFrame, k: int) -> DataFrame:
    """`W_new = Y'X (X'X)^-1 W'W` from the accumulated sums; columns that no site has cells in become zero."""
    gram = _square(factor_gramian(factor, k), k)
    to_new = solve(_square(sums.where("kind = 'XtX'"), k), gram, "X'X")
    moved = combine(wide(sums.where("kind = 'YtX'"), k), "p", to_new, "w", keep=["col_id"])
    return factor.select("col_id").join(moved, "col_id", "left").fillna(0.0)


def accumulate_round(
    spark: SparkSession, exchange: str, r: int, k: int, n_cols: int, n_sites: int, max_rounds: int = 3, tolerance: float | None = None
) -> RoundState:
    """Sum what the sites sent for round `r`, if all is there, and write the factor of the next round; `stop` after the last one.

    A call for a round whose next factor is complete changes nothing.
    """
    if not path_exists(spark, f"{exchange}/partials"):
        return RoundState("waiting", r)
    done = table_done(spark, f"{exchange}/factor/round={r + 1}")
    factor = load_factor(spark, f"{exchange}/factor", r, k)
    if not done:
        partials = read_partials(spark, f"{exchange}/partials").where(F.col("round") == r)
        sums = accumulate_partials(partials, n_sites, announced=True)
        if {row["kind"] for row in sums.select("kind").distinct().collect()} != {"XtX", "YtX"}:
            return RoundState("waiting", r)
        save_factor(next_factor(sums, factor, k), f"{exchange}/factor", r + 1, n_cols)
    pairs = compare_factors(factor, load_factor(spark, f"{exchange}/factor", r + 1, k), k)
    dw = factor_change(pairs, k).first()["dw"]
    if r + 1 >= max_rounds or (tolerance is not None and dw <= tolerance):
        claim(spark, f"{exchange}/stop")
        return RoundState("stopped", r + 1, dw)
    return RoundState("next", r + 1, dw)
