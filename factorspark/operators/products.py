"""Products of the matrix with tall tables and the checks around them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import names, weighted_sums
from factorspark.matrix import SparseMatrix
from factorspark.operators.joins import lookup

# Facts that one task joins with their sites, and goes on to sum.
FACTS_PER_TASK = 1_000_000


def multiply(matrix: SparseMatrix, factor: DataFrame, k: int) -> DataFrame:
    """`Y B` for a table `B(col_id, w_0 ..)`: one row `(row_id, x_0 ..)` per row with cells."""
    pairs = lookup(matrix, factor.select("col_id", *names("w", k)), ["col_id"], matrix.n_cols, k)
    return weighted_sums(pairs, matrix.row_keys, "value", "w", k, "x")


def align_rows(matrix: SparseMatrix, latent: DataFrame, k: int) -> DataFrame:
    """Cells next to the latent row of their matrix row."""
    return lookup(matrix, latent, matrix.row_keys, matrix.n_rows, k)


def unmatched_rows(matrix: SparseMatrix, latent: DataFrame) -> DataFrame:
    """Rows with cells but without a latent row; empty when the two belong together."""
    rows = matrix.entries.select(*matrix.row_keys).distinct()
    return rows.join(latent.select(*matrix.row_keys), matrix.row_keys, "left_anti")


def mean_times_factor(stats: DataFrame, factor: DataFrame, k: int) -> DataFrame:
    """`mu' B`, one row `x_0 ..`; with per-site means one row per site."""
    joined = stats.join(factor.select("col_id", *names("w", k)), "col_id")
    return weighted_sums(joined, ["site"] if "site" in stats.columns else [], "mean", "w", k, "x")


def attach_site(facts: DataFrame, sites: DataFrame, key: str, site: str, n_facts: int = 0) -> DataFrame:
    """Give each fact the site of its owner through a dimension table; a fact without owner is an error.

    With `n_facts` told, facts are dealt by `key` to as many tasks as they need, if that is more than the session's number.
    """
    parts = math.ceil(n_facts / FACTS_PER_TASK)
    if parts > int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        facts = facts.repartition(parts, key)
    owner = sites.select(key, F.col(site).alias("site"))
    missing = F.raise_error(F.concat(F.lit(f"no owner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    found = facts.join(owner, key, "left")
    return found.withColumn("site", F.coalesce(F.col("site"), missing.cast(owner.schema["site"].dataType)))
