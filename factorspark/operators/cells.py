"""Filters and projections on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.functions.columns import uniform


def bound_nonzero(entries: DataFrame, n_cols: int) -> DataFrame:
    """Drop zeros and cells left of the first or right of the last column."""
    return entries.filter((F.col("col_id") >= 0) & (F.col("col_id") < n_cols) & (F.col("value") != 0))


def rebase_ids(entries: DataFrame, row_shift: int = 0, col_shift: int = 0) -> DataFrame:
    """Move ids so that they start at 0."""
    return entries.withColumns(
        {"row_id": F.col("row_id") - F.lit(row_shift), "col_id": F.col("col_id") - F.lit(col_shift)}
    )


def binarize(entries: DataFrame) -> DataFrame:
    """Keep where a value is, not how large it is."""
    return entries.withColumn("value", F.lit(1.0))


def assign_column_block(table: DataFrame, n_cols: int, blocks: int) -> DataFrame:
    """Add the block of each column and the position inside it.

    Blocks cut `[0, n_cols)` at `floor(i * n_cols / blocks)` and count from 1.
    """
    block = F.expr(f"cast(((col_id + 1) * {blocks}L + {n_cols - 1}L) div {n_cols}L as int)")
    return table.withColumn("block", block).withColumn(
        "offset", F.col("col_id") - F.expr(f"((block - 1) * {n_cols}L) div {blocks}L")
    )


def sample_rows(table: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Keep each row of the matrix with probability `rate`, all its cells or none."""
    if rate >= 1:
        return table
    return table.filter(uniform(F.col("row_id"), seed, stream=1) <= rate)


def limit_cols(entries: DataFrame, last_col: int) -> DataFrame:
    """Keep columns up to and including `last_col`."""
    return entries.filter(F.col("col_id") <= last_col)


def limit_rows(entries: DataFrame, count: int) -> DataFrame:
    """Keep the cells of the `count` rows with the smallest ids among rows that have cells.

    Only the last of these ids comes to the driver, so that the cut is a plain filter.
    """
    edge = entries.select("row_id").distinct().orderBy("row_id").limit(count).agg(F.max("row_id")).first()[0]
    return entries.filter(F.col("row_id") <= F.lit(edge))
