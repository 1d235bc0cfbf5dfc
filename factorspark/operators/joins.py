"""Joins of cells with a table keyed by row or by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.matrix import SparseMatrix


def lookup(matrix: SparseMatrix, table: DataFrame, keys: list[str], rows: int, doubles: int) -> DataFrame:
    """Inner join of the cells with `table`, which has one row per key.

    `rows` bounds the rows of the table and `doubles` is its width. A table that fits is
    broadcast. Otherwise the cells of hot keys are spread over several tasks and the
    matching table rows are repeated once per task; nothing is left out.
    """
    cells = matrix.entries
    if matrix.limits.fits(rows, doubles):
        return cells.join(F.broadcast(table), keys)
    hot = matrix.hot_keys(keys)
    if hot is None:
        return cells.join(table, keys)
    limit = matrix.limits.hot_limit(matrix.n_cells)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("key_cells") / F.lit(limit)).cast("int").alias("spread")))
    others = [c for c in [*matrix.row_keys, "col_id"] if c not in keys]
    cells = cells.join(hot, keys, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.hash(*others), F.col("spread")), F.lit(0))
    )
    table = table.join(hot, keys, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("spread"), F.lit(1)) - 1))
    )
    return cells.drop("spread").join(table.drop("spread"), [*keys, "salt"]).drop("salt")
