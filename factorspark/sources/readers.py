"""Readers that turn text, array rows and vectors into cells."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factorspark.operators.cells import bound_nonzero
from factorspark.session import DEFAULT_LIMITS


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank, numbered from 0 across files in path order.

    Lines are numbered inside each file split on the spot; only the line counts of the
    splits, one small row each, are put in order to find where a split begins.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.trim("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
        )
        .filter(F.length("line") > 0)
        .withColumn("at", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    splits = splits.persist()
    if DEFAULT_LIMITS.fits(splits.count(), 30):
        splits = F.broadcast(splits)
    return lines.join(splits, ["file", "start"]).select(
        (F.col("offset") + F.col("at") - F.col("first")).alias("row_id"), "line"
    )


def read_dense_text(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a dense text matrix: one row per line, numbers separated by white space.

    Zeros are kept, as the reader of a dense form cannot know that they are not wanted.
    """
    rows = numbered_lines(spark, path)
    tokens = rows.select("row_id", F.posexplode(F.split("line", r"\s+")).alias("col_id", "token"))
    return tokens.select("row_id", F.col("col_id").cast("bigint"), F.col("token").cast("double").alias("value"))


def read_coo_text(
    spark: SparkSession, path: str, base: int = 0, shift: int = 0, repeated: str = "last", binary: bool = False
) -> DataFrame:
    """Cells of a coordinate text: `row col [value]` per line, value 1 if it is missing.

    The lines need no order, and a row may spread over files. A position that is given more
    than once keeps the last value in file order (`last`) or gets the sum (`sum`). `base`
    is the smallest column id, `shift` is taken off both ids first.
    """
    tokens = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path)
    if repeated == "last":
        order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        lines = lines.select("value", order.alias("at"))
    lines = lines.filter(F.length(F.trim("value")) > 0).withColumn("t", tokens)
    cells = lines.select(
        (F.col("t")[0].cast("bigint") - shift).alias("row_id"),
        (F.col("t")[1].cast("bigint") - shift - base).alias("col_id"),
        (F.lit(1.0) if binary else F.coalesce(F.get("t", F.lit(2)).cast("double"), F.lit(1.0))).alias("value"),
        *(["at"] if repeated == "last" else []),
    )
    kept = {"last": F.max_by("value", "at"), "sum": F.sum("value")} if repeated == "last" else {"sum": F.sum("value")}
    if repeated not in kept:
        raise ValueError("repeated must be last or sum")
    return cells.groupBy("row_id", "col_id").agg(kept[repeated].alias("value"))


def read_rows(table: DataFrame, n_cols: int | None = None) -> DataFrame:
    """Cells of sparse rows `(row_id, indices array, values array)`, bounded and without zeros."""
    cells = table.select("row_id", F.inline(F.arrays_zip("indices", "values"))).select(
        "row_id", F.col("indices").cast("bigint").alias("col_id"), F.col("values").cast("double").alias("value")
    )
    return cells.filter("value <> 0") if n_cols is None else bound_nonzero(cells, n_cols)


def from_vector_column(table: DataFrame, row: str, vector: str) -> DataFrame:
    """Cells of rows that hold an array of numbers or an ML vector."""
    values = F.col(vector)
    if isinstance(table.schema[vector].dataType, VectorUDT):
        values = vector_to_array(values)
    cells = table.select(F.col(row).cast("bigint").alias("row_id"), F.posexplode(values).alias("col_id", "value"))
    return cells.select("row_id", F.col("col_id").cast("bigint"), F.col("value").cast("double")).filter("value <> 0")


def dense_to_entries(table: DataFrame, prefix: str, key: str = "row_id") -> DataFrame:
    """Cells of a table with numbered columns, zeros left out."""
    numbered = sorted((c for c in table.columns if c.startswith(f"{prefix}_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    return from_vector_column(table.select(key, F.array(*numbered).alias("v")), key, "v")
