"""Parquet tables that fits and sites leave behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.columns import names
from factorspark.operators.accumulate import PARTIALS_SCHEMA, with_counts
from factorspark.operators.cells import assign_column_block

METRICS_SCHEMA = (
    "run string, app string, data_set string, n_rows bigint, n_cols bigint, n_components int, blocks int, "
    "round int, ss double, dw double, error double, seconds double"
)


def save_factor(factor: DataFrame, path: str, r: int, n_cols: int, blocks: int = 1) -> None:
    """Write the factor of a round, one folder per column block."""
    placed = assign_column_block(factor, n_cols, blocks).drop("offset")
    placed.write.mode("overwrite").partitionBy("block").parquet(f"{path}/round={r}")


def load_factor(spark: SparkSession, path: str, r: int, k: int, block: int | None = None) -> DataFrame:
    """Read the factor of a round; with `block` only that folder is read."""
    schema = ", ".join(["col_id bigint", *[f"{c} double" for c in names("w", k)], "block int"])
    table = spark.read.schema(schema).parquet(f"{path}/round={r}")
    if block is not None:
        table = table.filter(F.col("block") == block)
    return table.select("col_id", *names("w", k))


def write_partials(partials: DataFrame, path: str, mode: str = "append") -> None:
    """Add what sites send, with the number of cells per (round, site, kind)."""
    with_counts(partials).write.mode(mode).partitionBy("round", "kind").parquet(path)


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    columns = [c.split()[0] for c in PARTIALS_SCHEMA.split(", ")]
    return spark.read.schema(PARTIALS_SCHEMA).parquet(path).select(*columns)


def save_projection(latent: DataFrame, path: str, format: str = "parquet") -> None:
    """Write latent rows as a table or as text, one row of blank-separated numbers per line."""
    if format == "parquet":
        latent.write.mode("overwrite").parquet(path)
    elif format == "text":
        numbers = [c for c in latent.columns if c.startswith("x_")]
        line = F.concat_ws(" ", *[F.col(c).cast("string") for c in numbers])
        latent.select(line.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError("format must be parquet or text")


def append_metrics(
    spark: SparkSession, path: str, run: str, metrics: Sequence[dict], n_rows: int, n_cols: int, k: int,
    app: str = "factorspark", data_set: str = "", blocks: int = 1,
) -> None:
    """Add the rounds of a run to a metrics table. There is one small dict per round."""
    rows = [
        (run, app, data_set, n_rows, n_cols, k, blocks, m["round"], m["ss"], m["dw"], m["error"], m["seconds"])
        for m in metrics
    ]
    spark.createDataFrame(rows, METRICS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row per run: rounds, total and average seconds, lists of changes and errors."""
    ordered = F.array_sort(F.collect_list(F.struct("round", "dw", "error", "seconds")))
    return (
        metrics.groupBy("run", "app", "data_set", "n_rows", "n_cols", "n_components", "blocks")
        .agg(
            F.max("round").alias("rounds"),
            F.sum("seconds").alias("total_seconds"),
            F.avg("seconds").alias("avg_seconds"),
            ordered.alias("r"),
        )
        .select(
            "run", "app", "data_set", "n_rows", "n_cols", "n_components", "blocks", "rounds",
            "total_seconds", "avg_seconds",
            F.col("r.dw").alias("dw"), F.col("r.error").alias("error"), F.col("r.seconds").alias("seconds"),
        )
    )
