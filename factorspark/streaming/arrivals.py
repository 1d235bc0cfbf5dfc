"""Sums of partial matrices whose files arrive one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorspark.operators.accumulate import PARTIALS_SCHEMA, accumulate_partials


def accumulate_partials_stream(
    spark: SparkSession, source: str, store: str, n_sites: int, continuous: str | None = None
) -> StreamingQuery:
    """Watch a folder for partials and add the sum of a (round, kind) once all sites are there.

    Sites announce how many cells they send (`write_partials` does), so a site whose files
    come over several batches counts when the last one is in. Arrivals are kept in a table
    and not in the state store: they are as large as the factors, and only the rounds that
    a batch touches are read again. Each batch writes folders of its own and replaces
    whole (round, kind) results, so a repeated batch or a repeated file changes nothing.

    Runs until what is there is done, or every `continuous` interval for ever.
    """
    landing = f"{store}/arrived"

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("round", "kind").parquet(f"{landing}/batch={batch_id}")
        arrived = session.read.schema(f"{PARTIALS_SCHEMA}, batch bigint").parquet(landing)
        arrived = arrived.filter(F.col("batch") <= batch_id)
        touched = arrived.filter(F.col("batch") == batch_id).select("round", "kind").distinct().collect()
        if not touched:
            return
        wanted = reduce(
            lambda a, b: a | b, [(F.col("round") == t["round"]) & (F.col("kind") == t["kind"]) for t in touched]
        )
        sums = accumulate_partials(arrived.filter(wanted).drop("batch"), n_sites, announced=True)
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round", "kind").parquet(
            f"{store}/sums"
        )

    stream = spark.readStream.schema(PARTIALS_SCHEMA).parquet(source)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{store}/progress")
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def read_sums(spark: SparkSession, store: str) -> DataFrame:
    """The finished sums, `(round, kind, i, j, value)`."""
    return spark.read.schema("i bigint, j int, value double, round int, kind string").parquet(f"{store}/sums").select(
        "round", "kind", "i", "j", "value"
    )
