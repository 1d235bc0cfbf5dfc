"""Sums of partial matrices that several sites deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIALS_SCHEMA = "round int, site string, kind string, i bigint, j int, value double"

# A row at this position tells how many cells its site sends for a round and kind.
COUNT_ROW = -1


def with_counts(partials: DataFrame) -> DataFrame:
    """Add one row per (round, site, kind) that announces the number of its cells."""
    counts = partials.groupBy("round", "site", "kind").agg(F.count(F.lit(1)).cast("double").alias("value"))
    counts = counts.select(
        "round", "site", "kind", F.lit(COUNT_ROW).cast("bigint").alias("i"), F.lit(COUNT_ROW).alias("j"), "value"
    )
    return partials.select("round", "site", "kind", "i", "j", "value").unionByName(counts)


def distinct_cells(partials: DataFrame) -> DataFrame:
    """Each cell of each site once, however often its file was delivered; those of one place come together."""
    placed = partials.repartition("round", "kind", "i")
    return placed.groupBy("round", "kind", "site", "i", "j").agg(F.max("value").alias("value"))


def complete_rounds(partials: DataFrame, n_sites: int, announced: bool = False) -> DataFrame:
    """The `(round, kind)` for which every site has arrived.

    With `announced` a site has arrived when it has as many cells as it said it would send.
    """
    keys = ["round", "kind", "site"]
    # All cells count, whatever their value; as it is read, the same shuffle serves their sums.
    cells = (F.count("value") + F.count_if(F.col("value").isNull())).alias("cells")
    sent = distinct_cells(partials.filter(F.col("i") != COUNT_ROW)).groupBy(*keys).agg(cells)
    told = partials.filter(F.col("i") == COUNT_ROW).groupBy(*keys).agg(F.max("value").alias("announced"))
    sites = sent.unionByName(told, allowMissingColumns=True).groupBy(*keys).agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.max("announced").alias("announced")
    )
    if announced:
        sites = sites.filter(F.col("cells") == F.col("announced"))
    done = sites.groupBy("round", "kind").agg(F.count(F.lit(1)).alias("arrived"))
    return done.filter(F.col("arrived") == n_sites).select("round", "kind")


def accumulate_partials(partials: DataFrame, n_sites: int, announced: bool = False) -> DataFrame:
    """Sum the partial matrices of all sites, for complete rounds only.

    How the sites are connected (tree, star or shared storage) does not change the sum.
    """
    # One shuffle serves counts and sums if both read the same cells: nulls, which the join drops, are dropped before,
    # and a semi-join would be moved below the sums. There are a few kinds in a round.
    partials = partials.filter(F.col("round").isNotNull() & F.col("kind").isNotNull())
    done = complete_rounds(partials, n_sites, announced)
    cells = distinct_cells(partials.filter(F.col("i") != COUNT_ROW))
    sums = cells.groupBy("round", "kind", "i", "j").agg(F.sum("value").alias("value"))
    return sums.join(F.broadcast(done), ["round", "kind"])


def wide(partials: DataFrame, k: int, key: str = "col_id", prefix: str = "p") -> DataFrame:
    """Long cells `(i, j, value)` as rows `(key, prefix_0 ..)`."""
    return partials.groupBy(F.col("i").alias(key)).agg(
        *[F.sum(F.when(F.col("j") == j, F.col("value"))).alias(f"{prefix}_{j}") for j in range(k)]
    )


def long(table: DataFrame, k: int, key: str, prefix: str) -> DataFrame:
    """Rows `(key, prefix_0 ..)` as cells `(i, j, value)`, other columns kept."""
    kept = [c for c in table.columns if c != key and not c.startswith(f"{prefix}_")]
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"{prefix}_{j}").alias("value")) for j in range(k)])
    return table.select(*kept, F.col(key).cast("bigint").alias("i"), F.inline(cells))
