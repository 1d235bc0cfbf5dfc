"""Session settings, size limits and the shared folder for written tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Limits:
    """Sizes that decide between physical forms; every form gives the same result.

    broadcast_bytes  largest table that is broadcast; its size is always computed first
    hot_cells        a row or column with more cells than this is treated on its own
    max_hot          at most this many rows (columns) can count as hot, whatever the input
    cells_per_part   target number of cells in one partition of a prepared matrix
    """

    broadcast_bytes: int = 256 << 20
    hot_cells: int = 1_000_000
    max_hot: int = 100_000
    cells_per_part: int = 2_000_000

    def fits(self, rows: int, doubles: int) -> bool:
        """Can a table of `rows` keyed rows with `doubles` numbers each be broadcast?"""
        return rows * (8 * doubles + 40) <= self.broadcast_bytes

    def hot_limit(self, cells: int) -> int:
        """Cells above which a key is hot. No more than `max_hot` keys can exceed it."""
        return max(self.hot_cells, cells // self.max_hot)


DEFAULT_LIMITS = Limits()

_own_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans rely on for speed (never for correctness)."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Entries are laid out by `part`; joins on (part, row_id) may then stay in place.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local"):
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="factorspark-")
        return _own_dirs[context.applicationId]
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return target.getFileSystem(conf).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing still to run reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file, unless it is there: of several that try at once one succeeds."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        # Hadoop looks first and creates then on local folders, so two could succeed; the system's own call is one step.
        system.mkdirs(target.getParent())
        return jvm.java.io.File(target.toUri().getPath()).createNewFile()
    try:
        return system.createNewFile(target)
    except Py4JJavaError as failed:
        if not failed.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            raise
        return False


def table_done(spark: SparkSession, path: str) -> bool:
    """Was the table at `path` written to the end?"""
    return path_exists(spark, f"{path}/_SUCCESS")
