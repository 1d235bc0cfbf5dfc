"""What the corpus operators share: tables, written steps, batches of rows in Arrow form."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.session import new_dir

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, survives the loss of executors, is computed once."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind what `written` returned, once nothing that is still to run reads it."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that no column of `df` has, nor has with a line added."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows in an Arrow batch; batches are cut by bytes as well (`spark.sql.execution.arrow.maxBytesPerBatch`)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release(collect: bool = True) -> None:
    """Give memory that is free back to the system; a Python worker is kept for other steps. Looking for cycles takes a while."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step over batches that calls `release` when it is through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: CRC-32 of the id's text leaves 1 when divided by 3. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about `most` characters together; a longer text is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
