from __future__ import annotations

import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factorspark import Limits, SparseMatrix, tune  # noqa: E402

# Limits so low that a small matrix goes every way a large one would.
FORMS = {
    "broadcast": Limits(),
    "shuffled": Limits(broadcast_bytes=0),
    "hot": Limits(hot_cells=4),
    "hot_shuffled": Limits(broadcast_bytes=0, hot_cells=4),
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def sparse(seed: int, n: int, d: int, share: float = 0.3) -> np.ndarray:
    """Whole numbers with an empty row, an empty column and, for larger ones, one full row and column."""
    rng = np.random.default_rng(seed)
    y = rng.integers(1, 9, (n, d)) * (rng.random((n, d)) < share)
    y[2, :], y[:, 1] = rng.integers(1, 9, d), rng.integers(1, 9, n)
    y[n // 2, :], y[:, d // 2] = 0, 0
    return y.astype(float)


def entries_of(spark, y: np.ndarray, site: np.ndarray | None = None):
    rows = []
    for i, j in zip(*np.nonzero(y)):
        cell = (int(i), int(j), float(y[i, j]))
        rows.append(cell if site is None else (str(site[i]), *cell))
    schema = "row_id bigint, col_id bigint, value double"
    return spark.createDataFrame(rows, schema if site is None else f"site string, {schema}")


def matrix_of(spark, y: np.ndarray, limits: Limits = FORMS["broadcast"], site: np.ndarray | None = None):
    if site is None:
        return SparseMatrix(entries_of(spark, y), *y.shape, limits=limits)
    names, counts = np.unique(site, return_counts=True)
    site_rows = spark.createDataFrame([(str(s), int(c)) for s, c in zip(names, counts)], "site string, n_rows bigint")
    return SparseMatrix(entries_of(spark, y, site), *y.shape, site_rows=site_rows, limits=limits)


def factor_of(spark, w: np.ndarray, prefix: str = "w"):
    k = w.shape[1]
    schema = ", ".join(["col_id bigint", *[f"{prefix}_{j} double" for j in range(k)]])
    return spark.createDataFrame([(c, *map(float, row)) for c, row in enumerate(w)], schema)


def dense(df, size: int, prefix: str, key: str = "col_id") -> np.ndarray:
    """A table with numbered columns as an array; rows that are missing are zero."""
    numbered = sorted((c for c in df.columns if c.startswith(f"{prefix}_")), key=lambda c: int(c.split("_")[1]))
    out = np.zeros((size, len(numbered)))
    for row in df.collect():
        out[row[key]] = [row[c] for c in numbered]
    return out


def square(df, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for row in df.collect():
        out[row["i"], row["j"]] = row["value"]
    return out
