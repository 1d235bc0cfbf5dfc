import os

import numpy as np
import pytest
from conftest import dense, entries_of, sparse
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from factorspark.operators.accumulate import complete_rounds
from factorspark.session import new_dir
from factorspark.sources import readers, tables, writers


def write(path, **files):
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        with open(f"{path}/{name}.txt", "w") as f:
            f.write(text)
    return str(path)


def cells(df):
    return {(r["row_id"], r["col_id"]): r["value"] for r in df.collect()}


def test_dense_text_numbers_rows_across_files(spark, tmp_path):
    path = write(tmp_path / "in", b="4 5 6\n", a="1 0 2.5\n\n  3\t1e2 -1 \n", c="\n7 8 9")
    got = readers.read_dense_text(spark, path)
    want = [[1, 0, 2.5], [3, 100, -1], [4, 5, 6], [7, 8, 9]]
    assert cells(got) == {(i, j): v for i, row in enumerate(want) for j, v in enumerate(row)}


def test_dense_text_in_many_splits(spark, tmp_path):
    lines = [f"{i} {i * i}" for i in range(3000)]
    path = write(tmp_path / "in", a="\n".join(lines[:1700]), b="\n".join(lines[1700:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.numbered_lines(spark, path)
        assert got.rdd.getNumPartitions() > 4
        assert [r["line"] for r in got.orderBy("row_id").collect()] == lines
        assert got.agg(F.max("row_id")).first()[0] == 2999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_coo_text_needs_no_order(spark, tmp_path):
    text = {"a": "12 13 1.5\n14 14 2\n12 13 2.5\n", "b": "14 15\n12 15 7\n\n14 14 0\n"}
    path = write(tmp_path / "in", **text)
    got = cells(readers.read_coo_text(spark, path, base=1, shift=12))
    assert got == {(0, 0): 2.5, (0, 2): 7.0, (2, 1): 0.0, (2, 2): 1.0}
    summed = cells(readers.read_coo_text(spark, path, base=1, shift=12, repeated="sum"))
    assert summed == {(0, 0): 4.0, (0, 2): 7.0, (2, 1): 2.0, (2, 2): 1.0}
    ones = cells(readers.read_coo_text(spark, path, base=1, shift=12, binary=True))
    assert set(ones) == set(got) and set(ones.values()) == {1.0}
    with pytest.raises(ValueError):
        readers.read_coo_text(spark, path, repeated="first")


def test_rows_and_vectors(spark):
    rows = spark.createDataFrame(
        [(0, [0, 3, 9], [1.0, 0.0, 5.0]), (4, [2], [7.0]), (5, [], [])],
        "row_id bigint, indices array<int>, values array<double>",
    )
    assert cells(readers.read_rows(rows, 9)) == {(0, 0): 1.0, (4, 2): 7.0}
    vectors = spark.createDataFrame([(1, Vectors.sparse(4, {2: 3.0})), (2, Vectors.dense([1.0, 0, 0, 2]))], ["r", "v"])
    want = {(1, 2): 3.0, (2, 0): 1.0, (2, 3): 2.0}
    assert cells(readers.from_vector_column(vectors, "r", "v")) == want
    arrays = spark.createDataFrame([(1, [0.0, 0.0, 3.0, 0.0]), (2, [1.0, 0.0, 0.0, 2.0])], "r int, v array<float>")
    assert cells(readers.from_vector_column(arrays, "r", "v")) == want
    wide = arrays.select(F.col("r").alias("row_id"), *[F.col("v")[j].alias(f"x_{j}") for j in range(4)])
    assert cells(readers.dense_to_entries(wide, "x")) == want


def test_text_forms(spark):
    y = sparse(1, 7, 5)
    entries = entries_of(spark, y)
    path = new_dir(spark, "forms")
    writers.save_result(entries, f"{path}/dense", 7, 5, "dense")
    lines = [r["line"] for r in readers.numbered_lines(spark, f"{path}/dense").orderBy("row_id").collect()]
    assert lines == [" ".join(str(v) for v in row) for row in y]
    raw = spark.read.text(f"{path}/dense").collect()
    assert all(r["value"].endswith(" ") for r in raw)
    writers.save_result(entries, f"{path}/lil", 7, 5, "lil")
    got = sorted(r["value"] for r in spark.read.text(f"{path}/lil").collect())
    assert got == sorted("{" + ",".join(f"{j}:{v}" for j, v in enumerate(row) if v) + "}" for row in y)
    assert "{}" in got
    writers.save_result(entries, f"{path}/coo", 7, 5, "coo")
    assert cells(readers.read_coo_text(spark, f"{path}/coo")) == cells(entries)
    writers.save_result(entries, f"{path}/parquet", 7, 5)
    assert cells(spark.read.parquet(f"{path}/parquet")) == cells(entries)
    full = {r["row_id"]: r["values"] for r in writers.entries_to_dense(entries, 7, 5).collect()}
    assert np.array_equal(np.array([full[i] for i in range(7)]), y)
    with pytest.raises(ValueError):
        writers.save_result(entries, path, 7, 5, "xml")


def test_factor_blocks(spark):
    w = np.random.default_rng(3).random((23, 2))
    rows = [(c, *map(float, v)) for c, v in enumerate(w)]
    table = spark.createDataFrame(rows, "col_id bigint, w_0 double, w_1 double")
    path = new_dir(spark, "factor")
    tables.save_factor(table, path, 3, 23, blocks=5)
    assert np.array_equal(dense(tables.load_factor(spark, path, 3, 2), 23, "w"), w)
    block = tables.load_factor(spark, path, 3, 2, block=2)
    assert sorted(r["col_id"] for r in block.collect()) == list(range(4, 9))
    plan = block._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan


def test_partials_are_announced(spark):
    path = new_dir(spark, "partials")
    rows = [(0, "a", "M", 0, 0, 1.0), (0, "a", "M", 0, 1, 2.0), (0, "b", "M", 0, 0, 3.0)]
    tables.write_partials(spark.createDataFrame(rows, tables.PARTIALS_SCHEMA), path)
    back = tables.read_partials(spark, path)
    announced = {r["site"]: r["value"] for r in back.filter("i = -1").collect()}
    assert announced == {"a": 2.0, "b": 1.0}
    assert complete_rounds(back, 2, announced=True).count() == 1
    assert complete_rounds(back.filter("not (site = 'a' and j = 1)"), 2, announced=True).count() == 0


def test_metrics_append(spark):
    path = new_dir(spark, "metrics")
    for run in ("a", "b"):
        rounds = [{"round": r, "ss": None, "dw": 1.0 / r, "error": None, "seconds": 0.5} for r in (1, 2)]
        tables.append_metrics(spark, path, run, rounds, 10, 5, 2)
    out = {r["run"]: r for r in tables.run_summary(spark.read.parquet(path)).collect()}
    assert set(out) == {"a", "b"} and out["a"]["rounds"] == 2 and out["a"]["dw"] == [1.0, 0.5]
    assert out["b"]["total_seconds"] == 1.0


def test_projection_text(spark):
    latent = spark.createDataFrame([(0, 1.5, -2.0)], "row_id bigint, x_0 double, x_1 double")
    path = new_dir(spark, "projection")
    tables.save_projection(latent, path, "text")
    assert [r["value"] for r in spark.read.text(path).collect()] == ["1.5 -2.0"]
