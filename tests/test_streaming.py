import glob
import os
from types import SimpleNamespace

import pytest

from factorspark.operators.accumulate import PARTIALS_SCHEMA, accumulate_partials
from factorspark.session import new_dir, shared_dir
from factorspark.sources.tables import read_partials, write_partials
from factorspark.streaming.arrivals import accumulate_partials_stream, read_sums

SITES = ("a", "b", "c")


def cells(spark, r, site, n=20):
    rows = [(r, site, "YtX", i, j, float(i + j + ord(site))) for i in range(n) for j in range(2)]
    return spark.createDataFrame(rows, PARTIALS_SCHEMA).repartition(3)


def finished(store):
    return bool(glob.glob(f"{store}/sums/round=*"))


def values(df):
    return {(r["round"], r["kind"], r["i"], r["j"]): r["value"] for r in df.collect()}


def test_stream_equals_batch_with_late_and_repeated_sites(spark):
    source, store = new_dir(spark, "in"), new_dir(spark, "out")

    def step():
        accumulate_partials_stream(spark, source, store, len(SITES)).awaitTermination()

    for site in ("a", "b"):
        write_partials(cells(spark, 0, site), source)
    step()
    assert not finished(store)
    write_partials(cells(spark, 0, "a"), source)
    write_partials(cells(spark, 1, "c"), source)
    step()
    assert not finished(store)
    write_partials(cells(spark, 0, "c"), source)
    step()
    assert {k[0] for k in values(read_sums(spark, store))} == {0}
    for site in ("b", "a"):
        write_partials(cells(spark, 1, site), source)
    step()
    write_partials(cells(spark, 0, "b"), source)
    step()
    got = values(read_sums(spark, store))
    batch = accumulate_partials(read_partials(spark, source), len(SITES), announced=True)
    assert got == values(batch) and {k[0] for k in got} == {0, 1}
    assert got[(0, "YtX", 3, 1)] == sum(4.0 + ord(s) for s in SITES)


def test_site_in_several_files_counts_when_all_are_there(spark):
    source, store, parts = new_dir(spark, "in"), new_dir(spark, "out"), new_dir(spark, "parts")
    for site in SITES:
        write_partials(cells(spark, 0, site), parts)
    files = sorted(glob.glob(f"{parts}/round=0/kind=YtX/*.parquet"))
    assert len(files) > 3
    target = f"{source}/round=0/kind=YtX"
    os.makedirs(target)
    for i, name in enumerate(files):
        with open(name, "rb") as f, open(f"{target}/{os.path.basename(name)}", "wb") as out:
            out.write(f.read())
        if i in (len(files) // 2, len(files) - 2, len(files) - 1):
            accumulate_partials_stream(spark, source, store, len(SITES)).awaitTermination()
            assert finished(store) == (i == len(files) - 1)
    assert values(read_sums(spark, store)) == values(accumulate_partials(read_partials(spark, parts), 3))


class Session:
    """Stands for a session with the given master and shared folder."""

    def __init__(self, master, folder):
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")
        self.conf = SimpleNamespace(get=lambda key, default: folder)


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_dir(Session("yarn", "hdfs://shared/work/")) == "hdfs://shared/work"
    assert new_dir(Session("yarn", "hdfs://shared/work"), "x").startswith("hdfs://shared/work/x-")
    own = shared_dir(Session("local[4]", None))
    assert os.path.isdir(own) and shared_dir(Session("local[4]", None)) == own
    with pytest.raises(ValueError):
        shared_dir(Session("yarn", None))
