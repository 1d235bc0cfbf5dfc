"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # Iterative measures and timings have no SQL; they are tested against numpy.
    assert set(QUERIES) - set(ORACLE) == {
        "append_metrics", "ppca_em_scored", "residual_spectral_norm", "relative_spectral_error"
    }


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name).startswith("ok")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["col_id", "w_0", "w_1"] and df.count() == 200
