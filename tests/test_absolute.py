import numpy as np
import pytest
from conftest import factor_of, matrix_of, sparse

from factorspark import Limits
from factorspark.operators.absolute import _groups, absolute_sums
from factorspark.plans import quality


def table(spark, a, prefix, key):
    return factor_of(spark, a, prefix).withColumnRenamed("col_id", key)


def dense_error(y, enc, dec):
    mu = y.mean(axis=0)
    return (y - mu) @ enc @ dec.T - (y - mu)


@pytest.mark.parametrize("piece", [37, 1 << 18])
def test_absolute_sums_equal_every_product(spark, piece):
    rng = np.random.default_rng(3)
    p, q = np.c_[rng.normal(size=(500, 2)) * [1, 1e-3], np.ones(500)], rng.normal(size=(260, 3))
    p[40:90], q[3], q[5] = p[40], 0, -q[6]
    found = absolute_sums(table(spark, p, "p", "id"), table(spark, q, "q", "id"), "id", 3, piece)
    got = {r["id"]: r["total"] for r in found.collect()}
    assert sorted(got) == list(range(260))
    assert np.allclose([got[i] for i in range(260)], np.abs(p @ q.T).sum(axis=0), rtol=1e-12)


@pytest.mark.parametrize("k", [2, 5])
def test_sums_of_errors_by_column_and_row(spark, k, monkeypatch):
    y, rng = sparse(7, 40, 11), np.random.default_rng(8)
    enc, dec = rng.normal(size=(11, k)), rng.normal(size=(11, k))
    m, error = matrix_of(spark, y), dense_error(y, enc, dec)
    means = spark.createDataFrame([(c, float(v)) for c, v in enumerate(y.mean(axis=0))], "col_id bigint, mean double")
    if k == 2:
        # The matrix of all cells is not formed, by tiles neither.
        monkeypatch.setattr(quality, "_tiles", None)
    args = (m, factor_of(spark, enc), factor_of(spark, dec), means, k)
    by_col = {r["col_id"]: (r["error"], r["norm"]) for r in quality.error_sums(*args).collect()}
    assert np.allclose([by_col[c][0] for c in range(11)], np.abs(error).sum(axis=0))
    assert np.allclose([by_col[c][1] for c in range(11)], np.abs(y - y.mean(axis=0)).sum(axis=0))
    by_row = {r["row_id"]: (r["abs_error"], r["sq_error"]) for r in quality.reconstruct_sums(*args).collect()}
    assert np.allclose([by_row[i][0] for i in range(40)], np.abs(error).sum(axis=1))
    assert np.allclose([by_row[i][1] for i in range(40)], (error**2).sum(axis=1))
    found = quality.reconstruction_interval(*args, width=0.0)
    assert found.low == found.ratio == found.high and found.rows == 40
    assert np.isclose(found.ratio, np.abs(error).sum(axis=0).max() / np.abs(y - y.mean(axis=0)).sum(axis=0).max())


@pytest.mark.parametrize("rows", [(500, 260), (260, 500)])
def test_pieces_move_once_for_each_group_of_the_others(spark, rows, monkeypatch):
    """Neither table can be broadcast whole; no record holds a pair of pieces until they meet in a task."""
    rng = np.random.default_rng(5)
    p, q = (rng.normal(size=(n, 3)) for n in rows)
    points, queries = table(spark, p, "p", "id"), table(spark, q, "q", "id")
    parts, whole = [], type(points).repartition
    monkeypatch.setattr(type(points), "repartition", lambda self, n, *by: parts.append((n, by)) or whole(self, n, *by))
    got = {r["id"]: r["total"] for r in absolute_sums(points, queries, "id", 3, 20, Limits(broadcast_bytes=100 * 64)).collect()}
    assert np.allclose([got[i] for i in range(rows[1])], np.abs(p @ q.T).sum(axis=0), rtol=1e-12)
    assert len(parts) > 2 and all(n <= 60 and len(by) == 1 for n, by in parts)


def test_groups_of_pieces_fit(spark):
    pieces = spark.createDataFrame([(f"{i}", bytes(24 * n)) for i, n in enumerate([40, 40, 40, 300, 1, 2])], "p_piece string, p_data binary")
    assert _groups(pieces, "p_piece", 3, Limits(broadcast_bytes=100 * 64)) == [["0", "1"], ["2"], ["3"], ["4", "5"]]
