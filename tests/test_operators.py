import numpy as np
import pytest
from conftest import FORMS, dense, entries_of, factor_of, matrix_of, sparse, square
from pyspark.sql import functions as F

from factorspark import FitParams, Limits, SparseMatrix
from factorspark.functions import smalldense
from factorspark.functions.columns import gaussian, uniform
from factorspark.operators import cells, factors, moments, products, small
from factorspark.operators.accumulate import accumulate_partials
from factorspark.session import new_dir
from factorspark.sources.tables import PARTIALS_SCHEMA

N, D, K = 23, 11, 3


@pytest.fixture(scope="module")
def y():
    return sparse(7, N, D)


@pytest.fixture(scope="module")
def w():
    return np.random.default_rng(5).random((D, K))


@pytest.mark.parametrize("form", FORMS)
def test_products_and_moments(spark, y, w, form):
    m, factor = matrix_of(spark, y, FORMS[form]), factor_of(spark, w)
    mu = y.mean(axis=0)
    latent = products.multiply(m, factor, K)
    assert np.allclose(dense(latent, N, "x", "row_id"), y @ w)
    assert latent.count() == np.count_nonzero(y.any(axis=1))
    stats = moments.col_stats(m)
    means = {r["col_id"]: (r["mean"], r["deviation"], r["n_nonzero"]) for r in stats.collect()}
    for c in np.flatnonzero(y.any(axis=0)):
        assert np.allclose(means[c], (mu[c], ((y[:, c] - mu[c]) ** 2).sum(), np.count_nonzero(y[:, c])))
    assert np.isclose(moments.centered_frobenius(stats).first()[0], ((y - mu) ** 2).sum())
    offset = list(products.mean_times_factor(moments.col_means(m), factor, K).first())
    assert np.allclose(offset, mu @ w)
    x = (y - mu) @ w
    assert np.allclose(list(moments.latent_sum(latent, K).first()), N * (mu @ w))
    assert np.allclose(square(moments.gramian(latent, K, N, offset), K), x.T @ x)
    assert np.allclose(square(moments.gramian(latent, K, N), K), (y @ w).T @ (y @ w))
    assert np.allclose(dense(moments.cross_moment(m, latent, K, offset), D, "m"), (y - mu).T @ x)
    aligned = products.align_rows(m, latent, K)
    assert aligned.count() == np.count_nonzero(y)
    assert products.unmatched_rows(m, latent).count() == 0
    assert products.unmatched_rows(m, latent.filter("row_id <> 2")).count() == 1


def test_large_offset_does_not_cancel(spark):
    rng = np.random.default_rng(2)
    y = 1e6 + rng.integers(0, 9, (N, 4)).astype(float)
    w = rng.random((4, 2))
    m, mu = matrix_of(spark, y), y.mean(axis=0)
    latent = products.multiply(m, factor_of(spark, w), 2)
    x = (y - mu) @ w
    assert np.allclose(square(moments.gramian(latent, 2, N, mu @ w), 2), x.T @ x, rtol=1e-6)
    # Cells stay uncentred, so rounding grows with (offset / spread)^2, here about 1e11 * 2e-16 * N.
    got = dense(moments.cross_moment(m, latent, 2, mu @ w), 4, "m")
    assert np.abs(got - (y - mu).T @ x).max() < 1e-3 * np.abs((y - mu).T @ x).max()
    norm2 = moments.centered_frobenius(moments.col_stats(m)).first()[0]
    assert np.isclose(norm2, ((y - mu) ** 2).sum(), rtol=1e-8)


def test_salted_join_spreads_hot_keys(spark, y, w):
    m = matrix_of(spark, y, FORMS["hot_shuffled"])
    hot = {r["col_id"]: r["key_cells"] for r in m.hot_keys(["col_id"]).collect()}
    assert hot and all(np.count_nonzero(y[:, c]) == n > 4 for c, n in hot.items())
    assert matrix_of(spark, y).hot_keys(["row_id"]) is None
    assert matrix_of(spark, y, Limits(broadcast_bytes=0, hot_cells=22)).hot_keys(["row_id"]) is None


def test_block_boundaries(spark):
    for d in (1, 5, 12, 37):
        table = spark.range(d).withColumnRenamed("id", "col_id")
        for b in (1, 2, 3, 7, d):
            got = {r["col_id"]: (r["block"], r["offset"]) for r in cells.assign_column_block(table, d, b).collect()}
            for i in range(1, b + 1):
                for c in range((i - 1) * d // b, i * d // b):
                    assert got[c] == (i, c - (i - 1) * d // b)


def test_cell_filters(spark):
    rows = [(0, 0, 1.0), (0, 5, 0.0), (1, 7, 2.0), (3, 2, -1.0)]
    e = spark.createDataFrame(rows, "row_id bigint, col_id bigint, value double")
    assert sorted(map(tuple, cells.bound_nonzero(e, 7).collect())) == [(0, 0, 1.0), (3, 2, -1.0)]
    assert sorted(map(tuple, cells.rebase_ids(e, 1, 2).collect()))[0] == (-1, -2, 1.0)
    assert {r["value"] for r in cells.binarize(e).collect()} == {1.0}
    assert {r["row_id"] for r in cells.limit_rows(e, 2).collect()} == {0, 1}
    assert {r["col_id"] for r in cells.limit_cols(e, 5).collect()} == {0, 5, 2}


def test_sampling_takes_whole_rows_whatever_the_layout(spark):
    ids = spark.range(40000).withColumnRenamed("id", "row_id")
    once = {r[0] for r in cells.sample_rows(ids, 0.1).collect()}
    again = {r[0] for r in cells.sample_rows(ids.repartition(7), 0.1).collect()}
    other = {r[0] for r in cells.sample_rows(ids, 0.1, seed=1).collect()}
    assert once == again and 3600 < len(once) < 4400 and other != once
    assert cells.sample_rows(ids, 1.0).count() == 40000


def test_hashed_numbers_look_random(spark):
    t = spark.range(20000).select(
        uniform(F.col("id"), 1, 0).alias("a"), uniform(F.col("id"), 1, 1).alias("b"), gaussian(F.col("id"), 1).alias("g")
    ).toPandas()
    assert t.a.between(0, 1, inclusive="neither").all()
    assert abs(t.a.mean() - 0.5) < 0.01 and abs(t.a.std() - 12**-0.5) < 0.01
    assert abs(np.corrcoef(t.a, t.b)[0, 1]) < 0.05
    assert abs(t.g.mean()) < 0.05 and abs(t.g.std() - 1) < 0.05


def test_params():
    p = FitParams(10, subsample=20).checked(100, 10)
    assert (p.n_components, p.subsample) == (9, 1)
    assert FitParams(3, subsample=20).checked(100, 10).subsample == 7
    assert FitParams(3).checked(100, 20).subsample == 10
    with pytest.warns(UserWarning, match="n_components is 4 instead of 5"):
        assert FitParams(5, subsample=1).checked(1_234_567, 5).sample_rate == 1.0
    for bad in (FitParams(0), FitParams(11), FitParams(2, max_rounds=0), FitParams(2, sample_rate=0.0), FitParams(2, tolerance=-1.0)):
        with pytest.raises(ValueError):
            bad.checked(100, 10)


def test_small_products_both_ways(spark, w):
    t = factor_of(spark, w).withColumn("one", F.lit(1.0))
    c = [f"w_{j}" for j in range(K)]
    specs = {"ww": (c, c), "n": (["one"], ["one"]), "ow": (["one"], c)}
    for make in (small._by_aggregates, small._by_blocks):
        got = small.to_arrays(make(t, specs), specs)
        parts = make(t.withColumn("half", F.expr("if(col_id < 5, 'a', 'b')")), specs, "half")
        a = small.to_arrays(parts.filter("half = 'a'"), specs)
        assert np.allclose(a["ww"], w[:5].T @ w[:5]) and a["n"][0, 0] == 5
        assert np.allclose(got["ww"], w.T @ w) and got["n"][0, 0] == D and np.allclose(got["ow"][0], w.sum(axis=0))


def test_factor_steps(spark, w):
    factor = factor_of(spark, w)
    assert np.allclose(square(moments.factor_gramian(factor, K), K), w.T @ w)
    turn = np.random.default_rng(1).random((K, K))
    assert np.allclose(dense(factors.right_multiply(factor, turn), D, "w"), w @ turn)
    encode, sx = factors.posterior_map(factor, K, 0.5)
    assert np.allclose(sx, np.linalg.inv(w.T @ w + 0.5 * np.eye(K))) and np.allclose(dense(encode, D, "w"), w @ sx)
    basis = factors.orthonormal_basis(factor, K)
    u = dense(basis, D, "u")
    assert np.allclose(u.T @ u, np.eye(K)) and np.allclose(u @ u.T @ w, w)
    left = np.linalg.svd(w, full_matrices=False)[0]
    assert np.allclose(np.abs(left.T @ u), np.eye(K))
    assert all(u[np.abs(u[:, j]).argmax(), j] > 0 for j in range(K))
    b = np.random.default_rng(9).random((D, 2))
    flat = dense(factors.deflate(factor_of(spark, b), basis, 2, K), D, "w")
    assert np.allclose(flat, b - u @ (u.T @ b)) and np.allclose(u.T @ flat, 0)


def test_factor_change_sees_missing_columns(spark, w):
    old, new = factor_of(spark, w), factor_of(spark, w * 1.1).filter("col_id <> 4")
    row = factors.factor_change(factors.compare_factors(old, new, K), K).first()
    after = w * 1.1
    after[4] = 0
    assert np.isclose(row["dw"], np.abs(w - after).max() / np.abs(after).max())


def test_starts(spark):
    a = dense(factors.init_factor(spark, 50, 3), 50, "w")
    b = dense(factors.init_factor(spark, 50, 3).repartition(9), 50, "w")
    assert np.array_equal(a, b) and ((a > 0) & (a < 1)).all() and np.linalg.matrix_rank(a) == 3
    assert not np.array_equal(a, dense(factors.init_factor(spark, 50, 3, seed=1), 50, "w"))
    fixed = dense(factors.init_validation(spark), 5, "w")
    assert np.array_equal(fixed, np.array(factors.VALIDATION_FACTOR))
    with pytest.raises(ValueError):
        factors.init_factor(spark, 5, 2, "zeros")


def test_singular_is_refused(spark, w):
    flat = np.column_stack([w[:, 0], 2 * w[:, 0]])
    with pytest.raises(smalldense.RankError):
        factors.orthonormal_basis(factor_of(spark, flat), 2)
    with pytest.raises(smalldense.RankError):
        smalldense.inverse(np.zeros((2, 2)))
    full = smalldense.whitener(np.diag([4.0, 1.0]))
    assert np.allclose(full, np.diag([0.5, 1.0]))
    assert smalldense.whitener(np.array([[1.0, 1.0], [1.0, 1.0]])).shape == (2, 1)


def test_tall_orthonormalize(spark, y, w):
    mu = y.mean(axis=0)
    z = (y - mu) @ w
    moment = factor_of(spark, (y - mu).T @ z, "m")
    q = np.linalg.qr(z)[0]
    got = dense(factors.tall_orthonormalize(moment, z.T @ z), D, "w")
    want = (y - mu).T @ q
    assert np.allclose(got * np.sign(got[0]), want * np.sign(want[0]))


def test_accumulate_counts_each_site_once(spark):
    rows = [(0, s, "M", i, 0, float(i + 1)) for s in "abc" for i in range(3)]
    rows += [(0, "b", "M", i, 0, float(i + 1)) for i in range(3)]
    rows += [(1, s, "M", 0, 0, 1.0) for s in "ab"]
    got = accumulate_partials(spark.createDataFrame(rows, PARTIALS_SCHEMA), 3)
    assert {(r["round"], r["i"]): r["value"] for r in got.collect()} == {(0, 0): 3.0, (0, 1): 6.0, (0, 2): 9.0}


def test_accumulate_moves_cells_once(spark):
    rows = [(0, s, "M", i, 0, None if i == 2 else float(i)) for s in "ab" for i in range(3)]
    # Site b sends no cells of kind N, and says so.
    rows += [(0, "a", "N", 0, 0, 5.0)]
    counts = [(0, "a", "M", -1, -1, 3.0), (0, "b", "M", -1, -1, 3.0), (0, "a", "N", -1, -1, 1.0), (0, "b", "N", -1, -1, 0.0)]
    path = new_dir(spark, "sent")
    spark.createDataFrame(rows + counts, PARTIALS_SCHEMA).write.parquet(path)
    got = accumulate_partials(spark.read.schema(PARTIALS_SCHEMA).parquet(path), 2, announced=True)
    assert {(r["kind"], r["i"]): r["value"] for r in got.collect()} == {("M", 0): 0.0, ("M", 1): 2.0, ("M", 2): None, ("N", 0): 5.0}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1


def test_facts_are_counted_before_sites_are_joined(spark):
    facts = spark.createDataFrame([(r, c, 1.0) for r in range(4) for c in range(3)], "r int, c int, v double")
    site_rows = spark.createDataFrame([("a", 4), ("b", 4)], "site string, n_rows bigint")
    never = facts.withColumn("site", F.raise_error(F.concat(F.lit("joined "), F.col("r"))).cast("string"))
    m = SparseMatrix.from_table(never, "r", "c", "v", 4, 3, facts=facts, site_rows=site_rows, limits=Limits(hot_cells=2, max_hot=4))
    assert m.n_cells == 12 and m.hot_keys(["col_id"]) is not None
    cold = SparseMatrix.from_table(never, "r", "c", "v", 4, 5, facts=facts, site_rows=site_rows, limits=Limits(hot_cells=3))
    assert cold.hot_keys(cold.row_keys) is None
    # Three facts of a row, but no more than two at a site.
    split = facts.withColumn("site", F.when((F.col("c") > 1) & (F.col("r") > 0), "b").otherwise("a"))
    m = SparseMatrix.from_table(split, "r", "c", "v", 4, 3, facts=facts, site_rows=site_rows, limits=Limits(hot_cells=2, max_hot=100))
    assert [(h["site"], h["row_id"]) for h in m.hot_keys(m.row_keys).collect()] == [("a", 0)]


def test_profile(spark, y):
    row = moments.matrix_profile(matrix_of(spark, y)).first()
    assert row["n_rows_stored"] == np.count_nonzero(y.any(axis=1)) and row["n_nonzero"] == np.count_nonzero(y)
    assert np.isclose(row["density"], np.count_nonzero(y) / (N * D))


def test_filters_reach_the_scan(spark, tmp_path, y):
    path = str(tmp_path / "cells")
    entries_of(spark, y).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # else the plan's text is cut short
    plan = cells.bound_nonzero(spark.read.parquet(path), 5)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThan(col_id,5)" in plan and "Not(EqualTo(value,0.0))" in plan


@pytest.mark.parametrize("k", [2, 3, 4, 10])
@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_products_keep_what_is_not_finite(spark, k, bad):
    """Both forms of the sums leave out nulls and let NaN and infinity through."""
    rows = [[1.0 + j for j in range(k)], [None] * k, [2.0] * k, [bad] + [1.0] * (k - 1)]
    df = spark.createDataFrame(rows, ", ".join(f"x_{j} double" for j in range(k)))
    spec = {"xx": ([f"x_{j}" for j in range(k)],) * 2}
    for form in (small._by_aggregates, small._by_blocks):
        got = small.to_arrays(form(df, spec), spec)["xx"]
        assert not np.isfinite(got[0]).any() and np.isfinite(got[1:, 1:]).all() and got[1, 1] == 4.0 + 4.0 + 1.0
        clean = small.to_arrays(form(df.limit(3), spec), spec)["xx"]
        assert clean[0, 1] == 1.0 * 2.0 + 4.0


def test_groups_keep_their_type(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "g bigint, x double")
    for form in (small._by_aggregates, small._by_blocks):
        assert {(r.g, r.value) for r in form(df, {"xx": (["x"], ["x"])}, "g").collect()} == {(1, 13.0), (2, 1.0)}


def test_stray_cells_and_sites_raise(spark):
    for row, col in ((0, 3), (0, -1), (4, 0), (-1, 0)):
        cells_ = spark.createDataFrame([(0, 0, 1.0), (row, col, 1.0)], "row_id bigint, col_id bigint, value double")
        with pytest.raises(Exception, match="outside the matrix"):
            moments.col_stats(SparseMatrix(cells_, 4, 3)).collect()
    sited = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 1, 0, 1.0)], "site string, row_id bigint, col_id bigint, value double")
    known = spark.createDataFrame([("a", 4)], "site string, n_rows bigint")
    with pytest.raises(Exception, match="lacks the site b"):
        moments.col_stats(SparseMatrix(sited, 4, 3, site_rows=known)).collect()
    facts, owners = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, s string")
    with pytest.raises(Exception, match="no owner"):
        products.attach_site(facts, owners, "k", "s").collect()


def test_many_facts_are_dealt_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(products, "FACTS_PER_TASK", 10)
    facts = spark.range(70).select((F.col("id") % 5).alias("k"), "id")
    owners = spark.createDataFrame([(k, f"s{k % 2}") for k in range(5)], "k bigint, s string")
    found = products.attach_site(facts, owners, "k", "s", n_facts=70)
    assert found.rdd.getNumPartitions() == 7
    assert {(r["id"], r["site"]) for r in found.collect()} == {(i, f"s{i % 5 % 2}") for i in range(70)}
