import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pytest
from conftest import FORMS, dense, entries_of, factor_of, matrix_of, sparse
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors

from factorspark import FitParams, SparseMatrix
from factorspark.functions.columns import combine, names
from factorspark.operators import moments
from factorspark.operators.accumulate import PARTIALS_SCHEMA
from factorspark.operators.factors import VALIDATION_FACTOR, VALIDATION_SS, init_factor
from factorspark.operators.small import combine_by_blocks
from factorspark.plans import em, quality, sites
from factorspark.plans import layout as plan
from factorspark.plans.layout import prepare
from factorspark.plans.transform import transform
from factorspark.session import claim, new_dir
from factorspark.sources.tables import write_partials

N, D, K = 26, 12, 3


@pytest.fixture(scope="module")
def y():
    return sparse(11, N, D, 0.5)


@pytest.fixture(scope="module")
def w():
    return np.random.default_rng(4).random((D, K))


def wide(y, w, rounds):
    yc = y - y.mean(axis=0)
    for _ in range(rounds):
        x = yc @ w
        w = yc.T @ x @ np.linalg.inv(x.T @ x) @ (w.T @ w)
    return w


def noise(y, c, ss, rounds):
    yc, (n, d) = y - y.mean(axis=0), y.shape
    for _ in range(rounds):
        sx = np.linalg.inv(c.T @ c + ss * np.eye(c.shape[1]))
        x = yc @ c @ sx
        xtx = x.T @ x + n * ss * sx
        c = yc.T @ x @ np.linalg.inv(xtx)
        ss = ((yc**2).sum() + np.trace(xtx @ c.T @ c) - 2 * (x * (yc @ c)).sum()) / (n * d)
    return c, ss, sx


@pytest.mark.parametrize("form", FORMS)
def test_every_form_gives_the_textbook_fit(spark, y, w, form):
    m, start = matrix_of(spark, y, FORMS[form]), factor_of(spark, w)
    layout = prepare(m, K, parts=3)
    assert (layout.heavy is not None) == ("hot" in form) and (layout.needs is not None) == ("shuffled" in form)
    fit = em.ppca_em_wide(m, FitParams(K, max_rounds=2), init=start, layout=layout)
    assert np.allclose(dense(fit.factor, D, "w"), wide(y, w, 2))
    assert fit.factor.count() == D
    fit = em.ppca_em(m, FitParams(K, max_rounds=2), init=start, ss=0.7, layout=layout)
    c, ss, sx = noise(y, w, 0.7, 2)
    assert np.allclose(dense(fit.factor, D, "w"), c) and np.isclose(fit.ss, ss)
    before, _, _ = noise(y, w, 0.7, 1)
    assert np.allclose(dense(fit.before, D, "w"), before) and np.allclose(fit.encoder, sx)
    layout.release()


def test_validation_start(spark):
    y = np.array([[1, 0, 2, 0, 3], [0, 4, 0, 0, 1], [5, 0, 0, 0, 0], [0, 0, 0, 0, 0], [2, 2, 1, 0, 4], [7, 1, 0, 0, 2.0]])
    w = np.array(VALIDATION_FACTOR)
    m = matrix_of(spark, y)
    fit = em.ppca_em(m, FitParams(3, max_rounds=2), init=factor_of(spark, w), ss=VALIDATION_SS)
    c, ss, _ = noise(y, w, VALIDATION_SS, 2)
    assert np.allclose(dense(fit.factor, 5, "w"), c) and np.isclose(fit.ss, ss)
    assert not dense(fit.factor, 5, "w")[3].any()


def test_many_components_use_blocks(spark, y):
    w = np.random.default_rng(4).random((D, 9))
    fit = em.ppca_em_wide(matrix_of(spark, y), FitParams(9, max_rounds=1), init=factor_of(spark, w))
    assert np.allclose(dense(fit.factor, D, "w"), wide(y, w, 1))


def test_change_stops_and_resume_continues(spark, y, w):
    m, start = matrix_of(spark, y), factor_of(spark, w)
    fit = em.ppca_em_wide(m, FitParams(K, max_rounds=60, tolerance=0.05), init=start)
    before, after = wide(y, w, fit.rounds - 1), wide(y, w, fit.rounds)
    assert fit.stopped_by == "dw" and fit.rounds < 60
    assert np.isclose(fit.metrics[-1]["dw"], np.abs(after - before).max() / np.abs(after).max())
    assert fit.metrics[-1]["dw"] <= 0.05 < fit.metrics[-2]["dw"]
    first = np.abs(wide(y, w, 1) - w).max() / np.abs(wide(y, w, 1)).max()
    assert np.isclose(fit.metrics[0]["dw"], first)

    layout = prepare(m, K, folder=new_dir(spark, "resume"))
    em.ppca_em(m, FitParams(K, max_rounds=2), init=start, ss=0.7, layout=layout)
    again = em.ppca_em(m, FitParams(K, max_rounds=4), init=start, ss=0.7, layout=layout, resume=True)
    c, ss, _ = noise(y, w, 0.7, 4)
    assert np.allclose(dense(again.factor, D, "w"), c) and np.isclose(again.ss, ss)
    assert [r["round"] for r in again.metrics] == [1, 2, 3, 4]


def test_resume_notices_other_values(spark, y, w):
    """The same places and sums of values, but two cells of a column changed about."""
    folder, start = new_dir(spark, "values"), factor_of(spark, w)
    other = y.copy()
    i, j = np.flatnonzero(y[:, 3])[:2]
    assert y[i, 3] + 1 != y[j, 3]
    other[i, 3], other[j, 3] = y[i, 3] + 1, y[j, 3] - 1
    fits = lambda x, **a: em.ppca_em_wide(
        m := matrix_of(spark, x), FitParams(K, max_rounds=2), init=start, layout=prepare(m, K, folder=folder), **a)
    first = dense(fits(y).factor, D, "w")
    assert np.array_equal(dense(fits(y, resume=True).factor, D, "w"), first)
    with pytest.raises(ValueError, match="other cells"):
        fits(other, resume=True)
    assert np.allclose(dense(fits(other).factor, D, "w"), wide(other, w, 2)) and not np.allclose(first, wide(other, w, 2))


def test_two_fits_at_once_do_not_meet(spark, y, w):
    m, start = matrix_of(spark, y), factor_of(spark, w)
    layout = prepare(m, K, folder=new_dir(spark, "both"))
    loops = [em.Loop(layout, K, em.wide_update, max_rounds=1) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        folders = list(pool.map(lambda x: x._own_folder(start, None, False), loops))
    assert len(set(folders)) == 4


def test_one_of_many_claims_succeeds(spark):
    folder = new_dir(spark, "claims")
    with ThreadPoolExecutor(8) as pool:
        for n in range(50):
            assert sum(pool.map(lambda _: claim(spark, f"{folder}/{n}/owner"), range(8))) == 1


def test_resume_continues_its_own_rounds_only(spark, y, w):
    m, start, other = matrix_of(spark, y), factor_of(spark, w), factor_of(spark, w + 1)
    layout = prepare(m, K, folder=new_dir(spark, "two-fits"))
    first = em.ppca_em_wide(m, FitParams(K, max_rounds=3), init=start, layout=layout)
    em.ppca_em_wide(m, FitParams(K, max_rounds=1), init=other, layout=layout)
    resumed = em.ppca_em_wide(m, FitParams(K, max_rounds=3), init=other, layout=layout, resume=True)
    assert np.allclose(dense(resumed.factor, D, "w"), wide(y, w + 1, 3))
    em.ppca_em_wide(m, FitParams(K, max_rounds=1), init=start, layout=layout)
    assert np.allclose(dense(first.factor, D, "w"), wide(y, w, 3))
    for changed in (
        lambda: em.ppca_em_wide(m, FitParams(K, max_rounds=2), init=factor_of(spark, w + 2), layout=layout, resume=True),
        lambda: em.ppca_em(m, FitParams(K, max_rounds=2), init=start, ss=0.7, layout=layout, resume=True),
    ):
        with pytest.raises(ValueError, match="nothing to resume"):
            changed()
    layout.release()


def test_row_order_and_partitions_do_not_matter(spark, y, w):
    start = factor_of(spark, w)
    fits = []
    for parts, shuffle in ((1, 1), (7, 5)):
        m = SparseMatrix(entries_of(spark, y).repartition(shuffle), N, D)
        fit = em.ppca_em_wide(m, FitParams(K, max_rounds=2), init=start, layout=prepare(m, K, parts=parts))
        fits.append(dense(fit.factor, D, "w"))
    assert np.allclose(*fits)


def test_converges_to_principal_components(spark):
    rng = np.random.default_rng(0)
    y = np.round(rng.normal(size=(80, 2)) @ (rng.normal(size=(2, 10)) * 6) + rng.normal(size=(80, 10)), 3) + 5
    m = matrix_of(spark, y)
    data = spark.createDataFrame([(Vectors.dense(row),) for row in y], ["v"])
    pc = PCA(k=2, inputCol="v", outputCol="p").fit(data).pc.toArray()
    values = np.linalg.svd(y - y.mean(axis=0), compute_uv=False)
    ml = (values[2:] ** 2).sum() / (80 * 8)
    for fit in (
        em.ppca_em_wide(m, FitParams(2, max_rounds=6, tolerance=1e-3)),
        em.ppca_em(m, FitParams(2, max_rounds=12)),
    ):
        u = dense(fit.components(), 10, "u")
        assert np.linalg.svd(pc.T @ u, compute_uv=False).min() > 0.999
    assert abs(fit.ss - ml) < 0.05 * ml
    falling = [r["ss"] for r in fit.metrics[1:]]
    assert all(a >= b - 1e-9 for a, b in zip(falling, falling[1:]))


def test_transform(spark, y, w):
    m, factor, mu = matrix_of(spark, y), factor_of(spark, w), y.mean(axis=0)
    stored = y.any(axis=1)
    assert np.allclose(dense(transform(m, factor, K), N, "x", "row_id"), y @ w)
    u = dense(transform(m, factor, K, "orthonormal"), N, "x", "row_id")
    assert np.allclose(u @ u.T, y @ w @ np.linalg.inv(w.T @ w) @ w.T @ y.T)
    means = spark.createDataFrame([(c, float(v)) for c, v in enumerate(mu)], "col_id bigint, mean double")
    got = dense(transform(m, factor, K, "posterior", 0.5, means), N, "x", "row_id")
    want = (y - mu) @ w @ np.linalg.inv(w.T @ w + 0.5 * np.eye(K))
    assert np.allclose(got[stored], want[stored])
    with pytest.raises(ValueError):
        transform(m, factor, K, "posterior")


# --- sites ------------------------------------------------------------------------


def site_centred(y, site):
    out = y.copy()
    for s in np.unique(site):
        out[site == s] -= y[site == s].mean(axis=0)
    return out


def pooled(yc, w, rounds):
    for _ in range(rounds):
        x = yc @ w
        w = yc.T @ x @ np.linalg.inv(x.T @ x) @ (w.T @ w)
    return w


@pytest.mark.parametrize("form", FORMS)
def test_sites_equal_pooled_rows_centred_by_site(spark, y, w, form):
    site = np.array(["a", "b", "c"])[np.random.default_rng(3).integers(0, 3, N)]
    m, start = matrix_of(spark, y, FORMS[form], site), factor_of(spark, w)
    want = pooled(site_centred(y, site), w, 2)
    layout = prepare(m, K, parts=3)
    ways = ("direct", "partials") if form in ("broadcast", "hot_shuffled") else ("direct",)
    for exchange in ways:
        fit = sites.ppca_em_sites(m, FitParams(K, max_rounds=2), init=start, exchange=exchange, layout=layout)
        assert np.allclose(dense(fit.factor, D, "w"), want)
    if form == "broadcast":
        other = sites.ppca_em_sites(m, FitParams(K, max_rounds=2), init=start, center="global", layout=layout)
        assert np.allclose(dense(other.factor, D, "w"), wide(y, w, 2)) and not np.allclose(want, wide(y, w, 2))
    layout.release()


def test_sites_send_what_one_pass_gives(spark, y, w):
    site = np.array(["a", "b"])[np.arange(N) % 2]
    m, read = matrix_of(spark, y, site=site), spark.sparkContext.accumulator(0)
    layout = prepare(m, K)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = replace(layout, light=layout.light.mapInArrow(counted, layout.light.schema))
    write_partials(sites.site_partials(seen, factor_of(spark, w), K, 0), new_dir(spark, "sent"))
    # A pass reads cells for the latent rows and once more beside them.
    assert read.value <= 2 * np.count_nonzero(y)
    seen.release()


def test_site_partials(spark, y, w):
    site = np.array(["a", "b"])[np.arange(N) % 2]
    m = matrix_of(spark, y, site=site)
    got = sites.site_partials(prepare(m, K), factor_of(spark, w), K, 4)
    assert got.columns == [c.split()[0] for c in PARTIALS_SCHEMA.split(", ")]
    yc = site_centred(y, site)
    for row in got.collect():
        part = yc[site == row["site"]]
        want = (part @ w).T @ (part @ w) if row["kind"] == "XtX" else part.T @ (part @ w)
        assert row["round"] == 4 and np.isclose(row["value"], want[row["i"], row["j"]])


# --- quality ----------------------------------------------------------------------


@pytest.mark.parametrize("tile", [4, 1024])
@pytest.mark.parametrize("form", ["broadcast", "hot_shuffled"])
def test_reconstruction_error(spark, y, w, tile, form, monkeypatch):
    monkeypatch.setattr(quality, "TILE", tile)
    m, mu = matrix_of(spark, y, FORMS[form]), y.mean(axis=0)
    yc = y - mu
    e = w @ np.linalg.inv(w.T @ w + 0.3 * np.eye(K))
    means = spark.createDataFrame([(c, float(v)) for c, v in enumerate(mu)], "col_id bigint, mean double")
    err = yc @ e @ w.T - yc
    args = (m, factor_of(spark, e), factor_of(spark, w), means, K)
    want = np.abs(err).sum(axis=0).max() / np.abs(yc).sum(axis=0).max()
    assert np.isclose(quality.reconstruction_error(*args, rate=1.0), want)
    got = np.zeros((N, D))
    for row in quality.reconstruct_sample(*args, rate=1.0).collect():
        got[row["row_id"], row["block"] * tile : row["block"] * tile + len(row["errors"])] = row["errors"]
    assert np.allclose(got, err)
    if tile == 4:
        taken = {r["row_id"] for r in quality.reconstruct_sample(*args, rate=0.5).collect()}
        sums = {r["col_id"]: r["error"] for r in quality.error_sums(*args, rate=0.5).collect()}
        assert 0 < len(taken) < N
        assert np.allclose([sums[c] for c in range(D)], np.abs(err[sorted(taken)]).sum(axis=0))


def test_error_interval_holds_the_exact_error(spark):
    rng = np.random.default_rng(12)
    n, d = 400, 9
    x = rng.integers(1, 9, (n, d)) * (rng.random((n, d)) < 0.1)
    x[:, 4] *= rng.random(n) < 0.5
    yc = x - x.mean(axis=0)
    c = np.linalg.svd(yc, full_matrices=False)[2][:2].T
    want = np.abs(yc @ c @ c.T - yc).sum(axis=0).max() / np.abs(yc).sum(axis=0).max()
    m = matrix_of(spark, x.astype(float))
    args = m, factor_of(spark, c), factor_of(spark, c), moments.col_means(m), 2
    exact = quality.reconstruction_interval(*args, width=0.0)
    assert exact.rows == n and all(np.isclose(v, want) for v in exact[:3]) and np.isclose(quality.reconstruction_error(*args), want)
    held = [quality.reconstruction_interval(*args, width=0.3, rows=64, seed=seed) for seed in range(8)]
    assert sum(e.low <= want <= e.high for e in held) >= 7
    assert all(e.high - e.low <= 0.3 and e.rows < n for e in held)


def test_fit_stops_on_the_reconstruction_error(spark, y, w):
    m, start = matrix_of(spark, y), factor_of(spark, w)
    yc = y - y.mean(axis=0)
    want = []
    for r in (1, 2):
        before = noise(y, w, 0.7, r - 1)[0] if r > 1 else w
        c, _, sx = noise(y, w, 0.7, r)
        want.append(np.abs(yc @ before @ sx @ c.T - yc).sum(axis=0).max() / np.abs(yc).sum(axis=0).max())
    layout = prepare(m, K)
    score = quality.reconstruction_score(layout, K, rate=1.0)
    args = dict(init=start, ss=0.7, layout=layout, score=score)
    fit = em.ppca_em(m, FitParams(K, max_rounds=2), **args)
    assert np.allclose([r["error"] for r in fit.metrics], want) and fit.stopped_by == "max_rounds"
    fit = em.ppca_em(m, FitParams(K, max_rounds=2), score_tolerance=want[0] * 1.0001, **args)
    assert fit.rounds == 1 and fit.stopped_by == "error"


@pytest.mark.parametrize("form", ["broadcast", "hot_shuffled"])
def test_residual_norm_is_the_spectral_norm(spark, y, w, form):
    m = matrix_of(spark, y, FORMS[form])
    layout = prepare(m, D)
    fit = em.ppca_em_wide(m, FitParams(K, max_rounds=2), init=factor_of(spark, w), layout=layout)
    u = dense(fit.components(), D, "u")
    yc = y - y.mean(axis=0)
    want = np.linalg.norm(yc - yc @ u @ u.T, 2)
    norm, bound, converged, course = quality.residual_spectral_norm(layout, fit.components(), K, subsample=8, rounds=6)
    assert abs(norm - want) <= 1e-6 * want and converged and course[-1] == norm and bound <= 1e-7 * norm
    assert np.isclose(quality.relative_spectral_error(norm, 2.0), (norm - 2.0) / 2.0)


def test_residual_norm_runs_until_it_is_near_enough(spark, y, w):
    m = matrix_of(spark, y)
    layout = prepare(m, D)
    basis = em.ppca_em_wide(m, FitParams(K, max_rounds=1), init=factor_of(spark, w), layout=layout).components()
    u, yc = dense(basis, D, "u"), y - y.mean(axis=0)
    want = np.linalg.norm(yc - yc @ u @ u.T, 2)
    found = quality.residual_spectral_norm(layout, basis, K, subsample=1)
    assert len(found.course) > 2 and found.converged and abs(found.norm - want) <= 1e-6 * want
    # Each value is below the norm and below the next one.
    assert all(a <= b * (1 + 1e-12) <= want * (1 + 1e-9) for a, b in zip(found.course, found.course[1:]))
    with pytest.warns(UserWarning, match="after 2 rounds"):
        early = quality.residual_spectral_norm(layout, basis, K, subsample=1, rounds=2)
    assert not early.converged and early.course == found.course[:2] and early.norm <= want <= early.norm + 3 * early.bound


def test_residual_norm_when_nothing_is_left(spark):
    """A matrix of rank one, whose only component is the basis; and one whose blocks soon hold all there is."""
    x = np.outer(np.arange(9.0), [1.0, 2.0, 3.0, 4.0])
    m = matrix_of(spark, x)
    v = np.array([[1.0], [2.0], [3.0], [4.0]]) / math.sqrt(30)
    layout = prepare(m, 4)
    assert quality.residual_spectral_norm(layout, factor_of(spark, v, "u"), 1).norm < 1e-6
    other = np.array([[1.0], [0.0], [0.0], [0.0]])
    want = np.linalg.norm((x - x.mean(axis=0)) @ (np.eye(4) - other @ other.T), 2)
    found = quality.residual_spectral_norm(layout, factor_of(spark, other, "u"), 1, subsample=0)
    assert found.converged and np.isclose(found.norm, want)


def test_scored_fit_stops_on_the_error(spark, y):
    values = np.linalg.svd(y - y.mean(axis=0), compute_uv=False)
    fit = quality.ppca_em_scored(
        matrix_of(spark, y), FitParams(2, max_rounds=6, subsample=6), values[2], score_tolerance=0.5, norm_rounds=3
    )
    assert fit.stopped_by == "error" and fit.metrics[-1]["error"] <= 0.5


@pytest.mark.parametrize("form, rate", [("broadcast", 1.0), ("hot_shuffled", 0.5)])
def test_error_of_cells_that_are_laid_out(spark, form, rate):
    """The layout gives the same sums, rows without cells included, and no cell moves again."""
    y = sparse(5, 30, 12)
    y[20:24] = 0
    m = matrix_of(spark, y, FORMS[form])
    encode, decode = (init_factor(spark, 12, 2, "gaussian", seed) for seed in (1, 2))
    layout = prepare(m, 3)
    means = layout.stats.select("col_id", "mean")
    told = [
        {r["col_id"]: (r["error"], r["norm"]) for r in quality.error_sums(m, encode, decode, means, 2, rate, layout=laid).collect()}
        for laid in (None, layout)
    ]
    assert told[0].keys() == told[1].keys()
    for c, sums in told[0].items():
        assert np.allclose(told[1][c], sums, rtol=1e-10)
    parts = quality._laid_parts(layout, encode, decode, means, 2, rate, 42)
    if form == "broadcast":
        assert "Exchange hashpartitioning" not in parts.cells._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    layout.release()


@pytest.mark.parametrize("cells, columns", [(7, 5), (1 << 20, 1 << 16)])
def test_packed_cells_give_the_product(spark, monkeypatch, cells, columns):
    """Rows that go over several chunks and blocks, and columns without a factor row; cells are not joined with latent rows."""
    monkeypatch.setattr(plan, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(plan, "COLUMNS", columns)
    y = sparse(7, 40, 13)
    w = np.random.default_rng(3).random((13, 2))
    w[4] = 0
    layout = prepare(matrix_of(spark, y), 2)
    product = plan.gram_product(layout, factor_of(spark, w).where("col_id <> 4"), 2, [0.5, -0.25])
    kept = (y != 0).any(axis=1)
    want = y.T @ np.where(kept[:, None], y @ w - [0.5, -0.25], 0)
    found = {r["col_id"]: (r["p_0"], r["p_1"]) for r in product.collect()}
    assert sorted(found) == [int(c) for c in np.flatnonzero((y != 0).any(axis=0))]
    assert all(np.allclose(found[c], want[c]) for c in found)
    told = product._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "SortMergeJoin" not in told and "BroadcastHashJoin" in told
    layout.release()


def test_a_column_has_a_sum_for_each_core_not_for_each_part(spark):
    y = sparse(9, 60, 11)
    layout = prepare(matrix_of(spark, y), 2, parts=24)
    w = np.random.default_rng(1).random((11, 2))
    product = plan.gram_product(layout, factor_of(spark, w), 2, [0.5, -0.25])
    kept = (y != 0).any(axis=1)
    want = y.T @ np.where(kept[:, None], y @ w - [0.5, -0.25], 0)
    found = {r["col_id"]: (r["p_0"], r["p_1"]) for r in product.collect()}
    assert all(np.allclose(found[c], want[c]) for c in found) and len(found) == 10
    told = product._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in told
    layout.release()


def test_blocks_of_a_sketch_are_combined_in_arrays(spark):
    """As by the expression that few components go through."""
    rng = np.random.default_rng(2)
    a, weights = rng.random((30, 4)), rng.random((4, 3))
    table = factor_of(spark, a)
    args = names("w", 4), weights, "w"
    for keep in (["col_id"], ["col_id", "w_1"]):
        got = combine_by_blocks(table, args[0], weights, "o", keep)
        assert got.columns == [*keep, "o_0", "o_1", "o_2"]
        assert np.allclose(dense(got, 30, "o"), a @ weights)
    assert np.allclose(dense(combine(table, "w", weights, "o", ["col_id"]), 30, "o"), a @ weights)
    assert combine_by_blocks(table.where("false"), args[0], weights, "o", ["col_id"]).count() == 0
