import numpy as np
import pytest
from conftest import dense, entries_of, matrix_of, sparse

from factorspark import FitParams
from factorspark.__main__ import main
from factorspark.plans.sites import ppca_em_sites
from factorspark.session import new_dir
from factorspark.sources.writers import save_result


@pytest.fixture(scope="module")
def y():
    return sparse(21, 20, 8, 0.6)


def test_convert_and_fit(spark, y, capsys):
    path = new_dir(spark, "job")
    save_result(entries_of(spark, y), f"{path}/text", 20, 8, "coo")
    main(["convert", "--input", f"{path}/text", "--format", "coo", "--output", f"{path}/cells"])
    common = ["--rows", "20", "--cols", "8", "--pcs", "2", "--input", f"{path}/cells"]
    main(["fit", *common, "--max-iter", "40", "--tolerance", "0.001", "--output", f"{path}/wide",
          "--out-format", "coo", "--project", "orthonormal"])
    assert "stopped by dw" in capsys.readouterr().out
    u = np.zeros((8, 2))
    for line in spark.read.text(f"{path}/wide/components").collect():
        i, j, v = line["value"].split(",")
        u[int(i), int(j)] = float(v)
    right = np.linalg.svd(y - y.mean(axis=0), full_matrices=False)[2][:2].T
    assert np.allclose(u.T @ u, np.eye(2)) and np.linalg.svd(right.T @ u, compute_uv=False).min() > 0.99
    x = dense(spark.read.parquet(f"{path}/wide/projection"), 20, "x", "row_id")
    assert np.allclose(x, y @ u)
    rounds = spark.read.parquet(f"{path}/wide/metrics")
    assert rounds.count() > 1 and rounds.filter("dw is null").isEmpty()

    main(["fit", *common, "--method", "noise", "--max-iter", "2", "--reconstruction", "--output", f"{path}/noise", "--project", "posterior"])
    errors = [r["error"] for r in spark.read.parquet(f"{path}/noise/metrics").orderBy("round").collect()]
    assert len(errors) == 2 and all(0 < e < 2 for e in errors)
    assert "noise variance" in capsys.readouterr().out
    c, ss = dense(spark.read.parquet(f"{path}/noise/factor"), 8, "w"), spark.read.parquet(f"{path}/noise/metrics").orderBy("round").collect()[-1]["ss"]
    x = dense(spark.read.parquet(f"{path}/noise/projection"), 20, "x", "row_id")
    some = sorted(set(np.nonzero(y)[0]))
    assert np.allclose(x[some], ((y - y.mean(axis=0)) @ c @ np.linalg.inv(c.T @ c + ss * np.eye(2)))[some])


@pytest.mark.parametrize("options", [
    "--method scored", "--method scored --next-singular-value 1 --resume --work x", "--method noise --tolerance 0.1", "--reconstruction",
    "--resume", "--method sites", "--project posterior", "--method noise --reconstruction --error-rate 0", "--error-rate 2",
])
def test_options_without_effect_are_refused(spark, options):
    with pytest.raises(SystemExit):
        main(["fit", "--rows", "20", "--cols", "8", "--pcs", "2", "--input", "none", "--output", "none", *options.split()])


def test_sites_job(spark, y):
    path = new_dir(spark, "job")
    site = np.array(["a", "b"])[np.arange(20) % 2]
    entries_of(spark, y, site).write.parquet(f"{path}/cells")
    spark.createDataFrame([("a", 10), ("b", 10)], "site string, n_rows bigint").write.parquet(f"{path}/sites")
    main(["fit", "--method", "sites", "--site-rows", f"{path}/sites", "--rows", "20", "--cols", "8", "--pcs", "2",
          "--max-iter", "2", "--input", f"{path}/cells", "--output", f"{path}/out"])
    assert spark.read.parquet(f"{path}/out/factor").count() == 8


def test_sites_as_jobs_of_their_own(spark, y, capsys):
    """Sites send in any order, one twice; the factor is that of the fit over all sites, and the last round leaves `stop`."""
    path = new_dir(spark, "exchange")
    names, counts = ["a", "b", "c"], [7, 7, 6]
    site = np.array(names)[np.arange(20) % 3]
    for s in names:
        entries_of(spark, np.where((site == s)[:, None], y, 0)).write.parquet(f"{path}/cells-{s}")
    common = ["--exchange", f"{path}/x", "--cols", "8", "--pcs", "2"]
    total = ["accumulate", *common, "--sites", "3", "--max-iter", "2"]
    send = lambda s, r: main(["site-round", *common, "--input", f"{path}/cells-{s}", "--site", s, "--rows", str(counts[names.index(s)]), "--round", str(r)])  # noqa: E731,E501
    said = lambda: capsys.readouterr().out
    send("a", 0)
    assert "nothing to do" in said()
    main([*total, "--start"])
    main([*total, "--round", "0"])
    assert "round 0: waiting" in said()
    for r, order in enumerate(["bab", "acb"]):
        for s in order:
            send(s, r)
        if r == 0:
            main([*total, "--round", "0"])
            assert "round 0: waiting" in said()
            send("c", 0)
        main([*total, "--round", str(r)])
        assert f"round {r + 1}: {'next' if r == 0 else 'stopped'}" in said()
    send("a", 2)
    assert "nothing to do" in said()
    start = spark.read.parquet(f"{path}/x/factor/round=0").drop("block")
    m = matrix_of(spark, y, site=site)
    want = dense(ppca_em_sites(m, FitParams(2, max_rounds=2), init=start).factor, 8, "w")
    assert np.allclose(dense(spark.read.parquet(f"{path}/x/factor/round=2").drop("block"), 8, "w"), want)
