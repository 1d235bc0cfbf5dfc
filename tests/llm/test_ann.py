from __future__ import annotations

import numpy as np
import pytest

from factorspark.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=5, step=50):
    """Exact ranks; scores of the nearest."""
    good = {i: np.array(v, "float64") for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    unit = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids]) if len(ids) else np.zeros((0, 1))
    out = {}
    for q in ids[ids % step == 0]:
        score = unit @ unit[ids == q][0]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in rows}) for q, rows in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0])]
    rows += [(6, [None, 1.0]), (7, [float("inf"), 1.0]), (100, [-1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 1.0, 1.0]), (9, []), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 AS rank", "2 AS leaf", "3 AS key")
    got = found(ann.nearest(df))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 2])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_many_copies(spark):
    rng = np.random.default_rng(3)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 else rng.standard_normal(8).tolist(), 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got, want = found(ann.nearest(df)), brute([(r[0], np.array(r[1], "float32").tolist()) for r in rows])
    hot = [q for q in want if q % 3]
    assert hot and all([i for i, _ in got[q]] == [i for i in range(900) if i % 3 and i != q][:5] for q in hot)
    assert recall(got, want) >= 0.9 and set(got) == set(want)


def test_deeper_than_the_sample(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist(), 0) for i in range(3_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(ann.nearest(df, leaf=8, sample=100, query_block=7)), brute([(r[0], np.array(r[1], "float32").tolist()) for r in rows])
    assert recall(got, want) >= 0.9


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_query_recall(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(ann.op6_ann(spark, sf_dir)), brute(rows)
    assert recall(got, want) >= 0.95 and all(len(got[q]) == len(want[q]) for q in want)
    exact = {(q, i): s for q, x in brute(rows, k=len(rows)).items() for i, s in x}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, x in got.items() for i, s in x)
