from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorspark.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4, parts=4):
    """Rows of (vec_id, vector, label), each part against each entry, in Python's whole numbers."""
    kept = [(i, [int(np.floor(1024.0 * float(np.float32(v)))) for v in x], c) for i, x, c in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], "int64").reshape(len(kept), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def near():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)])
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        of, _ = near()
        for p in range(parts):
            for e in set(of[p].tolist()):
                books[p, e] = x[of[p] == e, p].sum(axis=0) // (of[p] == e).sum()
    of, d = near()
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    errors = d.sum(axis=0).tolist()
    by = {}
    for (_, _, c), e in zip(kept, errors):
        by[c] = by.get(c, 0) + e
    return sorted(((i, "".join(f"{of[p, k]:02x}" for p in range(parts)), errors[k], by[c], digest) for k, (i, _, c) in enumerate(kept)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def rows_of(seed: int, n: int, width: int, clusters: int = 5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, width))
    out = [(i, (middle[rng.integers(clusters)] + rng.normal(0, 0.2, width)).tolist(), int(rng.integers(3))) for i in range(n)]
    return out


@pytest.mark.parametrize("n,entries,block", [(900, 64, 128), (300, 256, 4_096), (90, 256, 7)])
def test_equals_brute_force(spark, n, entries, block):
    rows = rows_of(n, n, 16)
    assert got(vc.encode_vectors(spark.createDataFrame(rows, SCHEMA), entries=entries, block=block)) == brute(rows, entries)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(1, 40, 8) + [
        (100, None, 1), (101, [0.5] * 7 + [None], 1), (102, [nan] + [0.0] * 7, 1), (103, [inf] * 8, None), (104, [-inf] * 8, None),
        (105, [0.0] * 8, None), (105, [0.0] * 8, None), (None, [-0.0004] * 8, None), (7, [0.25] * 8, 2), (-3, [1.5] * 8, 9), (106, [60_000.0] * 8, 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "2 AS error", "3 AS x", "4 AS of")
    assert got(vc.encode_vectors(df, entries=12)) == brute(rows, 12)
    copies = [(i, [1.0, -1.0, 2.0, 3.0], 1) for i in range(300)]
    assert got(vc.encode_vectors(spark.createDataFrame(copies, SCHEMA))) == brute(copies)
    assert got(vc.encode_vectors(df.where("false"))) == []
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 6, 1)], [(1, [1e9] * 4, 1)]):
        with pytest.raises(Exception):
            vc.encode_vectors(spark.createDataFrame(bad, SCHEMA)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 400), st.sampled_from([1, 3, 16]), st.sampled_from([2, 40, 5_000, 1 << 26]), st.integers(1, 64))
def test_trees_find_the_nearest(seed, n, width, spread, entries):
    """Whatever the spread: many ties and copies, or numbers beyond what doubles square exactly."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread, (n, width))
    books = np.concatenate((points[: entries // 2], rng.integers(-spread, spread, (entries - len(points[: entries // 2]), width))))
    tree = vc.build(points, leaf=5)
    distance = ((points[:, None] - books[None]) ** 2).sum(axis=2)
    code, error = vc.assigned(tree, points, books)
    assert (code == distance.argmin(axis=1)).all() and (error == distance.min(axis=1)).all()
    total, count = vc.sums_of(tree, points, books)
    assert (count == np.bincount(code, minlength=len(books))).all()
    assert all((total[e] == points[code == e].sum(axis=0)).all() for e in range(len(books)))
    # Each ball holds its points, within its radius, with their sum; the children share them out.
    assert sorted(tree.order.tolist()) == list(range(n))
    for b in range(len(tree.radius)):
        inside = points[tree.order[tree.start[b] : tree.stop[b]]]
        assert (inside.sum(axis=0) == tree.total[b]).all()
        assert np.sqrt(((inside - tree.centre[b]) ** 2).sum(axis=1)).max() <= tree.radius[b] * (1 + 1e-9) + 1e-9
        if tree.left[b] >= 0:
            assert tree.stop[tree.left[b]] == tree.start[tree.right[b]]


def test_balls_are_owned_whole():
    """On clustered points most points are never looked at."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-5_000, 5_000, (20, 16))
    points = middle[rng.integers(0, 20, 2_000)] + rng.integers(-20, 20, (2_000, 16))
    seen = []
    vc.owners(vc.build(points), points, middle, lambda b, e: None, lambda members, *_: seen.append(len(members)))
    assert sum(seen) < 100


def test_sql_and_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert sorted(con.execute(vc.SQL).fetchall(), key=str) == brute(rows) == got(vc.op11_vector_codes(spark, sf_dir))
