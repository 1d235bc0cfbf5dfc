from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from made_documents import documents  # noqa: F401
from factorspark.llm import language, quality

SF_DIR = "/root/testdata/sf0.01"


def out(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = quality.op5_quality(spark, SF_DIR).collect()
    assert len(rows) == 1000 and all(r.held_out == out(r.doc_id) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    judged = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in judged]) > 0.95
    assert np.mean([b for a, b in judged if a == 1]) > 0.97


def test_quality_gradient():
    """A step against the gradient lowers the loss: training separates bags by one odd passage."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 6, 200)
    x = rng.standard_normal((counts.sum(), 12)).astype("float32")
    y = (rng.random(200) < 0.5).astype("float32")
    x[(np.cumsum(counts) - 1)[y == 1], 3] += 6
    model = quality.fit(x, counts, y)
    p = quality._forward(model.weights, (x - model.mean) / model.spread, np.cumsum(counts) - counts, counts)
    assert ((p["p"] > 0.5) == y).mean() > 0.97
    assert np.allclose(np.add.reduceat(p["weight"], np.cumsum(counts) - counts), 1, atol=1e-5)


def test_quality_weights_equal_plain_gradient_descent():
    """Three steps of Adam with gradients by differences of the loss, each bag on its own, in double precision."""
    rng = np.random.default_rng(2)
    counts = np.array([1, 3, 2, 4])
    x, y = rng.standard_normal((10, 5)), np.array([1.0, 0.0, 1.0, 0.0])
    got = quality.fit(x.astype("float32"), counts, y.astype("float32"), epochs=0)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-2
    assert np.allclose(got.mean, mean, atol=1e-6) and np.allclose(got.spread, spread, atol=1e-6)
    p = {k: w.astype("float64") for k, w in got.weights.items()}
    bags = np.split((x - mean) / spread, np.cumsum(counts)[:-1])

    def loss(p):
        out = 1e-4 * (p["w"] ** 2).sum() / 2
        for bag, label in zip(bags, y):
            h = [np.tanh(row @ p["w"] + p["b"]) for row in bag]
            e = np.exp([(np.tanh(v @ p["v"]) / (1 + np.exp(-v @ p["u"]))) @ p["a"] for v in h])
            s = 1 / (1 + np.exp(-(sum(w * v for w, v in zip(e / e.sum(), h)) @ p["c"] + p["d"])))
            out -= np.log(s if label else 1 - s) / len(y)
        return out

    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in (1, 2, 3):
        for k in p:
            grad = np.zeros(np.shape(p[k]))
            for i in np.ndindex(np.shape(p[k])):
                ends = []
                for d in (1e-6, -1e-6):
                    moved = {**p, k: np.array(p[k])}
                    moved[k][i] += d
                    ends.append(loss(moved))
                grad[i] = (ends[0] - ends[1]) / 2e-6
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.99 * v[k] + 0.01 * grad**2
        p = {k: p[k] - quality.RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8) for k in p}
    fitted = quality.fit(x.astype("float32"), counts, y.astype("float32"), epochs=3)
    # Adam turns gradients near zero into steps of either sign, so a few weights may differ by up to a step.
    off = np.concatenate([np.abs(fitted.weights[k] - p[k]).ravel() for k in p])
    assert np.quantile(off, 0.98) < 1e-3 and off.max() <= 6.1 * quality.RATE


def test_quality_sample_is_bounded_in_passages(spark, documents):
    df = documents(*[(i, "word " * 100 * (1 + i % 3)) for i in range(40)], *[(5, "word " * 300)] * 20)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    original = quality.fit
    quality.fit = lambda x, counts, y, **a: seen.append(counts.tolist()) or original(x, counts, y, epochs=1)
    try:
        for most in (7, 1_000, 0):
            quality.train(df, labels, most=most)
    finally:
        quality.fit = original
    assert sum(seen[0]) <= 7 and 5 < sum(seen[0]) and len(seen) == 2
    assert len(seen[1]) == sum(not out(i) for i in range(40))


def test_passages_cover_whole_texts():
    texts = ["", "a" * 401, "B c!", "x" * 1_000_000]
    x, counts = quality.passages(texts)
    assert counts.tolist() == [1, 2, 1, 2500] and x.shape == (2504, quality.WIDTH) and np.isfinite(x).all()
    one = np.concatenate([quality.passages([t])[0] for t in texts])
    assert np.array_equal(x, one)


def test_quality_odd_rows(spark, documents):
    df = documents("good text here.", None, "", (None, "x"), (3, "y"), (3, "y"), (9, "z" * 200_000)).withColumn("score", F.lit(1)).withColumn("label", F.lit(2))
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, None), (None, 1), (77, 0)], "doc_id bigint, quality int")
    rows = quality.score_documents(df, quality.train(df, labels)).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in quality.score_documents(df, quality.train(df, none)).collect()} == {0.5}
    assert quality.score_documents(df.where("false"), None).count() == 0
    assert quality.keep_good(df, None).columns == df.columns


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = language.op10_language(spark, SF_DIR).collect()
    assert len(rows) == 1000 and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_presence_is_the_set_of_grams():
    texts = ["", "Ab", "abab abab", "é日本😀", "x" * 5_000]
    for _, buckets, bounds in language.presence(texts):
        got = [buckets[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = [len({t.lower()[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}) for t in texts]
    assert [len(g) for g in got] == sizes and all(g == sorted(g) for g in got)
    assert got == [[*b] for t in texts for _, b, _ in language.presence([t])]


def test_kernel_weights_equal_the_kernel():
    """Folding the Nyström weights onto n-grams gives what landmark kernels give."""
    rng = np.random.default_rng(0)
    rows = [("a" if i % 2 else "b", np.unique(rng.integers(0, 400, 30) + 300 * (i % 2))) for i in range(80)]
    model = language.fit(rows, landmarks=80)
    scores = np.array([model.weights[b].sum(axis=0) * len(b) ** -0.5 for _, b in rows])
    assert [model.languages[i] for i in scores.argmax(axis=1)] == [lang for lang, _ in rows]


def test_scores_are_those_of_kernel_ridge_regression():
    """Set kernels between new rows, landmarks and training rows, one pair at a time; the normal equations of the ridge by least squares."""
    rng = np.random.default_rng(3)
    words = [[f"{c}{x}" for x in ("an", "er", "ti", "on", "lo", "mi")] for c in "abc"]
    text = lambda k: " ".join(rng.choice(words[k], 12))
    given = [(f"l{k}", text(k)) for k in (0, 1, 2) * 12]
    buckets = lambda texts: [b[x:y] for _, b, n in language.presence(texts) for x, y in zip(n[:-1], n[1:])]
    rows = list(zip([lang for lang, _ in given], buckets([t for _, t in given])))
    model = language.fit(rows, landmarks=24)
    order, n = language.landmarks_first(rows, 24)
    assert n == 24 and len(order) == 36
    kernel = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / (len(a) * len(b)) ** 0.5
    k_all = np.array([[kernel(b, m) for _, m in order[:n]] for _, b in order])
    values, vectors = np.linalg.eigh(k_all[:n])
    root = vectors[:, values > 1e-6 * values[-1]] * values[values > 1e-6 * values[-1]] ** -0.5
    targets = np.array([[lang == x for x in model.languages] for lang, _ in order], float)
    features, penalty = k_all @ root, (language.RIDGE * len(order) / 100) ** 0.5 * np.eye(root.shape[1])
    weights = np.linalg.lstsq(np.vstack([features, penalty]), np.vstack([targets, np.zeros((len(penalty), 3))]), rcond=None)[0]
    new = [text(k) + " " + text((k + 1) % 3)[:9] for k in (0, 1, 2) * 3]
    want = np.array([[kernel(b, m) for _, m in order[:n]] for b in buckets(new)]) @ root @ weights
    names, scores = language.score(model, new)
    assert names == [model.languages[i] for i in want.argmax(axis=1)]
    assert np.allclose(scores, np.clip(want.max(axis=1), 0, 1), atol=1e-3)


def test_rare_and_many_languages():
    """Languages of a script of their own, one with 10 rows among 2,000 and then 150 of them, are told from the first name."""
    rng = np.random.default_rng(7)
    text = lambda base: "".join(chr(base + c) if c < 20 else " " for c in rng.integers(0, 24, 120))
    buckets = lambda texts: [b[x:y] for _, b, n in language.presence(texts) for x, y in zip(n[:-1], n[1:])]
    common = [("aa" if i % 2 else "bb", t) for i, t in enumerate(buckets([text(0x61) if i % 2 else text(0x430) for i in range(2_000)]))]
    rare = [("rare", b) for b in buckets([text(0x10A0 + 0x30) for _ in range(10)])]
    assert language.score(language.fit(common + rare), [text(0x10A0 + 0x30) for _ in range(20)])[0] == ["rare"] * 20
    bases = [0x4E00 + 32 * i for i in range(150)]
    rows = [(f"l{i:03}", b) for i, x in enumerate(bases) for b in buckets([text(x) for _ in range(6)])]
    assert language.score(language.fit(rows), [text(x) for x in bases])[0] == [f"l{i:03}" for i in range(150)]


@pytest.mark.parametrize("lang", ["en", None])
def test_language_odd_rows(documents, lang):
    df = documents((0, "hello there", lang), (2, None, lang), (3, "123 !", "en"), (3, "123 !", "en"), (None, "abc", lang), (5, "w" * 300_000, lang))
    rows = language.identify(df.withColumn("score", F.lit(0)), language.train(df)).collect()
    assert len(rows) == 6 and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3))
    assert language.identify(df.where("false"), language.train(df.where("false"))).count() == 0
