from __future__ import annotations

import corpus_pipeline as c
from made_documents import documents  # noqa: F401
from factorspark.llm import quality
from test_bpe import want as tokens_of
from test_decontaminate import brute as contaminated
from test_pii import KINDS, valid
from test_jaccard import brute as first_of_similar, shingle_set, similarity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stage = dict(c.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]

    good = stage["quality"](spark, docs, SF_DIR).cache()
    scores = {r.doc_id: r.predicted for r in quality.op5_quality(spark, SF_DIR).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p} and good.columns == docs.columns

    texts = {r.doc_id: r.text for r in good.collect()}
    ids = first_of_similar(list(texts.items()))
    single = stage["near_duplicates"](spark, good, SF_DIR).cache()
    assert sorted(r.doc_id for r in single.collect()) == ids and single.columns == docs.columns

    rows = [(i, texts[i]) for i in ids]
    clean = {i for i, t in rows if contaminated([(i, t)], items)[0].endswith("False)")}
    fresh = stage["decontamination"](spark, single, SF_DIR).cache()
    assert {r.doc_id for r in fresh.collect()} == clean and fresh.columns == docs.columns

    private = stage["personal_data"](spark, fresh, SF_DIR).cache()
    out = {r.doc_id: r for r in private.collect()}
    assert set(out) == clean and private.columns == docs.columns
    for i, r in out.items():
        found = [m for k, p in KINDS.items() for m in p.finditer(texts[i]) if valid(k, m[0])]
        assert all(m[0] not in r.text for m in found) and r.n_chars == len(r.text)
        assert found or r.text == texts[i]

    tokens = stage["tokens"](spark, private, SF_DIR).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in tokens} == {i: tokens_of(r.text) for i, r in out.items()}
    assert sorted(map(tuple, c.run(spark, SF_DIR).drop("ids").collect())) == sorted(tuple(r)[:4] for r in tokens)


def test_repeated_and_odd_rows(spark, documents):
    long = "some words that make up a text of their own which is long enough to be told from all others here"
    df = documents((1, long), (1, long), (1, "another text altogether, with the same id"), (None, long + " again"), (None, None), (7, ""))
    kept = sorted((str(r.doc_id), str(r.text)[:7]) for r in c.drop_near_duplicates(spark, df, SF_DIR).collect())
    near = similarity(shingle_set(long), shingle_set(long + " again")) >= 0.8
    assert kept == sorted([("1", "some wo"), ("1", "another"), ("7", "")] + ([] if near else [("None", "some wo")]))
    for _, stage in c.STAGES:
        assert stage(spark, df.where("false"), SF_DIR).count() == 0
        assert stage(spark, df, SF_DIR).count() <= 6


def test_clashing_names_and_a_long_text(spark, documents):
    names = ["_id", "_mark", "_md5", "_email", "spans", "found_id", "others", "mark", "labelled", "version", "label", "key", "score"]
    long = " ".join(f"word{i}" for i in range(60_000))
    df = documents((1, long), (2, "write to me@example.org or 10.0.0.1"), (3, None), (None, "plain text")).selectExpr("*", *(f"doc_id AS {n}" for n in names))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, df, SF_DIR)
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == df.columns and set(rows) <= {1, 2, 3, None}, name
        assert all(r[n] == r.doc_id for r in rows.values() for n in names), name
        if name != "quality":
            assert len(rows) == 4 and rows[1].text == long, name
    assert rows[2].text == "write to [EMAIL] or [IP]" and rows[2].n_chars == len(rows[2].text) and rows[3].n_chars is None
    assert c.encode(spark, df, SF_DIR).count() == 4
