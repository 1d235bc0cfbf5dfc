from __future__ import annotations

import hashlib
import random
import re

import pytest

from made_documents import documents  # noqa: F401
from factorspark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - window + 1)):
            if w and i is not None:
                windows.setdefault(tuple(w[at : at + window]), set()).add(str(i))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[at : at + n]))):
                    hit |= set(range(at, at + n))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    vocabulary = ["a", "b", "Ça", "日本", "x1", "the", "of", "cat", "dog", "sat"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(2, "totally different words of item two again and again here"), (None, "a b"), (77, None), (78, "..."), (79, "UNSEEN, word")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.choice([0, 5, 40, 300]))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items[:30])[1].upper() + "! ")
        docs.append((i, "".join(parts)))
    docs += [(5, docs[5][1]), (5, "other"), (None, items[20][1]), (200, None), (201, ""), (202, "word " * 30_000)]
    return docs, items


@pytest.mark.parametrize("block,item_words,window", [(d.BLOCK_BYTES, d.ITEM_WORDS, 10), (300, 60, 10), (5_000, 100, 4)])
def test_against_brute_force(spark, documents, cases, block, item_words, window):
    docs, items = cases
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.contamination(documents(*docs), table, window, 3, block, item_words).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == brute(docs, items, window)


def test_proximity(spark, documents):
    table = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id int, text string")
    got = d.contamination(documents("delta gamma x beta alpha", "alpha beta gamma " + "x " * 20 + "delta", "alpha beta gamma delta"), table)
    assert [(r.contaminated, r.near_items) for r in sorted(got.collect(), key=lambda r: r.doc_id)] == [(False, ["1"]), (False, []), (True, ["1"])]


def test_proximity_at_any_offset(spark, documents):
    words = [f"w{i}" for i in range(1, 20)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:18]) + " other")], "item_id int, text string")
    runs = [words[5:15], words[9:19], words[:10], words[5:14], words[8:18]]
    docs = documents(*(" ".join(reversed(run)) for run in runs), "w6 w8 x w7 w9 w10 w15 w14 w13 w12 y w11")
    got = {r.doc_id: (r.contaminated, r.near_items) for r in d.contamination(docs, table).collect()}
    both = (False, ["1", "2"])
    assert got == {0: both, 1: (False, ["1"]), 2: both, 3: (False, []), 4: both, 5: both}


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id int, text string")
    row = d.contamination(documents("a b c"), none).collect()
    assert [tuple(r)[:6] for r in row] == [(0, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    some = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert d.contamination(documents("a").where("false"), some).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(str(tuple(r)[:6]) for r in d.op7_decontaminate(spark, sf_dir).collect()) == brute(docs, items)
