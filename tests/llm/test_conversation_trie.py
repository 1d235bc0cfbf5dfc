from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from factorspark.llm import conversation_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            stored[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    stored = {c: [(r, t) for *_, r, _, t in sorted(x)] for c, x in stored.items()}
    whole = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(stored.get(base, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)

    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(nodes[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, inside in nodes.items():
        ends = ",".join(str(c) for c in inside if len(whole[c]) == len(node))
        up = nodes[node[:-1]][0] if node else None
        out.append((inside[0], len(node), up, len(inside), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def made(seed: int):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-250, 450), 120):
        for turn in range(rng.choice([1, 2, 3, 5, 7, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é\U0001f600", ""])))
    for c in (500, 501, 502, 503):
        rows += [(c, t, "user", "same") for t in range(12)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 3, "u", "x"), (1, 3, "u", "x"), (1, 3, "a", "y"), (2, 0, "u", "z" * 300_000), (None, 0, "u", "lost"),
        (0, 5, "u", ""), (0, None, "u", "first"), (700, 0, "", ""), (701, 1, None, None), (-5, 0, "u", "minus"), (-5, 1, None, "minus"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "2 AS part", "3 AS depth", "4 AS p0", "5 AS n")
    assert got(trie.prefix_trie(df)) == brute(rows)
    assert got(trie.prefix_trie(df.where("false"))) == []
    # Every turn of these is cut off.
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "u", "x") for c in short]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and len(brute(rows)) == 1


def test_a_long_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "u", f"t{t}") for c in (301, 302, 399) for t in range(150)] + [(7, t, "u", "t") for t in range(5)]
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_products_that_collide_are_made_anew(spark, monkeypatch):
    rows, tried = made(3), []
    # All hashes of the first attempt are zero: every prefix of a depth has the same product.
    monkeypatch.setattr(trie, "bases", lambda seed, own=trie.bases: tried.append(seed) or (own(seed) if seed else [0] * trie.LANES))
    monkeypatch.setattr(trie, "pow", lambda b, e, m: pow(b, e, m) if b or e >= 0 else 0, raising=False)
    assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) and tried == [0, 1]


def test_power(spark):
    rows = [0, 1, 255, 256, 65_537, (1 << 32) - 1]
    found = spark.createDataFrame([(x,) for x in rows], "e bigint").select(trie.power(123_457, F.col("e")).alias("p")).collect()
    assert [r.p for r in found] == [pow(123_457, x, trie.PRIME) for x in rows]


def test_sql_and_given_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = con.execute(trie.SQL)
    assert [d[0] for d in want.description] == COLUMNS
    rows = con.execute("SELECT * FROM conversations").fetchall()
    assert sorted(con.execute(trie.SQL).fetchall(), key=str) == brute(rows) == got(trie.op13_conversation_trie(spark, sf_dir))
