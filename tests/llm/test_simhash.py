from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from made_documents import documents  # noqa: F401
from factorspark.llm import simhash


def brute_fingerprint(text: str) -> int:
    out, words = "", []
    for c in text.translate({i: i + 32 for i in range(65, 91)}):
        out, words = ("", [*words, out]) if c in " \t\n\r\x0b\x0c" else (out + c, words)
    words = [w for w in [*words, out] if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    part = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if part[b] < part[a] and bin(prints[a] ^ prints[b]).count("1") <= bits:
                    part[a], changed = part[b], True
    return part


@pytest.mark.parametrize("text", ["", " \n", "One", "ONE two", "É É\u00a0a B c\x0bd", "a b " * 40, "x" * 70_000 + " y z w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("hot", [2, 6, 4096])
def test_links_reach_what_all_links_reach(spark, hot):
    rng = random.Random(hot)
    prints = set()
    for _ in range(12):  # walks of small steps, and neighbourhoods that share a segment
        now = rng.getrandbits(64)
        for _ in range(12):
            now ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3, 5])))
            prints.add(now)
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(32, 40) for b in range(40, 46)} | {0, 7, 2**64 - 1}
    ids = dict(enumerate(sorted(prints)))
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in ids.items()]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    found = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, hot=hot).collect()}
    assert all(0 < bin(a ^ b).count("1") <= 3 for a, b in found)
    near = {}
    for i in ids:
        near[i] = i
    by = {p: i for i, p in ids.items()}
    want = brute_components(ids)
    changed = True
    while changed:
        changed = False
        for a, b in found:
            m = min(near[by[a]], near[by[b]])
            for x in (by[a], by[b]):
                if near[x] != m:
                    near[x], changed = m, True
    assert near == want


def test_forest_of_large_groups(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64) & ~0xFFFF
    prints = {i: base | v for i, v in enumerate(rng.sample(range(1 << 12), 600))}
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in prints.items()]
    df = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    assert simhash.links(df).count() < 600 * 64
    parts = brute_components({i: p for i, p in list(prints.items())})
    from factorspark.llm.graph import components

    got = {r.node % 2**64: r.component % 2**64 for r in components(simhash.links(df)).collect()}
    same = {}
    for i, p in prints.items():
        same.setdefault(parts[i], set()).add(got.get(p, p))
    assert all(len(x) == 1 for x in same.values()) and len({min(x) for x in same.values()}) == len(same)


def test_documents(documents):
    text = "the quick brown fox jumps over the lazy dog while the old cat sleeps near a warm fire " * 9
    df = documents(
        (5, text), (3, text + "today"), (9, text), (9, text), (7, None), (8, ""), (None, text), (1, "Quite another one"),
        (2, "x" * 200_000),
    ).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("a"))
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert [r[0] for r in rows] == [-1, 1, 2, 3, 5, 7, 8, 9, 9]
    assert all(len(r[1]) == 16 and int(r[1], 16) >= 0 for r in rows)
    got = {r[0]: r[2] for r in rows}
    assert got[7] == got[8] == 7 and got[-1] == got[9] == got[5] and got[1] == 1 and got[2] == 2
    near = bin(simhash.fingerprint(text) ^ simhash.fingerprint(text + "today")).count("1") <= 3
    assert got[5] == (3 if near else 5)


def test_empty(documents):
    assert simhash.near_duplicates(documents((0, "a")).where("false")).count() == 0


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.op1_simhash(spark, sf_dir).collect()}
    assert got == {i: (prints[i], want[i]) for i in texts}
