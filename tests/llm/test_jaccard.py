from __future__ import annotations

import random
import tracemalloc
from fractions import Fraction

import corpus_pipeline as c
import numpy as np
from made_documents import documents  # noqa: F401
from factorspark.llm import jaccard


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def brute(rows):
    """Smallest id of each component."""
    sets, part = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for x in sets:
        for y in sets:
            if x < y and similarity(sets[x], sets[y]) >= Fraction(4, 5) and part[x] != part[y]:
                low, high = sorted((part[x], part[y]))
                part = {k: low if v == high else v for k, v in part.items()}
    return sorted(set(part.values()))


def planted():
    """Texts with copies of 0.75 to 0.95, chains of copies, and a line that most of them hold."""
    rng = random.Random(3)
    line = " ".join(f"line{i}" for i in range(40))
    word = lambda: f"w{rng.randrange(100_000)}"
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([8, 30, 100, 400]))]
        if i % 2:
            words += line.split()
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 3])):
            for _ in range(max(1, int(len(words) * rng.choice([0.006, 0.012, 0.02, 0.025, 0.03])))):
                words[rng.randrange(len(words))] = word()
            rows.append(" ".join(words).upper())
    rows += [line, line, None, "", "one two", "One  two", "one two three"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows))


def test_copies_of_any_similarity(documents):
    rows = planted()
    sets = [shingle_set(t) for _, t in rows]
    all_ = [similarity(a, b) for k, a in enumerate(sets) for b in sets[:k]]
    assert sum(Fraction(4, 5) <= x < Fraction(19, 20) for x in all_) > 15 and sum(Fraction(7, 10) < x < Fraction(4, 5) for x in all_) > 5
    kept = c.drop_near_duplicates(None, documents(*rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)


def test_pairing_without_stars_and_with_cut_lists(documents):
    rng, line = random.Random(5), [f"line{i}" for i in range(10)]
    rows = [(i, " ".join(line + [f"w{rng.randrange(2)}" for _ in range(5)])) for i in range(40)]
    want = brute(rows)
    assert 2 < len(want) < 40
    for stars, hot, small in ((0, 256, 0), (1, 2, 0), (0, 2, 5)):
        kept = jaccard.without_similar(documents(*rows), stars=stars, hot=hot, small=small)
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_copies_too_far_apart_are_not_paired_all_with_all(documents, monkeypatch):
    rng = random.Random(8)
    base, rows, made = [f"w{i}" for i in range(200)], [], []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(5, 195), 1 + i % 8):
            words[k] = f"v{rng.randrange(1 << 30)}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert 40 < len(want) < 100
    all_pairs = jaccard._all_pairs
    monkeypatch.setattr(jaccard, "_all_pairs", lambda *a: (made.append(all_pairs(*a).count()), all_pairs(*a))[1])
    kept = jaccard.without_similar(documents(*rows))
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert sum(made) < 20 * len(rows)


def test_counts_of_buckets_reach_the_driver_small(documents):
    rng, line = random.Random(6), " ".join(f"line{i}" for i in range(9))
    rows = [(i, f"{line} w{rng.randrange(9)} v{i}") for i in range(20)]
    hasher, want = jaccard.Hasher(), np.zeros(jaccard.BUCKETS, "int32")
    for grams in {tuple(hasher(t)) for _, t in rows}:
        np.add.at(want, np.array(grams) & (jaccard.BUCKETS - 1), 1)
    want[want < jaccard.COMMON] = 0
    df = documents(*rows)
    tracemalloc.start()
    got = jaccard.common_buckets(df, hasher)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and want.any()
    assert peak < got.nbytes + (8 << 20)


def test_parities_differ_by_no_more_than_their_sets(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for n in (1, 3, 60, 65, 130, 255, 257, 500):
        x = rng.integers(-(1 << 62), 1 << 62, n)
        y = np.concatenate((x[: n - n // 9], rng.integers(-(1 << 62), 1 << 62, n // 8)))
        rows.append((jaccard.parity(x).tolist(), jaccard.parity(y).tolist()))
        want.append(len(np.setxor1d(x, y)))
    found = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(jaccard._differ("a", "b").alias("d")).collect()
    assert all(r.d <= w for r, w in zip(found, want)) and any(r.d for r in found)


def test_hasher_is_that_of_words_wherever_it_is_cut(monkeypatch):
    text = "  a\tB c\x1cd  eé\n\n" + " ".join(f"word{i % 700}" for i in range(3_000)) + " a b c\x1cd eé word0 word1  "
    whole, words = jaccard.Hasher()(text), text.lower().replace("\x1c", "~").split()
    runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(whole) == len(runs)
    for size in (1, 7, 1_000):
        monkeypatch.setattr(jaccard, "CHUNK", size)
        assert (jaccard.Hasher()(text) == whole).all()
        assert len(jaccard.Hasher()("One  two")) == 1 and (jaccard.Hasher()("one two ") == jaccard.Hasher()("One  two")).all()
        assert len(jaccard.Hasher()(" \n ")) == len(jaccard.Hasher()("")) == 0


def test_clashing_names_repeated_rows_and_a_long_text(documents):
    long = " ".join(f"w{i}" for i in range(400_000))
    df = documents((1, long), (2, long + " more"), (2, "x"), (2, "x"), (None, "y z"), (None, "y z"), (7, None))
    names = ["mark", "key_id", "key_mark", "_key_id", "part", "node", "kept", "n"]
    df = df.selectExpr("*", *(f"doc_id AS {n}" for n in names))
    for most in (0, 100):
        found = jaccard.without_similar(df)
        assert found.columns == df.columns
        assert sorted(map(str, (r.doc_id for r in found.collect()))) == ["1", "2", "7", "None"]
