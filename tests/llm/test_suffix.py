from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from made_documents import documents  # noqa: F401
from factorspark.llm import suffix_dedup as s


def brute(rows, length=50):
    big = 1 << 62
    rows = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in rows:
        for at in range(len(t) - length + 1):
            x = t[at : at + length]
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for at in range(len(t) - length + 1):
            if least[t[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append(str((None if i == big else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def some_documents(seed: int, n: int):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(8)] + ["ab" * 60, " " * 90, "x" * 51]
    rows = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.choice([0, 1, 1, 3])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((rng.randrange(1000), rng.choice(["", " "]).join(parts)))
        if rng.random() < 0.3:
            rows.append((rng.randrange(1000), rows[-1][1]))
        if rng.random() < 0.2 and rows[-1][1]:
            text = rows[-1][1]
            cut = rng.randrange(len(text))
            rows.append((rng.randrange(1000), text[:cut] + "Q" + text[cut:]))
    return rows


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("shard_bytes,per_range", [(300, 50), (4_000, 400), (s.SHARD_BYTES, s.RANGE)])
def test_against_brute_force(documents, shard_bytes, per_range):
    rows = some_documents(shard_bytes, 70)
    rows += [(3, rows[0][1]), rows[0], (None, rows[0][1]), (5, None), (6, ""), (None, rows[4][1]), (2000, "z" * 3_000), (2001, "z" * 3_000 + "y"), (1, "q" * 49), (2, "q" * 49)]
    df = documents(*rows).withColumnsRenamed({"lang": "shard", "source": "near", "n_chars": "kept"})
    assert got(s.remove_repeats(df, shard_bytes=shard_bytes, per_range=per_range)) == brute(rows)


def test_other_length(documents):
    rows = some_documents(8, 40)
    assert got(s.remove_repeats(documents(*rows), length=33, shard_bytes=2_000)) == brute(rows, 33)
    with pytest.raises(ValueError):
        s.remove_repeats(documents("a"), length=31)


def test_kept_text(documents):
    a, b = "first part of it. " * 1, "the passage that both of these documents hold, word for word, as it is."
    out = s.remove_repeats(documents((1, a + b), (2, "Second:" + b + " end")), keep_text=True)
    assert {r.doc_id: bytes(r.kept).decode() for r in out.collect()} == {1: a + b, 2: "Second: end"}


def test_empty_table(documents):
    assert s.remove_repeats(documents("a").where("false")).count() == 0


def test_order_and_common_prefixes():
    rng = random.Random(2)
    data = "".join(rng.choices("ab", k=600)).encode() * 2 + bytes(3) + b"ab" * 100
    words = s.words_at(data)
    room = len(data) - np.arange(len(data))
    order = s.suffix_order(words, room, 40)
    cut = [data[i : i + 40] for i in order]
    assert cut == sorted(data[i : i + 40] for i in range(len(data) - 39))
    want = [0] + [next((k for k in range(40) if a[k] != b[k]), 40) for a, b in zip(cut, cut[1:])]
    for lanes in (1, 7, 4096):
        assert s.common_prefixes(words, order, 40, lanes).tolist() == want


def carried_over():
    """Texts in which the suffix before one has no successor of its own: '12F' and '11F' once counted as one string of 50 bytes."""
    rng = random.Random(4)
    f = "".join(rng.choices("abcdefgh", k=30_000))  # more than the lanes of common_prefixes
    a, c = "x" * 5 + "q12" + f, "y" * 5 + "r11" + f
    b = "z" * 10 + ("q12" + f)[:40] + "A" * 10
    return [(1, c), (2, b), (9, a)]


def test_runs_are_equal_strings():
    texts = [t.encode() for _, t in carried_over()]
    rng = random.Random(6)
    for shard in [s.Shard(texts, np.arange(3))] + [s.Shard(["".join(rng.choices("ab", k=200)).encode() * 2], np.arange(1)) for _ in range(20)]:
        starts = np.zeros(len(shard.data), bool)
        for low, size in zip(shard.starts, shard.sizes):
            starts[low : low + size - 49] = [len(texts) == len(shard.texts) or rng.random() < 0.5 for _ in range(size - 49)]
        at, run = shard.runs(starts, 50)
        cut = [shard.data[i : i + 50] for i in at]
        assert sorted(at.tolist()) == np.flatnonzero(starts).tolist()
        assert [x == y for x, y in zip(cut, cut[1:])] == (run[1:] == run[:-1]).tolist()


def test_common_prefixes_of_some_suffixes():
    data = "".join(t for _, t in carried_over()).encode()
    order = np.array(sorted(random.Random(1).sample(range(len(data) - 49), 9_000), key=lambda i: data[i : i + 50]))
    want = [0] + [next((k for k in range(50) if data[a + k] != data[b + k]), 50) for a, b in zip(order, order[1:])]
    for lanes in (1, 7, 4096):
        assert s.common_prefixes(s.words_at(data), order, 50, lanes).tolist() == want


def test_strings_that_differ_early(documents):
    rows = carried_over()
    assert got(s.remove_repeats(documents(*rows))) == brute(rows)


def test_merging_by_binary_search():
    rng = random.Random(8)
    lists = [sorted({"".join(rng.choices("ab\xff", k=50)).encode("latin-1")[:47] + bytes(rng.choices([0, 1], k=3)) for _ in range(n)}) for n in (200, 1, 90, 300)]
    lists[2] = sorted({*lists[2], *lists[0][::3], *lists[3][::2]})
    tables = [(s.rows_of_words(s.words_at(b"".join(x)), np.arange(len(x)) * 50, 50), np.array([rng.randrange(9) for _ in x])) for x in lists]
    want = {}
    for x, (_, ids) in zip(lists, tables):
        for text, i in zip(x, ids.tolist()):
            want[text] = min(i, want.get(text, 99))
    every = s.merged(s.merged(tables[1], tables[0]), s.merged(tables[2], tables[3]))
    assert every[1].tolist() == [want[t] for t in sorted(want)]
    for x, (rows, _) in zip(lists, tables):
        place, there = s.find(every[0], rows)
        assert there.all() and [sorted(want)[i] for i in place] == x
    assert not s.find(every[0], tables[0][0] + np.uint64(1 << 40))[1].any()
    smaller = [[i > want[t] for t, i in zip(x, ids.tolist())] for x, (_, ids) in zip(lists, tables)]
    for key in (s.digest, lambda rows: rows[:, 0] & np.uint64(7 << 56)):  # the second key is one of few for all strings
        keyed = []
        for rows, ids in tables:
            order = np.argsort(key(rows))
            keyed.append((key(rows)[order], rows[order], ids[order], order))
        for first_key in (True, False):
            found = s.smaller_elsewhere([x[:3] for x in keyed] + [(np.zeros(0, "u8"), tables[0][0][:0], tables[0][1][:0])], first_key)
            assert [f[np.argsort(x[3])].tolist() for f, x in zip(found, keyed)] == smaller and len(found[4]) == 0


def test_strings_merged_some_at_a_time(documents, monkeypatch):
    monkeypatch.setattr(s, "AT_ONCE", 40)
    rng = random.Random(11)
    shared = ["".join(rng.choices("abcdef", k=120)) for _ in range(6)]
    rows = [(i, "".join(rng.choices("ghi", k=60)) + rng.choice(shared) + rng.choice(shared)) for i in range(40)]
    assert got(s.remove_repeats(documents(*rows), shard_bytes=600)) == brute(rows)


def test_long_texts_are_dealt_in_stretches(documents):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdefé", k=n))
    long, again = text(2_000), text(700)
    rows = [
        (3, long), (5, long), (4, long[300:900] + text(100)), (9, text(230) + again + long[590:640]), (1, again[:60]), (2, again[200:500] + "z" * 400),
        (None, long[:410]), (None, text(300) + "z" * 120), (2**63 - 1, long[5:300]), (6, "a" * 1_500), (7, "a" * 260), (8, "short"), (8, long[-120:]),
    ]
    for size in (150, 400):
        assert got(s.remove_repeats(documents(*rows), shard_bytes=size)) == brute(rows)
    kept = {r.doc_id: r.kept for r in s.remove_repeats(documents(*rows), shard_bytes=150, keep_text=True).collect() if r.doc_id in (3, 5)}
    assert kept == {3: long.encode(), 5: b""}


def test_a_text_of_fifty_megabytes(documents):
    rng = np.random.default_rng(1)
    long = (rng.integers(97, 123, 50_000_000, dtype="u1")).tobytes().decode()
    part = long[25_000_000:25_001_000]
    found = {r.doc_id: tuple(r)[1:4] for r in s.remove_repeats(documents((1, long), (2, "own " + part), (3, "other"))).collect()}
    assert found == {1: (50_000_000, 0, 0), 2: (1_004, 1_000, 1), 3: (5, 0, 0)}


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(s.op9_suffix_dedup(spark, sf_dir)) == brute(rows)


def test_ranges_of_least_grams_are_even():
    data = np.random.default_rng(4).integers(97, 123, 1 << 18).astype("u1").tobytes()
    shard = s.Shard([data], np.array([1]))
    shard.anchors(50)
    part = s.part_of(shard.least_grams(np.arange(200_000), 50), 50).astype("int64")
    assert np.bincount(part, minlength=50).max() < 2 * 200_000 / 50


def test_full_matches_carry_over():
    """Of a copied text each suffix shares what the one before it in the text did, less a byte: about one word of each is looked at."""

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            Counted.seen += np.size(at)
            return np.asarray(self)[at]

        def take(self, at, **how):
            Counted.seen += np.size(at)
            return np.asarray(self).take(at, **how)

    text = bytes(random.Random(4).choices(range(97, 123), k=2_000))
    data = text + text
    words, room = s.words_at(data), np.concatenate((np.arange(2_000, 0, -1),) * 2)
    order = s.suffix_order(words, room, 50)
    shared = s.common_prefixes(words.view(Counted), order, 50, 8)
    assert shared[1::2].tolist() == [50] * (len(order) // 2)
    # Two words are compared; a full match would take fourteen.
    assert Counted.seen < 4 * len(order)


def test_anchors_by_blocks_and_least_hashes_of_texts():
    data = bytes(random.Random(5).choices(range(97, 100), k=3_000))
    hashes = s.gram_hashes(s.words_at(data))
    want = s.anchors(hashes, 50)
    for block in (40, 333, 1 << 15):
        at, found = s.anchors_in(data, 50, block)
        assert at.tolist() == want.tolist() and found.tolist() == hashes[want].tolist()
    assert [len(x) for x in s.anchors_in(b"ab" * 10, 50)] == [0, 0]
    texts = [b"", data[:15], data[:16], data[7:900], b"", data, data[5:21]]
    for at_once in (10, 1_000, 1 << 20):
        assert s.least_hashes(texts, at_once).tolist() == [int(s.gram_hashes(s.words_at(t))[: len(t) - 15].min()) if len(t) > 15 else 0 for t in texts]
