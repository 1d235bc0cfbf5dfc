"""Benchmark decontamination on a positional inverted index (operator 7).

The index is cut by documents: a row holds a block of documents and, for each term of the benchmark that occurs there, the
list of its positions in the block's token stream. Documents of a block stand apart by a gap wider than any match, so
positions of one match are of one document. A search orders the terms of each window by their counts in the whole corpus and
intersects their lists, shifted by the term's place in the window, from the rarest on. Blocks are searched where they lie; no
posting is shuffled. Benchmark terms and windows go to all tasks in groups of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import fresh, small_batches, table, written

WINDOW, SLOP = 10, 3
#: Bytes of text in a block of the index; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words of benchmark items that are searched for at once; a larger benchmark takes several passes over the index.
ITEM_WORDS = 2_000_000

# Word characters: letters and digits of ASCII, and everything beyond it. A-Z are lower-cased.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, lower-cased."""
    return text.translate(_TABLE).split()


@dataclass
class Phrases:
    """Distinct windows of some items: term numbers, padded by -1, and which items hold them."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray  # (n, width)
    sizes: np.ndarray
    of: list[list[int]]  # numbers of items by window
    items: list[str]  # item ids as text


def phrases_of(items: list[tuple[str, bytes]], window: int) -> Phrases:
    """Every run of `window` words of each item (all words of a shorter one)."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[int]] = {}
    for number, (_, text) in enumerate(items):
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        for at in range(max(1, len(terms) - window + 1)):
            run = tuple(terms[at : at + window])
            if run and found.setdefault(run, [number])[-1] != number:
                found[run].append(number)
    windows = np.full((len(found), window), -1, "int64")
    for row, run in enumerate(found):
        windows[row, : len(run)] = run
    sizes = np.array([len(run) for run in found], "int64")
    return Phrases(vocabulary, windows, sizes, list(found.values()), [i for i, _ in items])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index as a written table, a row for each block of documents:

    doc_ids, marks (MD5 of the text), n_words and starts (position of the first word) by document; terms, counts, and postings: the positions of each
    term in turn, as int32. Blocks follow the partitions of the input, so a shuffle is not needed.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def block(ids: list, texts: list[bytes]) -> tuple:
        get, parts, n_words, starts, at = vocabulary.get, [], [], [], gap
        for text in texts:
            words = text.translate(_TABLE).split()
            terms = np.fromiter(map(get, words, repeat(-1)), "int32", len(words))
            known = np.flatnonzero(terms >= 0)
            parts.append(np.stack((terms[known], (known + at).astype("int32"))))
            n_words.append(len(words))
            starts.append(at)
            at += len(words) + gap
        terms, positions = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), "int32")
        both = np.sort(terms.astype("int64") << 32 | positions)
        terms, positions = (both >> 32).astype("int32"), (both & 0xFFFFFFFF).astype("int32")
        heads = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, int)
        counts = np.diff(np.append(heads, len(terms)))
        marks = [hashlib.md5(text, usedforsecurity=False).digest() for text in texts]
        return ids, marks, n_words, starts, terms[heads].tolist(), counts.tolist(), positions.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        total = 0

        def flush():
            columns = zip(block(ids, texts))
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                if texts and total + len(text) > block_bytes:
                    yield flush()
                    ids, texts, total = [], [], 0
                ids.append(key)
                texts.append(text)
                total += len(text)
        if texts:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_ids array<bigint>, marks array<binary>, n_words array<int>, starts array<int>, terms array<int>, counts array<int>, postings binary"
    return written(rows.mapInArrow(run, schema), "postings")


_INDEX = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("marks", pa.list_(pa.binary())), ("n_words", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
     ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())]
)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How often each term occurs in the corpus. One number for each term of the searched group of items."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.terms", "x.counts")
    out = np.zeros(n_terms, "int64")
    for row in pairs.groupBy("terms").agg(F.sum("counts").alias("n")).toLocalIterator():
        out[row.terms] = row.n
    return out


def all_present(lists: dict[int, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Which windows have all their terms in `lists`."""
    present = np.zeros(int(windows.max(initial=-1)) + 2, bool)  # the last is for the padding
    present[[t for t in lists if t < len(present) - 1]] = True
    present[-1] = True
    return present[windows].all(axis=1)


def exact_starts(lists: dict[int, np.ndarray], windows: np.ndarray, sizes: np.ndarray, order: np.ndarray):
    """(window, position) of every occurrence: lists of each window's terms, intersected from the rarest on."""
    for w in np.flatnonzero(all_present(lists, windows)):
        terms, found = windows[w], None
        for place in order[w, : sizes[w]]:
            here = lists[int(terms[place])]
            if found is None:
                found = here - place
                continue
            wanted = found + place
            at = np.searchsorted(here, wanted)
            at[at == len(here)] = 0
            found = found[here[at] == wanted]
            if not len(found):
                break
        if len(found):
            yield w, found


def near_places(lists: dict[int, np.ndarray], terms: np.ndarray, reach: int) -> np.ndarray:
    """Positions of the first of `terms` that have all others within `reach` words before or after."""
    found = lists.get(int(terms[0]), np.zeros(0, "int32"))
    for term in terms[1:]:
        here = lists.get(int(term))
        if here is None or not len(found):
            return found[:0]
        at = np.searchsorted(here, found - reach)
        found = found[(at < len(here)) & (here[np.minimum(at, len(here) - 1)] <= found + reach)]
    return found


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate(([0], flags.astype("i1"), [0])))
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)


def bags_of(phrases: Phrases) -> tuple[np.ndarray, list[list[int]]]:
    """Windows with different sets of terms, one for each set, and which items hold a window of the set."""
    first: dict[tuple[int, ...], int] = {}
    of: list[set[int]] = []
    for w, (terms, size) in enumerate(zip(phrases.windows, phrases.sizes)):
        at = first.setdefault(tuple(sorted(set(terms[:size].tolist()))), w)
        of.append(set())
        of[at].update(phrases.of[w])
    chosen = list(first.values())
    return np.array(chosen, "int64"), [sorted(of[w]) for w in chosen]


def search(index: DataFrame, phrases: Phrases, window: int, slop: int) -> DataFrame:
    """By document of the index: runs of hit words, and the items with an exact and with a proximity match."""
    weight = term_counts(index, len(phrases.vocabulary))
    cost = np.where(phrases.windows >= 0, weight[phrases.windows], np.iinfo("int64").max)
    order = np.argsort(cost, axis=1, kind="stable")
    bags, bags_in = bags_of(phrases)
    windows, sizes, of, names = phrases.windows, phrases.sizes, phrases.of, phrases.items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = [batch.column(i)[row].values for i in range(6)]
                n_words, starts, terms, counts = (v.to_numpy(zero_copy_only=False) for v in values[2:])
                postings = np.frombuffer(batch.column(6)[row].as_buffer(), "int32")
                lists = {t: postings[b - n : b] for t, n, b in zip(terms.tolist(), counts, np.cumsum(counts))}
                marks = np.zeros(starts[-1] + n_words[-1] + window + 2, "int32")
                exact: list[set[str]] = [set() for _ in starts]
                near: list[set[str]] = [set() for _ in starts]
                for w, found in exact_starts(lists, windows, sizes, order):
                    marks[found] += 1  # positions of one list differ
                    marks[found + sizes[w]] -= 1
                    for d in np.unique(np.searchsorted(starts, found, "right") - 1):
                        exact[d].update(names[i] for i in of[w])
                for b in np.flatnonzero(all_present(lists, windows)[bags]):
                    bag = np.unique(windows[bags[b], : sizes[bags[b]]])
                    bag = bag[np.argsort(weight[bag], kind="stable")]
                    for d in np.unique(np.searchsorted(starts, near_places(lists, bag, window + slop), "right") - 1):
                        near[d].update(names[i] for i in bags_in[b])
                low, high = _spans(np.cumsum(marks) > 0)
                hit = [[] for _ in starts]
                for d, a, b in zip(np.searchsorted(starts, low, "right") - 1, low, high):
                    hit[d].append({"low": int(a - starts[d]), "high": int(b - starts[d])})
                texts = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [values[0], values[1], pa.array(n_words, pa.int64()),
                     pa.array(hit, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))),
                     pa.array([sorted(x) for x in exact], texts), pa.array([sorted(x) for x in near], texts)],
                    names=["doc_id", "mark", "n_words", "hit", "exact", "near"],
                )

    return index.mapInArrow(
        run, "doc_id bigint, mark binary, n_words bigint, hit array<struct<low: int, high: int>>, exact array<string>, near array<string>"
    )


def item_groups(items: DataFrame, words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in groups of about `words` words, read one after another; never the whole of a large one at once."""
    group, total = [], 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        if row[0] is None or row[1] is None or not (n := len(words_of(bytes(row[1])))):
            continue
        if group and total + n > words:
            yield group
            group, total = [], 0
        group.append((row[0], bytes(row[1])))
        total += n
    yield group


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP,
    block_bytes: int = BLOCK_BYTES, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """By row of `docs`: n_words, n_hit, n_items, items_sha256, contaminated, items, near_items with a proximity match, and mark, the text's MD5.

    A window is `window` consecutive words of an item, or all words of a shorter one. A word is hit if it lies in an exact
    occurrence of a window. A proximity match has all words of a window within `window + slop` words of its rarest one, in any
    order. Null and empty texts have no words; items without words or id match nothing;
    an id of several items counts once. Equal rows of `docs` give equal rows. An empty benchmark hits nothing.
    """
    found, groups = None, 0
    for group in item_groups(items, item_words):
        phrases = phrases_of(group, window)
        index = build_index(docs, phrases.vocabulary, window + slop + 1, block_bytes)
        one = search(index, phrases, window, slop)
        found, groups = one if found is None else found.union(one), groups + 1
    if groups > 1:  # each row was searched once for each group
        lists = {c: F.flatten(F.collect_set(c)).alias(c) for c in ("hit", "exact", "near")}
        found = found.groupBy("doc_id", "mark", "n_words").agg(F.count(F.lit(1)).alias("n"), *lists.values())
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / groups).cast("int")))).drop("copy", "n")
    ordered = {c: F.array_sort(F.array_distinct(c)) for c in ("hit", "exact", "near")}
    n_hit = F.aggregate(
        "hit", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], s["end"]))).alias("n"),
            F.greatest(s["end"], x["high"]).alias("end"),
        ),
        lambda s: s["n"].cast("bigint"),
    )
    return found.withColumns(ordered).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("exact").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "exact"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
        F.col("exact").alias("items"), F.col("near").alias("near_items"), F.lower(F.hex("mark")).alias("mark"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """`docs` without the rows that hold a window of an item; all columns are kept, whatever their names."""
    id_, mark = fresh(docs, "found_id"), fresh(docs, "found_mark")
    found = contamination(docs.select("doc_id", "text"), items, window, **options).where("contaminated")
    found = found.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.md5("text") == F.col(mark)), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All `documents` against all of `benchmark`."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
