"""SimHash near-duplicates by deletion-variant signatures (operator 1).

A fingerprint of 64 bits is cut into two segments: of at most three differing bits, at most one falls in one of the two. So
each segment is indexed in all its variants with one bit wiped out; fingerprints within reach share a variant. Equal keys are
brought together by a shuffle and verified by the whole fingerprint. A key with more than `HOT` fingerprints is not paired but
refined: the bits outside its segment are cut in two and indexed the same way, once more if need be. After three levels a key
leaves 8 bits and three wiped ones open, so no more than 2,048 fingerprints can share it, whatever the input.

Equal fingerprints are one node from the start, so exact copies never meet each other. Of large keys only a spanning forest of
the links is kept, of small ones each link once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import fresh, small_batches, table, texts_of, tidy, written
from factorspark.llm.graph import components

SHINGLE, BITS, SEED = 3, 3, 42
SMALL, HOT = 32, 4_096
#: Keys of documents that are broadcast, once counted.
BROADCAST = 1 << 18


def fingerprint(text: str, words_in_shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all shingles, repeats included; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_in_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, "int64")
    for at in range(0, len(first), 65_536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536])], "<u8")
        counts += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(counts * 2 > len(first), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_in_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp): MD5 and fingerprint, as a signed bigint, of each whole text. Null text has no words and no MD5."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words_in_shingle) for t in texts_of(batch)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(prints)], names=["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("mark"), "text")
    return rows.mapInArrow(tidy(of), "doc_id bigint, mark string, fp bigint")


def variants(nodes: DataFrame, width: int) -> DataFrame:
    """Each of (key, fp, rest) under all its one-wildcard variants of the two halves of its `width` open bits."""
    half = width // 2
    mask = (1 << half) - 1
    wiped = (
        f"(shiftrightunsigned(rest, CAST(i DIV {half} AS INT) * {half}) & {mask}L)"
        f" & ~shiftleft(1L, CAST(i % {half} AS INT))"
    )
    first = f"shiftleft(CAST(i AS BIGINT), {half}) | ({wiped})"
    return nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1)))).select(
        (F.expr(first) if width == 64 else F.expr(f"xxhash64(key, i, {wiped})")).alias("key"),
        "fp",
        F.expr(f"shiftrightunsigned(rest, CAST(1 - i DIV {half} AS INT) * {half}) & {mask}L").alias("rest"),
    )


def _forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among different fingerprints, by searching breadth first in blocks."""
    left, right, rest = [], [], prints
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:64], front[64:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                left.append(block[near[:, hit].argmax(axis=0)])
                right.append(rest[hit])
                front, rest = np.concatenate((front, rest[hit])), rest[~hit]
    none = np.zeros(0, "u8")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(keys: np.ndarray, prints: np.ndarray, bits: int, first_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within each key of sorted rows."""
    n = len(keys)
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, min(SMALL, n)):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(i):
            break
        a, b = prints[i], prints[i + d]
        keep = (np.bitwise_count(a ^ b) <= bits) & (a != b)
        if first_level:  # a pair meets under many keys; it counts under one of them
            at = keys[i].view("u8") >> np.uint64(32)
            low = np.bitwise_count((a ^ b) & np.uint64(0xFFFFFFFF))
            high = np.bitwise_count((a ^ b) >> np.uint64(32))
            keep &= np.where(at < 32, (low == 1) | (at == 0), (low > 1) & ((high == 1) | (at == 32)))
        left.append(a[keep])
        right.append(b[keep])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = _forest(np.unique(prints[bounds[g] : bounds[g + 1]]), bits)
        left.append(a)
        right.append(b)
    none = np.zeros(0, "u8")
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """(a, b): links between different `fp`, enough of them to reach whatever all links reach."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    nodes = prints.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("rest")).distinct()
    found = None
    for width in (64, 32, 16):
        last = width == 16

        def pair(batches: Iterator[pa.RecordBatch], first=width == 64, last=last) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by key. Rows of a key with too many are passed on as (key, fp, rest)."""
            held = [np.zeros(0, "i8")] * 3
            passing = None  # the hot key whose rows are coming

            def out(hot_rows, a, b):
                n, m = len(hot_rows[0]), len(a)
                pad = np.zeros(m, "i8")
                columns = [np.concatenate(x) for x in (
                    (hot_rows[0], pad), (hot_rows[1], a.view("i8")), (hot_rows[2], b.view("i8")), (np.ones(n, bool), np.zeros(m, bool)))]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp", "rest", "hot"])

            none = [np.zeros(0, "i8")] * 3
            for batch in batches:
                held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
                if passing is not None:
                    n = int(np.searchsorted(held[0] != passing, True))
                    yield out([h[:n] for h in held], *[np.zeros(0, "u8")] * 2)
                    held = [h[n:] for h in held]
                    if not len(held[0]):
                        continue
                    passing = None
                edge = int(np.flatnonzero(held[0] == held[0][-1])[0])
                if edge:
                    yield out(*_sorted_out([h[:edge] for h in held], first, last))
                    held = [h[edge:] for h in held]
                if len(held[0]) > hot and not last:
                    passing = held[0][0]
                    yield out(held, *[np.zeros(0, "u8")] * 2)
                    held = none
            if len(held[0]):
                yield out(*_sorted_out(held, first, last))

        def _sorted_out(rows, first, last):
            """Whole keys: those with too many rows, and the links of the others."""
            keys = rows[0]
            bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            sizes = np.diff(bounds)
            many = np.repeat((sizes > hot) & (not last), sizes)
            return [r[many] for r in rows], *_links(keys[~many], rows[1][~many].view("u8"), bits, first)

        met = variants(nodes, width).repartition("key").sortWithinPartitions("key")
        step = written(met.mapInArrow(tidy(pair), "key bigint, fp bigint, rest bigint, hot boolean"), "simhash")
        edges = step.where("NOT hot").select(F.col("fp").alias("a"), F.col("rest").alias("b"))
        found = edges if found is None else found.union(edges)
        nodes = step.where("hot").select("key", "fp", "rest")
        if last or nodes.isEmpty():
            return found


def _members(docs: DataFrame, bits: int, hot: int, words_in_shingle: int) -> DataFrame:
    """(doc_id, mark, fp, part, component_id): every row with its component, by smallest fingerprint and by smallest id."""
    prints = written(fingerprints(docs, words_in_shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = components(links(nodes, bits, hot)).withColumnsRenamed({"node": "fp", "component": "part"})
    of = nodes.join(parts, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    names = of.groupBy("part").agg(F.min("first").alias("component_id"))
    return prints.join(of.join(names, "part").select("fp", "part", "component_id"), "fp")


def near_duplicates(docs: DataFrame, bits: int = BITS, hot: int = HOT, words_in_shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; documents link at `bits` or fewer differing bits.

    component_id is the smallest doc_id reachable, itself included. Null and empty texts have fingerprint zero and link like
    any other. Repeated rows give repeated rows; a null id has a component, but never names one unless it holds no other.
    """
    found = _members(docs, bits, hot, words_in_shingle)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, bits: int = BITS, hot: int = HOT, words_in_shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one document of each component: that with the smallest id, ids before null, of equal ids the smallest MD5 of
    the text. Of repeated rows one stays."""
    return first_of_parts(docs, _members(docs, bits, hot, words_in_shingle))


def first_of_parts(docs: DataFrame, found: DataFrame, most: int = BROADCAST) -> DataFrame:
    """`docs` with one row of each part of `found` (doc_id, mark, part), as `without_near_duplicates` says.

    What goes, and what is repeated, is counted first: up to `most` keys are broadcast, more are joined by a shuffle.
    """
    # Structs order null first; the flag puts rows without id last.
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark")
    rows = found.groupBy("part", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).withColumn("own", order)
    first = rows.groupBy("part").agg(F.min("own").alias("first"))
    keys = rows.join(first, "part").select(
        F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), (F.col("own") == F.col("first")).alias("kept"), "n"
    )
    keys = written(keys.where("NOT kept OR n > 1"), "keys")
    id_, mark = fresh(docs, "key_id"), fresh(docs, "key_mark")
    with_mark = docs.withColumn(mark, F.md5("text"))

    def chosen(rows: DataFrame, condition: str, how: str) -> DataFrame:
        some = keys.where(condition).select(F.col("key_id").alias(id_), F.col("key_mark").alias(f"{mark}_"))
        some = F.broadcast(some) if some.count() <= most else some
        return rows.join(some, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col(mark).eqNullSafe(F.col(f"{mark}_")), how)

    rows = chosen(with_mark, "NOT kept", "left_anti")
    if keys.where("kept").isEmpty():
        return rows.drop(mark)
    single = chosen(rows, "kept", "left_anti").unionByName(chosen(rows, "kept", "left_semi").dropDuplicates(["doc_id", mark]))
    return single.drop(mark)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
