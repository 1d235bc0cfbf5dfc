"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (stage of the pipeline).

SimHash deletion variants (operator 1, over the majority bits of the same sets) bring most copies together first. What they miss
is found by an index: sets that similar share one of the first `n - ceil(0.8 n) + 1` shingles of each, whatever order all sets
are read in, so each set is indexed by these only. Shingles that are common, by counts of buckets over all sets, come last in the
order, which only makes the lists of the index short. Every pair that meets, by either way, is verified by its whole sets: none is missed or added.

Equal sets are one node from the start. Pairs are first ruled out by the parities of their sets, a bit for each shingle; whole sets are
fetched only for what passes. Short lists are paired. The nodes of longer lists that hold several parts are indexed anew, in the order of
how many of these sets hold each shingle. Two sets meet first where the shingles before are in one of them only, so their places there
say how much they can share at most; a copy with many changes of its own meets no other at all. In a few rounds each list links its
members to one of them, first to that with the least changes; nodes
linked are one part from then on, and lists within one part are done. Of lists that still hold several
parts, the nodes outside the largest part are paired with those of the rest that their places allow. A list with more than `HOT` of them is refined first: sets that similar share two of their
first `n - ceil(0.8 n) + 2` shingles, so it is cut by a second shingle, then by a third. Sets are hashed anew from the texts whenever they are needed.
Shingles are compared by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm import simhash
from factorspark.llm.common import discard, release, small_batches, texts_of, tidy, written
from factorspark.llm.graph import components

SHINGLE = 5
#: The least similarity, as a fraction, so that comparisons are of whole numbers.
SIMILAR = (4, 5)
#: Buckets of the counts that the order of shingles goes by, slices that they are sent in, and the least count that moves a bucket.
BUCKETS, SLICES, COMMON = 1 << 22, 64, 4
#: Rounds of stars before what is left is paired, nodes outside the largest part of a list that is paired, and shingles that
#: lists are cut by.
STARS, HOT, DEEPEST = 3, 256, 3
#: Entries of a list whose nodes are all paired at once.
SMALL = 64
#: Marks of texts that are broadcast, once counted; beyond, the join is a shuffle.
BROADCAST = 1 << 17
#: Bytes hashed at a time, and different nodes that a task remembers.
CHUNK, SEEN = 1 << 20, 1 << 18

_WHITE = re.compile(rb"[\x20\x09-\x0d]")


class Hasher:
    """Hashes of the runs of words of texts: a polynomial over the bytes, modulo 2^64, of the lower-cased words and a space after
    each. Its value does not depend on where a run stands, so a text is hashed in chunks of whole words."""

    def __init__(self, words: int = SHINGLE, seed: int = 0):
        rng = np.random.default_rng([seed, 42])
        self.words = words
        self.of_byte = rng.integers(0, 1 << 64, 256, dtype="u8")
        self.base = int(rng.integers(0, 1 << 64, dtype="u8")) | 5
        self._power(1)

    def _power(self, n: int) -> None:
        n = 1 << max(16, n.bit_length())
        up, down = np.full(n, self.base, "u8"), np.full(n, pow(self.base, -1, 1 << 64), "u8")
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    @staticmethod
    def _compact(data: bytes) -> np.ndarray:
        """The words, each with one space after it."""
        raw = np.frombuffer(data, "u1")
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        keep = ~white
        keep[1:] |= ~white[:-1]
        raw = np.where(white, np.uint8(32), raw)[keep]
        return raw if not len(raw) or raw[-1] == 32 else np.append(raw, np.uint8(32))

    def _runs(self, block: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """Hashes of all runs of k words, and where the last k - 1 words begin (0 if there are no more)."""
        ends = np.flatnonzero(block == 32) + 1
        starts = np.concatenate(([0], ends[:-1]))
        if len(ends) < k or not k:
            return np.zeros(0, "u8"), 0
        if len(block) >= len(self.up):
            self._power(len(block))
        sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(self.of_byte[block] * self.up[: len(block)])))
        first, last = starts[: len(ends) - k + 1], ends[k - 1 :]
        x = (sums[last] - sums[first]) * self.down[first]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32)), int(starts[len(ends) - k + 1]) if k > 1 else len(block)

    def __call__(self, text: str) -> np.ndarray:
        """Sorted different hashes of the runs of `words` words; of a shorter text, of all its words."""
        data = text.encode().lower()
        found, held, at = [], np.zeros(0, "u1"), 0
        while at < len(data):
            cut = _WHITE.search(data, at + CHUNK) if at + CHUNK < len(data) else None
            end = cut.end() if cut else len(data)
            held = np.concatenate((held, self._compact(data[at:end])))
            hashes, rest = self._runs(held, self.words)
            found.append(hashes)
            held, at = held[rest:], end
        all_ = np.concatenate([np.zeros(0, "u8"), *found])
        if not len(all_):
            all_ = self._runs(held, int(np.count_nonzero(held == 32)))[0]
        return np.unique(all_.view("i8"))


def node_of(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def parity(grams: np.ndarray) -> np.ndarray:
    """A bit for each shingle and more, at least 64, in words: which places an odd number of shingles fall on. Two sets differ by at
    least as many shingles as their parities by bits."""
    width = 64 << max(0, (len(grams) - 1).bit_length() - 6)
    odd = np.bincount((grams.view("u8") >> np.uint64(40)).astype("i8") & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("i8")


def majority(grams: np.ndarray) -> int:
    """SimHash fingerprint of a set."""
    counts = np.zeros(64, "int64")
    for at in range(0, len(grams), 65_536):
        bits = np.unpackbits(grams[at : at + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(counts * 2 > len(grams), bitorder="little").tobytes(), "little", signed=True)


def _over_nodes(docs: DataFrame, hasher: Hasher, each: Callable, schema: str, names: list[str]) -> DataFrame:
    """Rows that `each(node, grams)` gives as arrays, for the nodes of a task; one that it remembers is not taken again."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for text in texts_of(batch):
                grams = hasher(text)
                node = node_of(grams)[0]
                if node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    found.append(each(node, grams))
            columns = [np.concatenate(c) if isinstance(c[0], np.ndarray) else list(c) for c in zip(*(f for f in found if f))]
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.select("text").mapInArrow(tidy(of), schema)


def named(docs: DataFrame, hasher: Hasher) -> DataFrame:
    """(doc_id, mark, node, other, fp, n, bits): MD5 of the text; 128 bits, SimHash, size and parity of its set. Null text is empty."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hasher(t) for t in texts_of(batch)]
            nodes = np.array([node_of(s) for s in sets], "i8").reshape(-1, 2)
            prints = pa.array([majority(s) for s in sets], pa.int64())
            sizes, bits = pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(nodes[:, 0]), pa.array(nodes[:, 1]), prints, sizes, bits],
                names=["doc_id", "mark", "node", "other", "fp", "n", "bits"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("mark"), "text")
    return rows.mapInArrow(tidy(of), "doc_id bigint, mark string, node bigint, other bigint, fp bigint, n int, bits array<bigint>")


def common_buckets(docs: DataFrame, hasher: Hasher) -> np.ndarray:
    """In how many nodes the shingles of each bucket occur; counts that chance explains are 0. Of a size that does not depend on the
    data: a task adds up its counts before it sends them, in slices; the driver gets sums, and counts below `COMMON` as 0, compressed."""
    small_batches(docs.sparkSession)
    width = BUCKETS // SLICES

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.zeros(BUCKETS, "int32")
        for batch in batches:
            for text in texts_of(batch):
                grams = hasher(text)
                node = node_of(grams)[0]
                if node not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    counts[grams & (BUCKETS - 1)] += 1
        data = [zlib.compress(counts[k * width : (k + 1) * width].tobytes(), 1) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(data, pa.binary())], names=["slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices come sorted."""

        def summed():
            high = np.where(total < COMMON, 0, np.minimum(total, np.iinfo("int32").max)).astype("int32")
            arrays = [pa.array([at], pa.int32()), pa.array([int(total.sum())], pa.int64()), pa.array([zlib.compress(high.tobytes(), 1)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["slice", "total", "data"])

        at, total = None, None
        for batch in itertools.chain(batches, [None]):
            for k, data in ((None, None),) if batch is None else zip(*(batch.column(c).to_pylist() for c in ("slice", "data"))):
                if k != at and at is not None:
                    yield summed()
                if k != at:
                    at, total = k, np.zeros(width, "int64")
                if k is not None:
                    total += np.frombuffer(zlib.decompress(data), "int32")

    sent = docs.select("text").mapInArrow(tidy(of), "slice int, data binary").repartition("slice").sortWithinPartitions("slice")
    out, total = np.zeros(BUCKETS, "int32"), 0
    for row in sent.mapInArrow(tidy(add), "slice int, total bigint, data binary").collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), "int32")
        total += row["total"]
    mean = total / BUCKETS
    out[out < max(COMMON, mean + 4 * mean**0.5)] = 0
    return out


def in_order(grams: np.ndarray, common: np.ndarray, similar: tuple[int, int], depth: int = 1) -> np.ndarray:
    """The first shingles of a set, of which a similar set has at least `depth` among its own first ones."""
    top, bottom = similar
    length = len(grams) - -(-top * len(grams) // bottom) + depth if len(grams) else 0
    return grams[np.lexsort((grams, common[grams & (BUCKETS - 1)]))[:length]]


def postings(docs: DataFrame, hasher: Hasher, shared: Broadcast, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """(gram, node, n): the shingles of each set of which a similar set has at least one among its own."""

    def each(node: int, grams: np.ndarray):
        first = in_order(grams, shared.value, similar)
        return first, np.full(len(first), node, "i8"), np.full(len(first), len(grams), "i4")

    return _over_nodes(docs, hasher, each, "gram bigint, node bigint, n int", ["gram", "node", "n"])


def sets_of(docs: DataFrame, hasher: Hasher, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams) of the given nodes, written. Of each one text is read, found by its MD5."""
    marks = names.select("node", "mark").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    marks = written(marks.select(F.col("mark").alias("wanted")), "marks")
    wanted = F.broadcast(marks) if marks.count() <= BROADCAST else marks
    some = docs.select("text").join(wanted, F.md5("text") == F.col("wanted"), "left_semi")
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hasher(t) for t in texts_of(batch)]
            keys = pa.array([node_of(s)[0] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    made = written(some.mapInArrow(tidy(of), "node bigint, grams array<bigint>").dropDuplicates(["node"]), "sets")
    discard(marks)
    return made


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b, ...) of nodes whose sets are similar, written."""
    top, bottom = similar
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    enough = both * (top + bottom) >= (F.size("of_a") + F.size("of_b")) * top
    return written(pairs.join(right, "b").join(left, "a").where(enough).drop("of_a", "of_b"), "links")


def _differ(a: str, b: str) -> Column:
    """Bits in which two parities differ; that of the larger set is folded, as its size is at most a quarter larger."""

    def folded(x: str, y: str) -> Column:
        half = F.size(y)
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > half, both).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


class Parts:
    """Which part each node belongs to, as links come in."""

    def __init__(self, docs: DataFrame, hasher: Hasher, names: DataFrame, nodes: DataFrame, similar: tuple[int, int]):
        self.docs, self.hasher, self.names, self.nodes, self.similar = docs, hasher, names, nodes, similar
        self.of = written(nodes.select("node", F.col("node").alias("part")), "parts")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs of different parts that their sizes and parities do not rule out."""
        top, bottom = self.similar
        known = self.nodes.select("node", "n", "bits").join(self.of, "node")
        a, b = (known.select(*[F.col(c).alias(f"{c}_{x}") for c in known.columns]).withColumnRenamed(f"node_{x}", x) for x in "ab")
        n, least = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b") * bottom >= F.greatest("n_a", "n_b") * top
        # Of n elements in both sets together, similar ones share n * top / (top + bottom) or more.
        most = n * (bottom - top) >= _differ("bits_a", "bits_b") * (bottom + top)
        met = pairs.distinct().join(a, "a").join(b, "b").where((F.col("part_a") != F.col("part_b")) & least).where(most)
        return written(met.select("a", "b", "part_a", "part_b"), "pairs")

    def link(self, pairs: DataFrame) -> None:
        """Join the parts of those pairs (a, b) that are similar; pairs of one part are not looked at again."""
        likely = self._likely(pairs)
        ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        if ends.isEmpty():
            discard(likely)
            return
        sets = sets_of(self.docs, self.hasher, self.names, ends)
        links = verified(likely, sets, self.similar)
        joined = components(links, "part_a", "part_b").select(F.col("node").alias("part"), "component")
        before = self.of
        self.of = written(before.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("part")), "parts")
        for old in (before, likely, sets, links):
            discard(old)


def _anew(sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(key, used, node, n, at): an index of the sets by their first shingles, those that the fewest of them hold first, with the place
    of each in its set. Rows that the sizes of the sets with their shingle rule out are left out."""
    top, bottom = similar
    every = sets.select("node", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    held = every.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("low"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("rows", "key")) - 1
    rows = every.join(held, "key").withColumn("at", place).where("rows > 1")
    first = F.col("n") - F.col("at")
    rows = rows.where(first * bottom >= F.col("n") * top).where(first * (top + bottom) >= (F.col("n") + F.col("low")) * top)
    return rows.select("key", F.array("key").alias("used"), "node", "n", "at")


def _of_several(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of lists (key, node, ...) with their part, of lists that hold more than one, written. `major` is the part with most
    nodes of the list, `minor` counts the others."""
    now = rows.join(parts, "node")
    shares = now.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    most = F.max(F.struct("m", "part"))
    lists = shares.groupBy("key").agg(most["part"].alias("major"), (F.sum("m") - most["m"]).alias("minor")).where("minor > 0")
    return written(now.join(lists, "key"), "index")


def _star(rows: DataFrame, number: int) -> DataFrame:
    """(a, b): each node of a list with one of another part than its own: that with the least before its shingle, in later rounds
    the first in an order that differs by round."""
    order = F.xxhash64("node", F.lit(number)) if number else F.col("at")
    hubs = rows.groupBy("key").agg(F.min(F.struct(order, "node", "part")).alias("m"))
    met = rows.join(hubs, "key").where("part <> m.part")
    return met.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))


def _all_pairs(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b): the nodes of a list outside its major part with those of all other parts, where their places let them share enough."""
    top, bottom = similar
    other = rows.where("part <> major").select("key", *[F.col(c).alias(f"{c}_") for c in ("n", "at")], F.col("node").alias("other"), F.col("part").alias("of"))
    most = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_"))
    met = rows.join(other, "key").where("part <> of").where(most * (top + bottom) >= (F.col("n") + F.col("n_")) * top)
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _cut_deeper(rows: DataFrame, sets: DataFrame, shared: Broadcast, similar: tuple[int, int], depth: int) -> DataFrame:
    """Lists (key, used, node, n, at) cut by one more shingle: similar sets share `depth` of their first ones. Places count no more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for used, grams, node, n in zip(*(batch.column(c).to_pylist() for c in ("used", "grams", "node", "n"))):
                more = np.setdiff1d(in_order(np.array(grams, "i8"), shared.value, similar, depth), np.array(used, "i8"))
                # A shingle is added to a list once, in whatever order the others came.
                lists = [sorted([*used, int(g)]) for g in more]
                m = len(lists)
                columns = [pa.array(lists, pa.list_(pa.int64())), pa.array([node] * m, pa.int64()), pa.array([n] * m, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["used", "node", "n"])

    deeper = rows.select("used", "node", "n").join(sets, "node").mapInArrow(tidy(of), "used array<bigint>, node bigint, n int")
    return deeper.distinct().withColumns({"key": F.xxhash64("used"), "at": F.lit(0)})


def _pairs_of_small(rows: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(a, b): all nodes of a list of at most `SMALL`."""
    lists = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("x")).where(F.size("x") > 1)
    top, bottom = similar

    def after(x: Column, i: Column) -> Column:
        fit = lambda y: F.greatest(x["n"], y["n"]) * top <= F.least(x["n"], y["n"]) * bottom
        rest = F.filter(F.slice("x", i + 2, F.size("x")), fit)
        return F.transform(rest, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    return lists.select(F.explode(F.flatten(F.transform("x", after))).alias("p")).select("p.a", "p.b")


def similar_parts(docs: DataFrame, hasher: Hasher, names: DataFrame, similar: tuple[int, int] = SIMILAR, stars: int = STARS, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """(node, part): the smallest node reachable by similar sets, for every node."""
    shared = docs.sparkSession.sparkContext.broadcast(common_buckets(docs, hasher))
    nodes = written(names.select("node", "fp", "n", "bits").dropDuplicates(["node"]), "nodes")
    parts = Parts(docs, hasher, names, nodes, similar)

    # Operator 1: fingerprints within reach of each other, by one node of each; nodes of one fingerprint by its first.
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab")
    near = simhash.links(nodes.select("fp")).join(a, "a").join(b, "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    parts.link(same.union(near))

    # Copies are one node; only shingles of several nodes bring anything together.
    index = postings(docs, hasher, shared, similar)
    several = index.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("rows"))
    rows = index.join(several.where("low < high").select("gram", "rows"), "gram").withColumnRenamed("gram", "key")
    rows = written(rows, "postings")
    parts.link(_pairs_of_small(rows.where(F.col("rows") <= small), similar))

    # What meets in short lists only is settled; the nodes of the others are indexed anew among themselves.
    several = _of_several(rows.where(F.col("rows") > small).select("key", "node"), parts.of)
    sets = sets_of(docs, hasher, names, several.select("node").distinct())
    lists = written(_anew(sets, similar), "lists")
    for old in (rows, several, sets):
        discard(old)
    for depth in itertools.count(1):
        for number in range(stars):
            now = _of_several(lists, parts.of)
            if now.isEmpty():
                discard(now)
                break
            parts.link(_star(now, number))
            discard(now)
        now = _of_several(lists, parts.of)
        parts.link(_all_pairs(now.where(F.col("minor") <= hot) if depth < DEEPEST else now, similar))
        left = now.where(F.col("minor") > hot)
        if depth == DEEPEST or left.isEmpty():
            break
        sets = sets_of(docs, hasher, names, left.select("node").distinct())
        deeper = written(_cut_deeper(left, sets, shared, similar, depth + 1), "lists")
        for old in (lists, now, sets):
            discard(old)
        lists = deeper
    discard(lists)
    # All that reads the counts is written by now.
    shared.destroy()
    release()
    return parts.of


def without_similar(docs: DataFrame, similar: tuple[int, int] = SIMILAR, words_in_shingle: int = SHINGLE, stars: int = STARS, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """`docs` with one document of each component of similar ones: that with the smallest id, ids before null, of equal ids the
    smallest MD5 of the text.

    Null and empty texts, and those of white space only, have the empty set, which is similar to itself alone. A text of fewer
    words than a shingle is one shingle. Of repeated rows one stays. Long texts are hashed in chunks; their sets are held whole.
    An empty table stays empty. Other columns are passed on, whatever their names.
    """
    for seed in itertools.count():
        hasher = Hasher(words_in_shingle, seed)
        names = written(named(docs, hasher), "names")
        # Nodes go by 64 of their 128 bits; should those of two sets agree, all is hashed anew.
        if names.groupBy("node").agg((F.min("other") < F.max("other")).alias("two")).where("two").isEmpty():
            break
    parts = similar_parts(docs, hasher, names, similar, stars, hot, small)
    found = names.select("doc_id", "mark", "node").join(parts, "node")
    return simhash.first_of_parts(docs, found)
