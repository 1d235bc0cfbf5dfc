"""Removal of repeated passages with suffix arrays (operator 9).

A byte goes if it lies in a string of `LENGTH` bytes that also starts in a document with a smaller id.

1. Documents are dealt to shards by the smallest hash of their 16-byte grams, so that near copies lie together, and a shard
   holds each different text once. Ranges of (hash, text, id) are cut by rows, so a text with many copies spans shards. A text
   longer than a shard is dealt in stretches that overlap by a string less a byte; its rows are put together at the end.
2. Every string of 50 bytes holds a gram whose hash is the least of its 35; these anchors depend on the string alone. Grams that
   only one text has cannot lie in a repeated string. Each shard sends its different anchors, packed by ranges of hashes.
3. A shard sorts the suffixes around shared anchors by Larsson-Sadakane refinement (groups of equal prefixes are sorted by the
   rank of what follows, doubling the length; settled ones rest) and cuts them into runs of equal strings by Kasai's common
   prefixes. Strings around anchors that other shards have as well are sent on once a shard, with their smallest id: those in a
   row with the same least gram as one stretch of text, to the range of that gram, where all equal strings meet.
4. There the sorted strings of the shards are merged by binary search, with a digest as first key and compared byte for byte; a
   shard learns of each string whether a smaller id than its own has it.

All that is sent are packed arrays; nothing is ever gathered by string, so a passage that a third of all documents share is one
entry of each shard.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import discard, release, slices, small_batches, table, tidy, written

LENGTH, GRAM = 50, 16
#: Bytes of different texts in a shard; anchors and runs in a range of hashes.
SHARD_BYTES, RANGE = 1 << 20, 250_000
#: Grams that are hashed at a time.
BLOCK = 1 << 15
#: Strings that are merged at a time.
AT_ONCE = 1 << 17
NOBODY = np.iinfo("int64").max  # stands for the id of documents without one, which are marked: "-"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_at(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as a little-endian number; zeros follow the end."""
    return words_seen(data).copy()


def words_seen(data: bytes) -> np.ndarray:
    """The same, read from the bytes themselves whenever it is indexed."""
    return np.ndarray(len(data), "<u8", np.frombuffer(data + bytes(8), "u1"), strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position on."""
    return _mix(words[: max(0, len(words) - 8)] * _ODD[0] ^ _mix(words[8:] * _ODD[1]))


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of each `width` values in a row."""
    span, out = 1, values
    while span * 2 <= width:
        out = least(out[:-span], out[span:])
        span *= 2
    return least(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def anchors(hashes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions whose hash is the least in some window of as many grams as a string of `length` has."""
    width = length - GRAM + 1
    if len(hashes) < width:
        return np.zeros(0, "int64")
    low = _sliding(hashes, width, np.minimum)
    edge = np.zeros(width - 1, "u8")
    return np.flatnonzero(hashes == _sliding(np.concatenate((edge, low, edge)), width, np.maximum))


def anchors_in(data: bytes, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each anchor of some bytes. They are looked for block by block, with as many grams more on either side as
    share a string with one of the block, so that numbers stay in the cache."""
    words, halo, found = words_seen(data), length - GRAM, []
    n = max(0, len(words) - 8)
    for a in range(0, n, block):
        low, high = max(0, a - halo), min(n, a + block + halo)
        hashes = gram_hashes(words[low : high + 8].copy())
        at = anchors(hashes, length)
        at = at[(at >= a - low) & (at < a + block - low)]
        found.append((at + low, hashes[at]))
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, "int64"), np.zeros(0, "u8")), *found))


def least_hashes(texts: list[bytes], at_once: int = BLOCK) -> np.ndarray:
    """The least hash of the grams of each text, 0 if it has none; texts are looked at some together."""
    sizes = np.array([len(t) for t in texts], "int64")
    out = np.zeros(len(texts), "u8")
    for a, b in slices(sizes.tolist(), at_once):
        hashes = gram_hashes(words_at(b"".join(texts[a:b])))
        ends = np.cumsum(sizes[a:b])
        some = np.flatnonzero(sizes[a:b] >= GRAM)
        # From the start of each text to the end of its last gram, and from there to the next text.
        bounds = np.column_stack((ends[some] - sizes[a:b][some], ends[some] - GRAM + 1)).ravel()
        if len(some):
            out[a + some] = np.minimum.reduceat(hashes, bounds)[::2]
    return out


def _heads(key: np.ndarray) -> np.ndarray:
    """Of each place in a sorted array the first with the same value."""
    first = np.zeros(len(key), "int32")
    fresh = np.flatnonzero(key[1:] != key[:-1]) + 1
    first[fresh] = fresh
    return np.maximum.accumulate(first, out=first)


def suffix_order(words: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes with `length` bytes of room, in order of these bytes, by Larsson-Sadakane refinement.

    `room` counts the bytes up to the end of a suffix's own text. Each round sorts only the groups that are not settled.
    """
    at = np.flatnonzero(room >= 8).astype("int32")
    key = words[at].byteswap()
    order = np.argsort(key)
    at, key = at[order], key[order]
    rank = np.full(len(words) + length, -1, "int32")
    head = _heads(key)
    rank[at] = head
    known = 8
    while known < length:
        step = min(known, length - known)
        # In order of their heads; a group of one is settled.
        same = np.zeros(len(at) + 1, bool)
        np.equal(head[1:], head[:-1], out=same[1:-1])
        open_ = np.flatnonzero((same[1:] | same[:-1]) & (room[at] >= known + step)) if len(at) else at
        at, head = at[open_], head[open_]
        both = head.astype("int64") << 32 | rank[at + step]
        order = np.argsort(both)
        at, both = at[order], both[order]
        # Groups keep their places in the sorted array.
        head += _heads(both) - _heads(head)
        rank[at] = head
        known += step
    at = np.flatnonzero(room >= length)
    both = np.sort(rank[at].astype("int64") << 32 | at)  # equal ranks by place
    return (both & 0xFFFFFFFF).astype("int32")


def common_prefixes(words: np.ndarray, order: np.ndarray, limit: int = LENGTH, lanes: int = 4_096) -> np.ndarray:
    """Length, up to `limit`, of what each suffix shares with the one before it in `order`, by Kasai's rule.

    Walking through the text, a suffix shares at least one byte less than the one before it did. Many stretches of the text are
    walked side by side. `order` may leave suffixes out, and those that are equal up to the limit stand in any order: bytes count as
    shared only if the suffix before moved along, and then they are the same bytes, a full match included.
    """
    n, order = len(order), order.astype("int64")
    if not n:
        return np.zeros(0, "int32")
    before = np.concatenate(([-1], order[:-1]))
    text = np.full(int(order.max()) + 1, -1, "int64")
    text[order] = np.arange(n)
    text = text[text >= 0]
    height = -(-n // lanes)
    place = np.concatenate((text, np.full(height * lanes - n, -1))).reshape(lanes, height).T.copy()
    i, j = np.where(place >= 0, order[place], 0), np.where(place >= 0, before[place], -1)
    steps = i[1:] - i[:-1]
    moved = (j[:-1] >= 0) & (j[1:] - j[:-1] == steps)
    shared, one = np.zeros(lanes, "int64"), np.uint64(1)
    found = np.empty((height, lanes), "int32")
    for k in range(height):
        if k:
            shared = np.where(moved[k - 1], np.maximum(shared - steps[k - 1], 0), 0)
        a, b, so_far, open_ = i[k], j[k], shared, slice(None)
        while len(a):
            differ = words.take(a + so_far, mode="clip") ^ words.take(b + so_far, mode="clip")
            # Zero bits below the first that differs: eight bytes if none does.
            so_far = so_far + (np.bitwise_count(~differ & (differ - one)) >> 3)
            shared[open_] = so_far
            on = np.flatnonzero((differ == 0) & (so_far < limit))
            open_, a, b, so_far = on if isinstance(open_, slice) else open_[on], a[on], b[on], so_far[on]
        shared[j[k] < 0] = 0
        found[k] = np.minimum(shared, limit, out=shared)
    out = np.empty(n, "int32")
    out[text] = found.T.ravel()[:n]
    return out


def rows_of_words(words: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The `length` bytes from each of the positions on as rows of big-endian numbers, which are in order as the bytes are."""
    return np.stack([words[at + offset].byteswap() for offset in [*range(0, length - 7, 8), length - 8]], axis=1)


def find(strings: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted row among sorted different rows, whether it is there) by binary search, word by word."""
    low = np.searchsorted(strings[:, 0], wanted[:, 0], "left")
    high = np.searchsorted(strings[:, 0], wanted[:, 0], "right")
    for k in range(1, strings.shape[1]):
        # Between `low` and `high` the words before are equal to those wanted.
        several = np.flatnonzero(high > low)
        if not len(several):
            break
        column, value = strings[:, k], wanted[several, k]
        ends = []
        for right in (False, True):
            a, b = low[several].copy(), high[several].copy()
            open_ = np.arange(len(several))
            while len(open_):
                middle = (a[open_] + b[open_]) >> 1
                before = column[middle] <= value[open_] if right else column[middle] < value[open_]
                a[open_] = np.where(before, middle + 1, a[open_])
                b[open_] = np.where(before, b[open_], middle)
                open_ = open_[a[open_] < b[open_]]
            ends.append(a)
        low[several], high[several] = ends
    return low, high > low


def digest(strings: np.ndarray) -> np.ndarray:
    """A first key of rows of words."""
    out = np.full(len(strings), strings.shape[1], "u8")
    for column in strings.T:
        out = _mix((out ^ column) * _ODD[0] + _ODD[1])
    return out


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of (different strings in order of their bytes, smallest id of each) as one."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    place, there = find(a[0], b[0])
    least = a[1].copy()
    least[place[there]] = np.minimum(least[place[there]], b[1][there])
    new = ~there
    return np.insert(a[0], place[new], b[0][new], axis=0), np.insert(least, place[new], b[1][new])


def smaller_elsewhere(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first_key: bool = True) -> list[np.ndarray]:
    """For each list of (keys in order, strings, ids), no string twice in a list: which of its strings have a smaller id elsewhere.

    The sorted lists are merged by their keys (a stable sort finds the runs and merges them by galloping binary search), and bytes are
    compared wherever keys are equal. Should two strings share a key, lists are merged and searched by the bytes alone.
    """
    sizes = np.cumsum([len(k) for k, *_ in lists])
    if first_key and len(lists):
        found = _smaller_by_key(*(np.concatenate(x) for x in zip(*lists)))
        if found is not None:
            return np.split(found, sizes[:-1])
    ranked = [(t[o], i[o]) for _, t, i in lists if len(t) for o in (np.lexsort(t.T[::-1]),)]
    while len(ranked) > 1:
        pairs = list(zip(ranked[::2], ranked[1::2]))
        ranked = [merged(a, b) for a, b in pairs] + ranked[2 * len(pairs) :]
    return [ranked[0][1][find(ranked[0][0], t)[0]] < i if len(t) else np.zeros(0, bool) for _, t, i in lists]


def _smaller_by_key(key: np.ndarray, strings: np.ndarray, least: np.ndarray) -> np.ndarray | None:
    """The same for lists one after the other, all in one; nothing if two strings share a key."""
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    if (strings[order[again]] != strings[order[again - 1]]).any():
        return None
    fresh = np.ones(len(key), bool)
    fresh[again] = False
    heads, least = np.flatnonzero(fresh), least[order]
    low = np.minimum.reduceat(least, heads) if len(heads) else least
    out = np.zeros(len(key), bool)
    out[order] = low[np.cumsum(fresh) - 1] < least
    return out


class Shard:
    """Different texts of a shard laid end to end, with the smallest id of each."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        self.texts, self.ids = texts, np.asarray(ids, "int64")
        self.data = b"".join(texts)
        self.sizes = np.array([len(t) for t in texts], "int64")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._all_anchors: tuple | None = None
        #: The text of each byte.
        self.of = np.repeat(np.arange(len(texts), dtype="int32"), self.sizes)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, hash and text of each anchor whose gram lies within one text; computed once."""
        if self._all_anchors is None:
            self._all_anchors = self._find_anchors(length)
        return self._all_anchors

    def _find_anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, hashes = anchors_in(self.data, length)
        of = self.of[at]
        inside = at + GRAM <= (self.starts + self.sizes)[of]
        return at[inside], hashes[inside], of[inside]

    def least_grams(self, at: np.ndarray, length: int) -> np.ndarray:
        """The least hash of the grams in each string from `at` on: the one of the first of its anchors that is least."""
        place, hashes, _ = self._all_anchors
        out = np.full(len(at), np.iinfo("u8").max, "u8")
        # How many anchors lie before each position.
        before = np.zeros(len(self.data) + 2, "int32")
        before[place + 1] = 1
        np.cumsum(before, out=before)
        low, high = before[at], before[at + (length - GRAM + 1)]
        for k in range(int((high - low).max(initial=0))):
            inside = np.flatnonzero(low + k < high)
            out[inside] = np.minimum(out[inside], hashes[low[inside] + k])
        return out

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Different anchor hashes in order, and whether more than one text of the shard has them."""
        _, hashes, of = self.anchors(length)
        order = np.argsort(hashes)
        hashes, of = hashes[order], of[order]
        if not len(hashes):
            return hashes, np.zeros(0, bool)
        heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        return hashes[heads], np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads)

    def around(self, cross: np.ndarray, inner: np.ndarray, length: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Which positions begin a string of `length` that lies in one text and holds an anchor among `cross`, and which do with
        one among either: numbers made of the range and the low 32 bits of a hash."""
        at, hashes, of = self.anchors(length)
        hashes = part_of(hashes, ranges) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        n, found = len(self.data) + 1, np.zeros((2, len(at)), bool)
        for hit, shared in zip(found, (np.sort(cross), np.sort(np.concatenate((cross, inner))))):
            if len(shared):
                place = np.searchsorted(shared, hashes)
                np.equal(shared[np.minimum(place, len(shared) - 1)], hashes, out=hit)
        out = []
        for hit in found:
            low = np.maximum(at[hit] - (length - GRAM), self.starts[of[hit]])
            high = np.minimum(at[hit], (self.starts + self.sizes)[of[hit]] - length)
            fine = low <= high
            marks = np.zeros(n, "int32")
            np.add.at(marks, low[fine], 1)
            np.subtract.at(marks, high[fine] + 1, 1)
            out.append(np.cumsum(marks[:-1], out=marks[:-1]) > 0)
        return out[0], out[1]

    def runs(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions of `starts` in suffix order, number of the run of equal strings of each)."""
        # The suffixes sorted are all of the stretches that the strings cover, as if each stretch were a text.
        marks = np.zeros(len(self.data) + 1, "int32")
        at = np.flatnonzero(starts)
        marks[at] += 1
        marks[at + length] -= 1
        covered = np.flatnonzero(np.cumsum(marks[:-1], out=marks[:-1]) > 0).astype("int32")
        if not len(covered):
            return at, at
        # Stretches of neighbouring texts may touch; a string that would cross is left out below.
        stretch = np.frombuffer(self.data, "u1")[covered].tobytes()
        fresh = np.zeros(len(self.data) + 1, bool)
        fresh[self.starts] = True
        ends = np.append((covered[1:] != covered[:-1] + 1) | fresh[covered[1:]], True)
        cut = np.flatnonzero(ends)
        room = np.repeat(cut, np.diff(cut, prepend=-1)).astype("int32") + 1 - np.arange(len(covered), dtype="int32")
        words = words_at(stretch)
        order = suffix_order(words, room, length)
        # A suffix begins a new run where it shares less than a string with the one before it.
        run = np.cumsum(common_prefixes(words, order, length) < length) - 1
        wanted = starts[covered[order]]
        run = run[wanted]
        return covered[order[wanted]].astype("int64"), np.cumsum(np.diff(run, prepend=run[:1]) > 0)


def _rows(names: list[str], rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Those of this process; many small pieces are packed."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(data: bytes) -> bytes:
    return _zstd()[0].compress(data)


def _unpacked(data: bytes) -> bytes:
    return _zstd()[1].decompress(data)


def _steps(values: np.ndarray) -> bytes:
    """Numbers as compressed differences; those of neighbouring strings are mostly 1."""
    return zlib.compress(np.diff(values, prepend=0).astype("int32").tobytes(), 1)


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "int32"), dtype="int64")


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash, of `parts` that get as many anchors each. Anchors are least hashes, and thus small; mixed once more
    they spread over all ranges."""
    return (_mix(hashes * _ODD[2]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def shards_of(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A written table of shards: its different texts end to end (compressed), their sizes, the ids of the rows of each, and, for
    stretches of longer texts, whose row they are of and the how many-th."""
    spark = docs.sparkSession
    small_batches(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, of = [], [], []
            for key, none, text in zip(*(batch.column(c).to_pylist() for c in ("id", "none", "data"))):
                text, end = text or b"", "-" if none else ""
                if len(text) <= shard_bytes:
                    ids.append(key)
                    texts.append(text)
                    of.append(end or None)
                    continue
                own = uuid.uuid4().hex
                for k, a in enumerate(range(0, len(text) - length + 1, shard_bytes)):
                    ids.append(key)
                    texts.append(text[a : a + shard_bytes + length - 1])
                    of.append(f"{own} {k} {end}")
            near = least_hashes(texts).view("i8")
            mark = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            columns = [pa.array(c, k) for c, k in ((ids, pa.int64()), (texts, pa.binary()), (near, pa.int64()), (mark, pa.binary()), (of, pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "data", "near", "mark", "of"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        ids: list[list] = []
        rows: list[list] = []
        marks: list[bytes] = []
        total = 0

        def flush():
            own = hashlib.blake2b(repr((ids, rows, marks)).encode(), digest_size=16).hexdigest()
            columns = [[own], [_packed(b"".join(texts))], [list(map(len, texts))], [ids], [rows]]
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "data", "sizes", "ids", "rows"])

        for batch in batches:
            for key, text, mark, of in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "mark", "of"))):
                if marks and mark == marks[-1]:
                    ids[-1].append(key)
                    rows[-1].append(of)
                    continue
                if texts and total + len(text) > shard_bytes:
                    yield flush()
                    texts, ids, rows, marks, total = [], [], [], [], 0
                texts.append(text)
                ids.append([key])
                rows.append([of])
                marks.append(mark)
                total += len(text)
        if texts:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NOBODY))).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("text").cast("binary").alias("data"))
    dealt = rows.mapInArrow(tidy(keyed), "id bigint, data binary, near bigint, mark binary, of string").repartitionByRange("near", "mark", "id")
    dealt = dealt.sortWithinPartitions("near", "mark", "id")
    return written(dealt.mapInArrow(tidy(pack), "shard string, data binary, sizes array<int>, ids array<array<bigint>>, rows array<array<string>>"), "shards")


def _shard(row) -> tuple[Shard, list[list]]:
    """The shard of a row, and the (id, stretch) of the rows of each of its texts."""
    ends = np.cumsum(np.asarray(row["sizes"], "int64"))
    data = _unpacked(row["data"])
    texts = [data[b - n : b] for n, b in zip(row["sizes"], ends)]
    ids = [[(int(x), of) for x, of in zip(*both)] for both in zip(row["ids"], row["rows"])]
    return Shard(texts, np.array([min(x for x, _ in g) for g in ids], "int64")), ids


def _outcome(raw: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str, bytes]:
    """What is told of a text of which some bytes go."""
    removed = int(np.count_nonzero(gone))
    kept = (raw[~gone] if removed else raw).tobytes()
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] > gone[:-1])) if removed else 0
    return len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, per_range: int = RANGE, keep_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by row of `docs`; `keep_text` adds `kept binary`.

    Null text is empty. Rows with equal ids never take from each other. A null id counts as larger than all others. Strings are
    judged on the input. Texts shorter than `length` keep everything. Repeated rows are rows of their own: of equal texts with
    different ids all but that with the smallest go whole. Texts longer than a shard are sorted in stretches. An empty table gives
    an empty result. Other columns are not read, whatever their names.
    """
    if length < 2 * GRAM:
        raise ValueError(f"the length must be at least {2 * GRAM}")
    shards = shards_of(docs, length, shard_bytes)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, of string, raw binary, gone binary"
    size = shards.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-int(size) // (per_range * 16)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                hashes, many = _shard(row)[0].grams(length)
                # In a range 32 bits tell anchors apart well enough: a collision makes one look shared, which costs work only.
                key = part_of(hashes, ranges) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
                order = np.argsort(key)
                key, many = key[order], many[order]
                heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
                key, many = key[heads], (np.logical_or.reduceat(many, heads) if len(heads) else many).tobytes()
                cuts = np.searchsorted(key >> np.uint64(32), np.arange(ranges + 1, dtype="u8")).tolist()
                low = key.astype("u4").tobytes()
                out += [(k, row["shard"], low[4 * a : 4 * b], many[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield _rows(["range", "shard", "hashes", "many"], out)

    def share(group: pd.DataFrame) -> pd.DataFrame:
        """Anchors that several texts have, for each shard: those it shares with others, and those with itself only."""
        span = int(group["range"].iloc[0])
        hashes, many = np.frombuffer(b"".join(group["hashes"]), "u4"), np.frombuffer(b"".join(group["many"]), bool)
        ends = np.cumsum([0, *map(len, group["many"])])
        # A shard has each of its anchors once.
        order = np.argsort(hashes)
        same = np.zeros(len(hashes) + 1, bool)
        same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
        cross = np.zeros(len(hashes), bool)
        cross[order] = same[1:] | same[:-1]
        told = []
        for which in (cross, many & ~cross):
            data, at = hashes[which].tobytes(), (4 * np.concatenate(([0], np.cumsum(which)))[ends]).tolist()
            told.append([data[a:b] for a, b in zip(at, at[1:])])
        return _rows(["shard", "range", "cross", "inner"], [(own, span, x, y) for own, x, y in zip(group["shard"], *told) if x or y])

    sent = shards.mapInPandas(send, "range bigint, shard string, hashes binary, many binary")
    shared = written(sent.groupBy("range").applyInPandas(share, "shard string, range bigint, cross binary, inner binary"), "anchors")

    def settle(held: Shard, ids: list[list], covered: np.ndarray, only=None) -> list[tuple]:
        """Result rows of the texts, given which positions begin a string that a smaller id has."""
        marks = np.zeros(len(held.data) + 1, "int32")
        at = np.flatnonzero(covered)
        marks[at] += 1
        marks[at + length] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        raw, out = np.frombuffer(held.data, "u1"), []
        for d in range(len(ids)) if only is None else only:
            a, n, first = held.starts[d], int(held.sizes[d]), held.ids[d]
            text, lost = raw[a : a + n], gone[a : a + n]
            # A copy finds all its strings in the first of its kind.
            every = np.full(n, n >= length)
            told: dict[bool, tuple] = {}
            for x, of in ids[d]:
                own = x == first
                if own not in told:
                    told[own] = _outcome(text, lost if own else lost | every)
                key = None if of and of.endswith("-") else x
                if of in (None, "-"):
                    out.append((key, *told[own][:4], told[own][4] if keep_text else None, None, None, None))
                else:
                    bits = np.packbits(lost if own else lost | every).tobytes()
                    out.append((key, n, None, None, None, None, of, _packed(text.tobytes()), zlib.compress(bits, 1)))
        return out

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "of", "raw", "gone"]
    pending = ["shard", "data", "sizes", "ids", "rows", "covered", "starts", "runs", "stretches"]
    sending = ["part", "first", "text", "counts", "least"]

    def sort(held: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        """Runs of one shard. Texts that no other shard touches are done; the others wait for the merge."""
        release(collect=False)  # what the group before has left
        row = held.to_dict("records")[0]
        shard, ids = _shard(row)
        spans = marks["range"].to_numpy("u8") << np.uint64(32)
        cross, inner = (
            np.repeat(spans, np.array([len(x) // 4 for x in marks[c]], "int64")) | np.frombuffer(b"".join(marks[c]), "u4") for c in ("cross", "inner")
        )
        outside, starts = shard.around(cross, inner, length, ranges)
        at, run = shard.runs(starts, length)
        owner = shard.ids[shard.of[at]]
        # Runs are numbered in this order.
        least = np.minimum.reduceat(owner, np.flatnonzero(np.diff(run, prepend=-1))) if len(run) else owner
        covered = np.zeros(len(shard.data), bool)
        covered[at[least[run] < owner]] = True
        waits = np.zeros(len(ids), bool)
        waits[shard.of[outside]] = True
        touched = np.flatnonzero(waits)
        out = [(*[None] * len(pending), *r) for r in settle(shard, ids, covered, np.flatnonzero(~waits))]
        if len(touched):
            # Only what waits is kept, laid end to end anew.
            shift = np.zeros(len(ids), "int64")
            shift[touched] = np.cumsum(shard.sizes[touched]) - shard.sizes[touched] - shard.starts[touched]
            kind = np.full(len(shard.data), -1, "int32")
            kind[at] = np.where(outside[at], run, -1)
            here = np.flatnonzero(kind >= 0)
            kind = kind[here]
            # Each run once, at its first place, in the order in which it is sent: by range of its least gram, then by place.
            first = np.full(len(least), -1, "int64")
            first[kind[::-1]] = np.arange(len(kind))[::-1]
            chosen = np.zeros(len(kind), bool)
            chosen[first[first >= 0]] = True
            first = np.flatnonzero(chosen)
            low = shard.least_grams(here[first], length)
            part = part_of(low, ranges)
            sent = np.argsort(part << np.uint64(32) | np.arange(len(first), dtype="u8"))
            kinds = kind[first][sent]
            number = np.empty(len(least), "int64")
            number[kinds] = np.arange(len(kinds))
            place, low, part, own = here[first][sent], low[sent], part[sent], least[kinds]
            fresh = (np.diff(place) != 1) | (low[1:] != low[:-1]) | (own[1:] != own[:-1]) | (part[1:] != part[:-1])
            heads = np.flatnonzero(np.concatenate(([True], fresh)))
            counts = np.diff(np.append(heads, len(place)))
            cuts = np.searchsorted(part[heads], np.arange(ranges + 1))
            raw, sizes = np.frombuffer(shard.data, "u1"), counts + length - 1
            ends = np.concatenate(([0], np.cumsum(sizes)))
            stretches = []
            # The bytes of some ranges at a time.
            for low_k, high_k in slices(np.diff(ends[cuts]).tolist(), SHARD_BYTES):
                x, y = cuts[low_k], cuts[high_k]
                here_ends = ends[x : y + 1] - ends[x]
                text = raw[np.repeat(place[heads[x:y]] - here_ends[:-1], sizes[x:y]) + np.arange(here_ends[-1])].tobytes()
                told, ids_told = counts[x:y].astype("int32").tobytes(), own[heads[x:y]].tobytes()
                for k in range(low_k, high_k):
                    a, b = int(cuts[k] - x), int(cuts[k + 1] - x)
                    if b > a:
                        piece = _packed(text[here_ends[a] : here_ends[b]])
                        stretches.append((k, int(heads[x + a]), piece, told[4 * a : 4 * b], ids_told[8 * a : 8 * b]))
            of = shard.of[here]
            keep = np.concatenate([np.arange(shard.starts[d], shard.starts[d] + shard.sizes[d]) for d in touched])
            state = (
                row["shard"], _packed(b"".join(shard.texts[d] for d in touched)), [int(shard.sizes[d]) for d in touched],
                [[x for x, _ in ids[d]] for d in touched], [[of for _, of in ids[d]] for d in touched], zlib.compress(np.packbits(covered[keep]).tobytes(), 1), _steps(here + shift[of]),
                _steps(number[kind]), [dict(zip(sending, x)) for x in stretches],
            )
            out.append((*state, *[None] * len(names)))
        return _rows(pending + names, out)

    stretch = "part: bigint, first: int, text: binary, counts: binary, least: binary"
    lists = "shard string, data binary, sizes array<int>, ids array<array<bigint>>, rows array<array<string>>, covered binary, starts binary, runs binary"
    sorted_ = written(
        shards.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(sort, f"{lists}, stretches array<struct<{stretch}>>, {schema}"),
        "suffixes",
    )
    discard(shards)
    done, waiting = sorted_.where("shard IS NULL").select(*names), sorted_.where("shard IS NOT NULL")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        """Whether another shard's id of a string is smaller: each list is looked up in the merged one by binary search."""
        release(collect=False)
        words = words_seen(b"".join(map(_unpacked, group["text"])))
        counts = np.frombuffer(b"".join(group["counts"]), "int32").astype("int64")
        begin = np.cumsum(counts + length - 1) - (counts + length - 1)
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        least = np.repeat(np.frombuffer(b"".join(group["least"]), "i8"), counts)
        # A list has at least one stretch.
        heads = np.cumsum([0, *(len(c) // 4 for c in group["counts"])])[:-1]
        sizes = np.add.reduceat(counts, heads)
        of, smaller = np.repeat(np.arange(len(sizes), dtype="int32"), sizes), np.zeros(len(at), bool)
        # Some strings at a time, the same of all shards: those whose first bytes fall into one of so many classes.
        classes = max(1, -(-len(at) // AT_ONCE))
        kinds = (_mix(words[at]) % np.uint64(classes)).astype("int32")
        for kind in range(classes):
            here = np.flatnonzero(kinds == kind)
            strings = rows_of_words(words, at[here], length)
            key = digest(strings)
            # By list, then by key; equal keys of a list, if there are any, in any order.
            order = np.argsort(key)
            order = order[np.argsort(of[here[order]].astype(f"u{2 if len(sizes) < 1 << 16 else 4}"), kind="stable")]
            here, key, strings = here[order], key[order], strings[order]
            found = _smaller_by_key(key, strings, least[here])
            if found is None:
                cuts = np.flatnonzero(np.diff(of[here])) + 1
                found = np.concatenate(smaller_elsewhere(list(zip(*(np.split(x, cuts) for x in (key, strings, least[here])))), False))
            smaller[here] = found
        ends = np.cumsum(sizes)
        out = [(own, first, int(n), np.packbits(smaller[end - n : end]).tobytes()) for own, first, n, end in zip(group["shard"], group["first"], sizes, ends)]
        return _rows(["shard", "first", "n", "smaller"], out)

    dealt = waiting.select("shard", F.explode("stretches").alias("x")).select("shard", "x.*")
    best = dealt.groupBy("part").applyInPandas(merge, "shard string, first int, n int, smaller binary")

    def finish(held: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        release(collect=False)
        row = held.to_dict("records")[0]
        shard, ids = _shard(row)
        at, run = _from_steps(row["starts"]), _from_steps(row["runs"])
        smaller = np.zeros(int(run.max(initial=-1)) + 1, bool)
        for first, n, bits in zip(answers["first"], answers["n"], answers["smaller"]):
            smaller[first : first + n] = np.unpackbits(np.frombuffer(bits, "u1"), count=n)
        covered = np.unpackbits(np.frombuffer(zlib.decompress(row["covered"]), "u1"), count=len(shard.data)).astype(bool)
        covered[at[smaller[run]]] = True
        return _rows(names, settle(shard, ids, covered))

    waiting = waiting.select("shard", "data", "sizes", "ids", "rows", "covered", "starts", "runs")
    rest = waiting.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(finish, schema)

    def assemble(group: pd.DataFrame) -> pd.DataFrame:
        """One long text from its stretches: one cell of the input. Where they overlap a byte goes if it goes in one of them."""
        rows = sorted(zip(group["of"].str.split(" ").str[1].astype(int), group["n_bytes"], group["raw"], group["gone"], strict=True))
        raw = np.zeros(rows[-1][0] * shard_bytes + int(rows[-1][1]), "u1")
        gone = np.zeros(len(raw), bool)
        for k, n, text, bits in rows:
            here = slice(k * shard_bytes, k * shard_bytes + int(n))
            raw[here] = np.frombuffer(_unpacked(text), "u1")
            gone[here] |= np.unpackbits(np.frombuffer(zlib.decompress(bits), "u1"), count=int(n)).astype(bool)
        told = _outcome(raw, gone)
        key = group["doc_id"].iloc[0]
        return _rows(names[:6], [(None if pd.isna(key) else int(key), *told[:4], told[4] if keep_text else None)])

    every = written(done.unionByName(rest), "told")
    short = every.where("of IS NULL").select(names[:6])
    long = every.where("of IS NOT NULL").groupBy(F.substring_index("of", " ", 1).alias("row")).applyInPandas(assemble, schema.split(", of")[0])
    out = short.unionByName(long)
    return out if keep_text else out.drop("kept")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All `documents` without passages of 50 bytes that a document with a smaller id holds."""
    return remove_repeats(table(spark, sf_dir, "documents"))
