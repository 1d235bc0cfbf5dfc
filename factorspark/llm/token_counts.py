"""Token counts of a byte-level BPE by heap and linked list (operator 12).

A text is cut at the special strings of the tokenizer file, each of which is one token, and the rest by the pattern of
byte-level pre-tokenizers. The bytes of a piece are a linked list of symbols; its adjacent pairs lie in a heap by rank, then by
place. The lowest is popped and merged and its neighbours are pushed anew, until no pair has a rank. A piece has as many tokens
as it had bytes, less the merges. No ids are made. Each worker remembers the counts of the pieces it met last.

Characters that the library classes otherwise than `regex` does (the two know different versions of Unicode) are found by asking
the library's own pre-tokenizer, once for each character a worker meets.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorspark.llm.common import small_batches, table, texts_of

MODEL, LIMIT = "byte_bpe_50k.json", 512
#: Pieces that a worker remembers twice over, the longest of them, and from where symbols are kept in packed arrays.
REMEMBERED, SHORT, LONG = 300_000, 64, 4_096
#: Texts up to this many characters are cut at once, longer ones piece by piece.
AT_ONCE = 1 << 18


def byte_names() -> list[str]:
    """How byte-level vocabularies write each byte: printable ones of Latin-1 as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: 256 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


class Pieces(dict):
    """Number of tokens of each piece, counted when first asked for. Those asked for since the one before last were full are kept."""

    def __init__(self, symbols: list[int], merges: list[dict[int, tuple[int, int]]]):
        self.symbols, self.merges = symbols, merges
        self.earlier: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.earlier.get(piece) or self.count(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.earlier = dict(self)
                self.clear()
            self[piece] = n
        return n

    def count(self, data: bytes) -> int:
        n, merges = len(data), self.merges
        numbers = list if n < LONG else lambda x: array("q", x)
        own = numbers(map(self.symbols.__getitem__, data))
        # An entry is rank * n + place. It is stale if the pair at that place is no longer the one of this rank.
        heap = []
        for i in range(n - 1):
            if m := merges[own[i]].get(own[i + 1]):
                heap.append(m[0] * n + i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = numbers(range(1, n + 1)), numbers(range(-1, n - 1))
        left = n
        while heap:
            entry = heapq.heappop(heap)
            i = entry % n
            j = after[i]
            if own[i] < 0 or j >= n:
                continue
            found = merges[own[i]].get(own[j])
            if not found or found[0] != entry // n:
                continue
            own[i] = joined = found[1]
            own[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges[joined].get(own[k]):
                    heapq.heappush(heap, m[0] * n + i)
            h = before[i]
            if h >= 0 and (m := merges[own[h]].get(joined)):
                heapq.heappush(heap, m[0] * n + h)
        return left


class Kinds(dict):
    """For `str.translate`: characters that the library takes for another kind, as one that both take for that kind."""

    def __init__(self, tokenizer: Tokenizer):
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.ours = [(regex.compile(p), stand_in) for p, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t"))]

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        own = next((s for p, s in self.ours if p.match(c)), "!")
        theirs = next((s for s in "a1!" if len(self.cut(s + c)) == 1), "\t")
        self[code] = code if own == theirs else ord(theirs)
        return self[code]


class TokenCounter:
    """Counts tokens as `tokenizers` does for a file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, cutter = made["model"], made.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        odd = any(model.get(x) for x in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if model["type"] != "BPE" or made.get("normalizer") or not plain or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t[x] for t in made["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens with rules of their own")
        vocab = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges: list[dict[int, tuple[int, int]]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            merges[vocab[a]][vocab[b]] = rank, vocab[a + b]
        self.pieces = Pieces([vocab[c] for c in byte_names()], merges)
        # Longest first, as the library takes the longest of those that begin at a place.
        strings = sorted((t["content"] for t in made["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.kinds = Kinds(Tokenizer.from_file(path))

    def _plain(self, text: str) -> int:
        as_ours = text if text.isascii() else text.translate(self.kinds)
        get = self.pieces.__getitem__
        if as_ours != text:
            return sum(get(text[m.start() : m.end()]) for m in self.pattern.finditer(as_ours))
        if len(text) <= AT_ONCE:
            return sum(map(get, self.pattern.findall(text)))
        return sum(map(get, map(itemgetter(0), self.pattern.finditer(text))))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """Read once by each worker."""
    return TokenCounter(path)


def count_tokens(df: DataFrame, id_column: str = "doc_id", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of the whole `text` of each row; `model` is a tokenizer file every worker can open.

    Null and empty texts have no bytes and no tokens. Every row is counted on its own: repeated rows and ids, and null ids, give as
    many result rows. Other columns are not read, whatever their names. A long text is counted piece by piece; memory grows
    with its longest piece only (a run of letters, of digits, of other signs or of white space).
    """
    path = model or public_tokenizers.path(MODEL)
    small_batches(df.sparkSession)
    id_type = df.schema[id_column].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            counts = pa.array([count(t) for t in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["id", "n_bytes", "n_tokens"])

    rows = df.select(
        F.col(id_column).alias("id"), F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)).alias("n_bytes"), "text"
    )
    counted = rows.mapInArrow(of, f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text of `documents`."""
    return count_tokens(table(spark, sf_dir, "documents"))
