"""Byte-level BPE by overlapping chunks (operator 8).

A text is cut into chunks that overlap. Chunks are pre-tokenised on their own, wherever they start; from a position
at which the parse of the chunk before and its own both begin a token they agree for good, because the pattern looks
only ahead. The text is cut there, if the character before is not white space (the pattern's one look-ahead concerns
white space), and the pieces are encoded independently. A text whose chunks do not come together in some overlap, for
instance a run of letters longer than the overlap, is encoded as one piece. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import small_batches, table, texts_of, tidy, written

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32_768, 1_024

_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of ranks, without special tokens. Kept by each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _parts(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text of n characters. Only the last may be shorter than chunk + overlap."""
    return [(s, min(n, s + chunk + overlap)) for s in range(0, max(1, n - overlap), chunk)]


def cut_points(text: str, offset: int, low: int, high: int, pattern: str) -> list[int]:
    """Positions in [low, high) of the whole text where a token of this chunk starts after a character that is no space."""
    found = []
    for m in _parts(pattern).finditer(text):
        p = m.start()
        if p + offset >= high:
            break
        if p and p + offset >= low and not text[p - 1].isspace():
            found.append(p + offset)
    return found


def digest(ids: np.ndarray, enc: tiktoken.Encoding) -> tuple[int, str, str]:
    ids = ids.tolist()
    joined = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


def encode_texts(
    df: DataFrame, id_column: str = "doc_id", ranks: str | None = None, pattern: str | None = None,
    chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False,
) -> DataFrame:
    """Token ids of `text`: count, SHA-256 of the ids joined by spaces and of the decoded bytes, by row.

    Null text is empty (no tokens). Rows with equal ids or texts are treated each on its own; other columns are not
    read. `keep_ids` adds `ids array<int>`. `ranks` is a file of ranks every worker can open.
    """
    if overlap < 2 or chunk <= overlap:
        raise ValueError("the chunk must be longer than the overlap, and that at least 2")
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_column].dataType.simpleString()
    ids_column = ", ids array<int>" if keep_ids else ""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Encodes texts of one chunk at once; cuts the longer ones."""
        enc = encoding(path, pattern)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                if len(text) <= chunk + overlap:
                    ids = np.array(enc.encode_ordinary(text), "int32")
                    rows.append((key, *digest(ids, enc), ids if keep_ids else None, None, None, None, None))
                    continue
                own = uuid.uuid4().hex
                for k, (a, b) in enumerate(chunk_spans(len(text), chunk, overlap)):
                    rows.append((key, None, None, None, None, own, k, a, text[a:b]))
            names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "row", "k", "start", "text"]
            yield from _record_batches(rows, names, batch.schema.field(0).type)

    def _record_batches(rows, names, key_type):
        types = [key_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    made = written(
        df.select(F.col(id_column).alias("key"), "text").mapInArrow(
            tidy(first), f"key {id_type}, {_DIGEST}, ids array<int>, row string, k int, start long, text string"
        ),
        "bpe",
    )
    result = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    short = made.where("row IS NULL").select(*result)
    chunks = made.where("row IS NOT NULL").select("key", "row", "k", "start", "text").repartition("row", "k")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Possible cuts of each chunk: in the overlap with the chunk before, and in that with the next."""
        for batch in batches:
            heads, tails = [], []
            for text, a in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist()):
                both = cut_points(text, a, a, a + len(text), pattern)
                heads.append([p for p in both if p < a + overlap])
                tails.append([p for p in both if p >= a + chunk])
            arrays = [batch.column("row"), batch.column("k"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "k", "head", "tail"])

    w = Window.partitionBy("row").orderBy("k")
    found = chunks.mapInArrow(tidy(ends), "row string, k int, head array<bigint>, tail array<bigint>")
    cuts = found.select(
        "row", "k",
        F.when(F.col("k") > 0, F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))).alias("low"),
        F.lead("k").over(w).isNotNull().alias("more"),
    )
    cuts = cuts.withColumn("high", F.lead("low").over(w))
    whole = F.max((F.col("k") > 0) & F.col("low").isNull()).over(Window.partitionBy("row"))
    pieces = chunks.join(cuts.withColumn("whole", whole), ["row", "k"]).select(
        "key", "row", "k",
        F.when(F.col("whole"), F.lit(True)).otherwise(F.lit(False)).alias("whole"),
        F.when(
            F.col("whole"), F.when(F.col("more"), F.expr(f"substring(text, 1, {chunk})")).otherwise(F.col("text"))
        ).otherwise(
            F.expr("substring(text, coalesce(low, start) - start + 1, coalesce(high - coalesce(low, start), length(text)))")
        ).alias("text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            whole = batch.column("whole").to_pylist()
            ids = [b"" if all_ else np.array(enc.encode_ordinary(t), "int32").tobytes() for t, all_ in zip(texts_of(batch), whole)]
            text = [t if all_ else None for t, all_ in zip(texts_of(batch), whole)]
            arrays = [batch.column("key"), batch.column("row"), batch.column("k"), pa.array(ids, pa.binary()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "row", "k", "piece", "text"])

    encoded = pieces.mapInArrow(tidy(encode), f"key {id_type}, row string, k int, piece binary, text string")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        """One text: its ids in order of the pieces. A group is one cell of the input, in int32 instead of characters."""
        enc, group = encoding(path, pattern), group.sort_values("k")
        if group["text"].notna().any():
            ids = np.array(enc.encode_ordinary("".join(group["text"])), "int32")
        else:
            ids = np.frombuffer(b"".join(group["piece"]), "int32")
        return pd.DataFrame([(group["key"].iloc[0], *digest(ids, enc), ids if keep_ids else None)], columns=result)

    long = encoded.groupBy("row").applyInPandas(joined, f"key {id_type}, {_DIGEST}, ids array<int>")
    out = short.unionByName(long)
    return out.select(F.col("key").alias(id_column), "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else []))


def decode_ids(df: DataFrame, column: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`df` with `decoded binary`, the bytes of the ids in order; null ids give no bytes."""
    path, pattern = ranks or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        enc = encoding(path, pattern)
        return ids.map(lambda x: b"" if x is None else enc.decode_bytes(list(x)))

    return df.withColumn("decoded", decoded(column))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of `documents`: number of ids, digests of the ids and of the decoded bytes."""
    return encode_texts(table(spark, sf_dir, "documents"))
