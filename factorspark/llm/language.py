"""Language identification with string kernels (operator 10).

The kernel of two texts is the number of character n-grams of 1 to `ORDER` characters that both hold (a blended spectrum of
presences, n-grams as hashed buckets), divided by the root of the texts' own numbers. A Nyström map over landmark texts
turns it into features, a kernel ridge regression for each language against the rest is solved on them, and its weights are
folded back onto the n-grams. So a batch of texts is scored by one product of its presence matrix with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorspark.llm.common import held_out, slices, small_batches, table, texts_of

ORDER, BUCKET_BITS = 4, 15
BUCKETS = ORDER << BUCKET_BITS
#: Training rows of a language and in all, by the hash of their ids; landmarks among them; ridge.
PER_LANGUAGE, TRAINING, LANDMARKS, RIDGE = 800, 8_000, 256, 1e-2
#: Landmarks of each language at least, as far as it has rows, even if that makes more than `LANDMARKS`.
LEAST_LANDMARKS = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages


def presence(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: number of the first, and the presence matrix as (sorted buckets, bounds of each text in them).

    Case is folded; a text without characters has no bucket.
    """
    for a, b in slices([len(t) for t in texts], 1 << 20):
        for lo in range(a, b, 64):
            yield lo, *_presence([t.lower() for t in texts[lo : min(b, lo + 64)]])


def _presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype("u8")
    of = np.repeat(np.arange(len(texts), dtype="int64"), [len(t) for t in texts])
    flags = np.zeros(len(texts) * BUCKETS, bool)
    gram = np.zeros(len(codes), "u8")
    shift = np.uint64(64 - BUCKET_BITS)
    for n in range(1, min(ORDER, len(codes)) + 1):
        size = len(codes) - n + 1
        gram = gram[:size] + (codes[n - 1 :] + np.uint64(1)) * _MIX[n - 1]
        same = of[:size] == of[n - 1 :]
        mixed = gram ^ (gram >> np.uint64(29))
        bucket = ((mixed * _MIX[0]) >> shift).astype("int64")
        flags[(of[:size] * BUCKETS + (n - 1 << BUCKET_BITS) + bucket)[same]] = True
    found = np.flatnonzero(flags)
    return found % BUCKETS, np.searchsorted(found, np.arange(len(texts) + 1) * BUCKETS)


def landmarks_first(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS) -> tuple[list[tuple[str, np.ndarray]], int]:
    """(rows with the landmarks first, number of these): languages take turns, each with its rows in the order given."""
    turns: dict[str, int] = {}
    keys = []
    for i, (lang, _) in enumerate(rows):
        turns[lang] = turns.get(lang, -1) + 1
        keys.append((turns[lang], i))
    least = sum(turn < LEAST_LANDMARKS for turn, _ in keys)
    return [rows[i] for _, i in sorted(keys)], min(len(rows), max(landmarks, least))


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Ridge regression of each language against the rest on the Nyström features of rows (language, buckets)."""
    languages = tuple(sorted({lang for lang, _ in rows}))
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return Model(languages, np.zeros((BUCKETS, len(languages))))
    rows, n_marks = landmarks_first(rows, landmarks)
    marks = rows[:n_marks]
    used = np.unique(np.concatenate([b for _, b in marks]))
    place = np.full(BUCKETS, -1, "int64")
    place[used] = np.arange(len(used))

    def dense(part: list[tuple[str, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(part), len(used)), "float32")
        for row, (_, buckets) in zip(out, part):
            at = place[buckets]
            row[at[at >= 0]] = len(buckets) ** -0.5
        return out

    # Many languages have many landmarks; only some are dense at a time.
    blocks = [slice(i, min(i + 256, n_marks)) for i in range(0, n_marks, 256)]
    kernel = np.zeros((len(rows), n_marks))
    for block in blocks:
        of_marks = dense(marks[block])
        for i in range(0, len(rows), 64):
            kernel[i : i + 64, block] = dense(rows[i : i + 64]) @ of_marks.T
    values, vectors = np.linalg.eigh(kernel[: len(marks)])
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] * values[kept] ** -0.5
    features = kernel @ root
    targets = np.array([[float(lang == x) for x in languages] for lang, _ in rows])
    gram = features.T @ features + ridge * len(rows) / 100 * np.eye(features.shape[1])
    weights = np.zeros((BUCKETS, len(languages)))
    parts = root @ np.linalg.solve(gram, features.T @ targets)
    weights[used] = sum(dense(marks[block]).T @ parts[block] for block in blocks)
    return Model(languages, weights)


def score(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its regression value, cut to 0..1. Without a letter: `und` and 0."""
    names, scores = [], np.zeros(len(texts))
    for start, buckets, bounds in presence(texts):
        sums = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(model.weights[buckets], axis=0)))
        sizes = np.diff(bounds)
        out = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(sizes, 1))[:, None]
        for i, values in enumerate(out, start):
            if not model.languages or not any(map(str.isalpha, texts[i])):
                names.append("und")
                continue
            best = int(values.argmax())
            names.append(model.languages[best])
            scores[i] = min(1.0, max(0.0, float(values[best])))
    return names, scores


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, training: int = TRAINING, **options) -> Model:
    """A model from at most `per_language` documents of a language and `training` in all that are not held out.

    Which ones is decided by the hash of the id, the same under any partitioning; their texts are read whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    open_rows = docs.select("doc_id", "lang", "text").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = open_rows.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= per_language)
    chosen = chosen.orderBy("n", "lang").limit(training).select(F.col("doc_id").alias("chosen")).distinct()

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, buckets, bounds in presence(texts_of(batch)):
                found += [buckets[x:y].astype("int32").tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.binary())], names=["lang", "buckets"])

    rows = open_rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("lang", "text")
    found = rows.mapInArrow(buckets_of, "lang string, buckets binary").collect()
    # Landmarks are the first rows of each language, so they are put in an order that knows no partitions.
    mixed = sorted(((r.lang, bytes(r.buckets)) for r in found), key=lambda r: (xxhash.xxh64_intdigest(r[1]), r))
    return fit([(lang, np.frombuffer(b, "int32")) for lang, b in mixed], **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the text alone. Null text is `und`; rows are not merged."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score(model, texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """The language of all `documents`, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
