"""Quality scores by attention-based multiple-instance learning (operator 5).

A document is a bag of passages, cut from its whole text. Every passage is described by the frequencies of its character
classes and of pairs of them, and by how repetitive the document is; an encoder embeds it, gated attention weighs it against
the other passages, and the weighted mean is scored. Labels belong to documents only; the attention is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorspark.llm.common import held_out, release, slices, small_batches, table, texts_of, tidy

PASSAGE = 400
#: Labelled documents to learn from, by the hash of their ids, and passages of them all; documented bounds.
TRAINING, PASSAGES = 4_000, 40_000
HIDDEN, GATE, EPOCHS, RATE = 24, 12, 160, 0.02

# Character classes: own ones for some signs, the others by kind.
_SIGNS = " \n.,!?#$%&*|-:;\"'/"
_KINDS = 5  # lower, upper, digit, other sign, letters beyond ASCII
CLASSES = len(_SIGNS) + _KINDS
_CLASS = np.full(65_536, len(_SIGNS) + 4, "u1")
_CLASS[:128] = len(_SIGNS) + 3
for _i in range(128):
    if chr(_i) in _SIGNS:
        _CLASS[_i] = _SIGNS.index(chr(_i))
    elif chr(_i).isalnum():
        _CLASS[_i] = len(_SIGNS) + (0 if chr(_i).islower() else 1 if chr(_i).isupper() else 2)
WIDTH = CLASSES + CLASSES * CLASSES + 3


def passages(texts: list[str], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text (at least one)."""
    lengths = np.array([len(t) for t in texts], "int64")
    counts = np.maximum(1, -(-lengths // size))
    first = np.cumsum(counts) - counts
    codes = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), 65_535)
    kind = _CLASS[codes].astype("int64")
    offset = np.cumsum(lengths) - lengths
    at = np.repeat(first, lengths) + (np.arange(len(codes)) - np.repeat(offset, lengths)) // size
    n = int(counts.sum())
    single = np.bincount(at * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    joined = at[1:] == at[:-1]
    pair = (at[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
    double = np.bincount(pair[joined], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    total = np.maximum(1, single.sum(axis=1, keepdims=True))
    whole = np.array([_repetition(t) for t in texts], "float32").reshape(-1, 3)
    out = np.concatenate((np.sqrt(single / total), np.sqrt(double / total), np.repeat(whole, counts, axis=0)), axis=1)
    return out.astype("float32"), counts


def _repetition(text: str) -> tuple[float, float, float]:
    """Share of different words, share of different lines, logarithm of the number of words."""
    words, lines = text.split(), text.split("\n")
    return len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), np.log1p(len(words)) / 10


@dataclass(frozen=True)
class Model:
    """Weights: encoder (w, b), attention (v, u, a), score (c, d); with the mean and spread of the features."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p: dict, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict:
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * s) @ p["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    weight = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "p": _sigmoid(z @ p["c"] + p["d"])}


def _moments(x: np.ndarray, rows: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns, some rows at a time."""
    blocks = [x[a : a + rows] for a in range(0, len(x), rows)]
    mean = sum(b.sum(axis=0, dtype="float64") for b in blocks) / len(x)
    return mean, np.sqrt(sum(((b - mean) ** 2).sum(axis=0) for b in blocks) / len(x))


def fit(
    x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7, in_place: bool = False
) -> Model:
    """Log-loss over documents by Adam on the whole sample; weights start from a fixed seed. `in_place` may overwrite `x`."""
    rng = np.random.default_rng(seed)
    mean, spread = (m.astype(x.dtype) for m in _moments(x))
    spread += np.asarray(1e-2, x.dtype)
    x = x if in_place else x.copy()
    x -= mean
    x /= spread
    f = "float32"
    p = {
        "w": (rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1])).astype(f), "b": np.zeros(HIDDEN, f),
        "v": (rng.standard_normal((HIDDEN, GATE)) / 5).astype(f), "u": (rng.standard_normal((HIDDEN, GATE)) / 5).astype(f),
        "a": (rng.standard_normal(GATE) / 3).astype(f), "c": (rng.standard_normal(HIDDEN) / 5).astype(f), "d": np.zeros((), f),
    }
    starts = np.cumsum(counts) - counts
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        o = _forward(p, x, starts, counts)
        out = ((o["p"] - y) / len(y)).astype(f)
        z_grad = np.repeat(out[:, None] * p["c"], counts, axis=0)
        lift = (z_grad * o["h"]).sum(axis=1)
        middle = np.repeat(np.add.reduceat(o["weight"] * lift, starts), counts)
        e_grad = (o["weight"] * (lift - middle))[:, None] * p["a"]
        t_grad = e_grad * o["s"] * (1 - o["t"] ** 2)
        s_grad = e_grad * o["t"] * o["s"] * (1 - o["s"])
        h_grad = o["weight"][:, None] * z_grad + t_grad @ p["v"].T + s_grad @ p["u"].T
        h_grad *= 1 - o["h"] ** 2
        grad = {
            "w": x.T @ h_grad + 1e-4 * p["w"], "b": h_grad.sum(axis=0), "v": o["h"].T @ t_grad, "u": o["h"].T @ s_grad,
            "a": (o["t"] * o["s"] * (o["weight"] * (lift - middle))[:, None]).sum(axis=0), "c": o["z"].T @ out, "d": out.sum(),
        }
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(f)
    return Model(p, mean, spread)


def score(model: Model | None, texts: list[str]) -> np.ndarray:
    """0 to 1 for each text; 0.5 for all without a model."""
    out = np.full(len(texts), 0.5)
    if model is None:
        return out
    for a, b in slices([len(t) for t in texts], 1 << 19):
        x, counts = passages(texts[a:b])
        out[a:b] = _forward(model.weights, (x - model.mean) / model.spread, np.cumsum(counts) - counts, counts)["p"]
    return out


def train(docs: DataFrame, labels: DataFrame, training: int = TRAINING, most: int = PASSAGES, **options) -> Model | None:
    """A model from at most `training` labelled documents that are not held out, and `most` passages; None if there are none.

    Which ones is decided by the hash of the id; one that would exceed the passages is passed over. Their texts are read whole; what
    is gathered are features of passages. A document with several labels counts with their rounded mean, repeated rows count once;
    null labels and null texts teach nothing.
    """
    small_batches(docs.sparkSession, 200)
    known = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("labelled")).agg(F.round(F.avg("quality")).cast("float").alias("label"))
    # Ids of the sample are chosen before any text is read; a label without document only makes the sample smaller.
    known = known.orderBy(F.xxhash64("labelled"), "labelled").limit(training)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), F.col("doc_id") == F.col("labelled"))
    rows = rows.select("labelled", "label", "text", F.xxhash64("text").alias("version"))
    size = F.greatest(F.lit(1), F.ceil(F.length("text") / PASSAGE)).cast("bigint")
    sizes = rows.groupBy("labelled", "version").agg(F.max(size).alias("n")).orderBy(F.xxhash64("labelled"), "labelled", "version")
    chosen, total = [], 0
    for row in sizes.limit(training).collect():
        if total + row["n"] <= most:
            chosen.append((row["labelled"], row["version"]))
            total += row["n"]
    if not chosen:
        return None
    kind = labels.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"labelled {kind}, version bigint"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [passages([t])[0].tobytes() for t in texts_of(batch)]
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["labelled", "version", "label", "x"])

    rows = rows.join(wanted, ["labelled", "version"]).groupBy("labelled", "version", "label").agg(F.first("text").alias("text"))
    found = rows.mapInArrow(tidy(features), f"labelled {kind}, version bigint, label float, x binary").toLocalIterator()
    bags = sorted(((r.labelled, r.version), r.label, bytes(r.x)) for r in found)
    counts = np.array([len(x) // (4 * WIDTH) for *_, x in bags])
    y = np.array([label for _, label, _ in bags], "float32")
    x, at = np.empty((counts.sum(), WIDTH), "float32"), 0
    bags.reverse()
    for n in counts:
        x[at : at + n] = np.frombuffer(bags.pop()[2], "float32").reshape(-1, WIDTH)
        at += n
    model = fit(x, counts, y, in_place=True, **options)
    # The driver goes on to other steps.
    del x, bags
    release()
    return model


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone. Null text is scored as the empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(model, texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype("int32"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, with all columns, that score 0.5 or more."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(model, texts_of(batch)) >= 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from `labels` of those not held out."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
