"""From raw documents to tokens: quality, near-duplicates, benchmark passages, personal data, byte-level BPE.

Each stage works on what the one before kept and is written as Parquet; all but the last return the columns of `documents`. Stages take
empty tables, repeated rows, null ids and texts, and further columns of any name, which all but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.llm import bpe, decontaminate, jaccard, pii, quality
from factorspark.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of this stage's documents.

    Null text is scored as the empty one, long texts by all their passages; equal texts have equal scores, so copies stay or go together.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of documents with 0.8 or more of their 5-word shingles in common.

    Null texts and those without words are one component; of repeated rows one stays; long texts are compared whole.
    """
    return jaccard.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Null text holds none, long texts are searched whole, repeated rows share their fate."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and what gives it away replaced; n_chars follows. Null text stays null; every row stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    # Other columns travel as one, so that no name of theirs meets one of the operator.
    clean = pii.sanitise(pii.find_spans(docs.select("doc_id", "text", rest.alias("others"))))
    n_chars = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).alias("n_chars")
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return clean.select(*[own[c] if c in own else F.col("others").getField(c).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests. Null text has none; long texts are encoded in pieces; every row stays."""
    return bpe.encode_texts(docs, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("tokens", encode),
]

#: Trained models and tokenisers are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
