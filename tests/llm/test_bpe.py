from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest

from made_documents import documents  # noqa: F401
from factorspark.llm import bpe


def enc():
    return bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


def want(text):
    ids = enc().encode_ordinary(text or "")
    joined = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def odd_text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["word", "It's", " ", "  ", "\n", " \n\t", "123", "é", "日本語", "!!", "'ll", "\u00a0", "😀", "<|endoftext|>", "a" * 30]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(40, 12), (64, 33), (bpe.CHUNK, bpe.OVERLAP)])
def test_chunks_equal_the_library(documents, chunk, overlap):
    texts = [odd_text(i, 10 + 17 * i) for i in range(25)]
    texts += ["a" * 500, " " * 500, " \n" * 300 + "x", "!" * 333, None, "", "same", "same", "a b " * 20_000]
    df = documents(*texts).unionByName(documents((0, texts[3]), (None, "x y")))
    got = bpe.encode_texts(df, chunk=chunk, overlap=overlap).collect()
    expected = [(i, *want(t)) for i, t in enumerate(texts)] + [(0, *want(texts[3])), (None, *want("x y"))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_round_trip(documents):
    texts = [odd_text(99, 400), "", None]
    made = bpe.encode_texts(documents(*texts), chunk=50, overlap=20, keep_ids=True)
    got = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode_ids(made).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table_and_names(documents):
    df = documents((0, "a b")).withColumnsRenamed({"lang": "ids", "source": "key"})
    assert bpe.encode_texts(df).count() == 1 and bpe.encode_texts(df.where("false")).count() == 0


def test_bad_sizes(documents):
    with pytest.raises(ValueError):
        bpe.encode_texts(documents("a"), chunk=5, overlap=5)


def test_query_against_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in bpe.op8_bpe(spark, sf_dir).collect()}
    assert got == {i: want(t) for i, t in texts.items()}
