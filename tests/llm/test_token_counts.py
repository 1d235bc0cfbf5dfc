from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from made_documents import documents  # noqa: F401
from tokenizers import Tokenizer

from factorspark.llm import token_counts

PATH = public_tokenizers.path(token_counts.MODEL)
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.TokenCounter(PATH)


def want(text: str | None) -> int:
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


ODD = [
    "", " ", "a", "  two  spaces \n\n and\tlines ", "don't we'll I'VE", "x<|endoftext|>y", "  <|endoftext|>  <|endoftext|>", "<|endoftext|",
    "aaaa" * 3_000, "0123456789" * 500, "!?" * 2_000, " " * 5_000 + "x", "été 你好 \U0001f600\U0001f468‍\U0001f469", "é\u0000\u0085 　z",
    "a՘b 1₏ ꟎꟏ x\U00010940y", "²½Ⅻ 12٣",
]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts_equal_the_library(text):
    assert COUNTER.count(text) == want(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab '<|endoftext|>tsrel\n 1é", max_size=60))
def test_any_text_equals_the_library(text):
    assert COUNTER.count(text) == want(text)


def test_every_plane_of_characters():
    step = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(step), 500):
        text = "".join(f"a{c}1{c} {c}" for c in step[at : at + 500])
        assert COUNTER.count(text) == want(text)


def test_a_long_text_and_forgetting(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "AT_ONCE", 100)
    text = " ".join(f"word{i * 7919 % 5_003}" for i in range(20_000))
    assert token_counts.TokenCounter(PATH).count(text) == want(text)


def test_rows(spark, documents):
    df = documents((1, "one two"), (1, "one two"), (1, None), (None, "x"), (5, ""), (6, "many " * 600))
    df = df.selectExpr("*", "1 AS n_tokens", "2 AS id", "3 AS n_bytes", "4 AS over_limit")
    got = sorted(map(str, token_counts.count_tokens(df).collect()))
    rows = [(r.doc_id, len((r.text or "").encode()), want(r.text), want(r.text) > 512) for r in df.collect()]
    assert got == sorted(f"Row(doc_id={i}, n_bytes={b}, n_tokens={n}, over_limit={o})" for i, b, n, o in rows)
    empty = token_counts.count_tokens(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (len(r.text.encode()), want(r.text), want(r.text) > 512) for r in rows}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
