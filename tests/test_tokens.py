"""Exact token counts against the tokenizer that the vocabulary comes from."""

from __future__ import annotations

import functools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import tokens
from tidemark.plans.queries import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@functools.cache
def tokenizer():
    import public_tokenizers

    made = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@functools.cache
def ranks():
    return tokens.read_ranks(vocabulary_path())


def count(text):
    return len(tokenizer().encode(text or "", add_special_tokens=False).ids)


@settings(deadline=None)  # the first example loads the tokenizer
@given(st.text(st.characters(categories=["L"]), min_size=1, max_size=40) | st.text("aeinrst", min_size=1, max_size=300))
def test_merging_a_piece(piece):
    assert tokens.merged_length(piece.encode(), ranks()) == count(piece)


def test_a_long_piece_is_merged_whole():
    piece = "abcdefghij" * 20_000
    assert tokens.merged_length(piece.encode(), ranks()) == count(piece)


ODD = ["", None, " ", "  ", "a  b", "a \n\n b", "\n\n", "x  y", "　　z", "it's 'tis we'll I'd 've", "12345 ½ ٣٤", "a\tb\t\tc", "日本語 テキスト", "é ñ", "😀😀 👨‍👩‍👧", "--- ***!?", "<|endoftext|>", "a\r\nb\r\n", "\x0b\x0c\x1c\x85", "trailing   "]


def test_every_document_and_odd_texts(spark, small, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT", 500)
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("n"), "text", F.lit("x").alias("piece"))
    rows = rows.unionByName(spark.createDataFrame([(-1 - i, t, "y") for i, t in enumerate(ODD)], "n bigint, text string, piece string"))
    found = tokens.exact_token_counts(rows, ranks()).collect()
    assert len(found) == 1000 + len(ODD)
    assert not [(r["text"][:40], r["tokens"]) for r in found if r["tokens"] != count(r["text"])]
    assert tokens.exact_corpus_tokens(rows, ranks()).first()["tokens"] == sum(r["tokens"] for r in found)


def test_nothing_to_count(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    assert tokens.exact_token_counts(none, ranks()).count() == 0
    assert tuple(tokens.exact_corpus_tokens(none, ranks()).first()) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        tokens.exact_token_counts(none, ranks(), "id")
