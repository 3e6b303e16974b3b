"""Texts whose hashes by sums of powers are equal are told apart by every operator."""

from __future__ import annotations

import pytest

from clonemesh.llm import repeats
from clonemesh.llm.minhash import near_duplicates
from clonemesh.llm.queries import piece_model
from clonemesh.llm.sentencepiece_codec import encode_decode


def rows(alike, of):
    return [(2 * i + k, of(t)) for i, pair in enumerate(alike) for k, t in enumerate(pair)]


def test_words_are_not_removed_for_others(spark, alike):
    df = spark.createDataFrame(rows(alike, lambda t: "one two three four five six seven eight nine ten eleven twelve " + t), "doc_id long, text string")
    assert {r.n_removed for r in repeats.remove_repeats(df).collect()} == {0}
    df = spark.createDataFrame(rows(alike, lambda t: " ".join(f"w{i}" for i in range(49)) + " " + t), "doc_id long, text string")
    assert repeats.repeated_spans(df).collect() == []


def test_one_word_texts_are_not_linked(spark, alike):
    df = spark.createDataFrame(rows(alike, lambda t: t), "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in near_duplicates(df, 85).collect())
    df = spark.createDataFrame(rows(alike, lambda t: f"a b c d {t}"), "doc_id long, text string")
    assert all(r.kept for r in near_duplicates(df, 85).collect())


def test_units_get_their_own_tokens(spark, alike):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_model())
    texts = rows(alike, lambda t: t)
    got = {r.doc_id: r for r in encode_decode(spark.createDataFrame(texts, "doc_id long, text string"), piece_model()).collect()}
    for i, t in texts:
        assert list(got[i].token_ids) == lib.encode(t) and got[i].exact
