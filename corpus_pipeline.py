"""A corpus pipeline over operators of ``clonemesh.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of ``docs``. Their results are written as Parquet and read
again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonemesh.llm.common import table, text_or_empty, written
from clonemesh.llm.minhash import near_duplicates
from clonemesh.llm.mixing import sample_mixture
from clonemesh.llm.quality import keep_good
from clonemesh.llm.queries import piece_model
from clonemesh.llm.repeats import remove_repeats
from clonemesh.llm.sentencepiece_codec import encode_decode

#: Two documents of which 100 * intersection >= 80 * union hold for their 5-word shingles are
#: near-duplicates.
SIMILARITY = 80
#: Words of a window that stays in one document only.
WINDOW = 13


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on labelled rows, does not reject.

    A null text is judged as an empty one; rows that repeat an id are judged each by its own
    text, rows without an id too. Texts are read whole. Without labels all rows have
    one score. Other columns pass through; an empty table gives an empty one.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    Rows are dropped by id and text, so of rows that repeat an id only those go whose own
    text has a near-duplicate with a smaller id; rows equal in both are one document and
    share its fate. Texts that are null or without words, and rows without an id, stay. Texts
    are compared whole. Other columns pass through; an empty table gives an empty one.
    """
    gone = near_duplicates(docs, SIMILARITY, with_hash=True).where("not kept").select("doc_id", "text_hash").distinct()
    mine = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(text_or_empty()) == gone["text_hash"])
    return docs.join(gone.hint("merge"), mine, "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without the words that a document with a smaller id has in the
    same window of 13.

    Texts in which nothing goes stay as they are, nulls too; of others the kept words are
    joined by one space, and n_chars follows. Rows that repeat an id remove nothing from each
    other; rows without an id count as the last document. An empty table gives an empty one.
    """
    return remove_repeats(docs, WINDOW, keep_text=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest sample of rows whose tokens have the target shares of source, language and
    topic: their shares now to the power 0.5.

    A null source or language is a value of its own, a null text has one token. Rows that
    repeat an id are kept or dropped together, rows without one by their text. Columns pass
    through; an empty table gives an empty one.
    """
    return sample_mixture(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, with a check that they decode to it: doc_id, lang, source,
    n_chars as far as there are such columns, token_ids, n_tokens, decoded_sha256 and exact.

    A row for each row, whatever repeats; a null text is an empty one, without tokens. An
    empty table gives an empty one.
    """
    return encode_decode(docs, piece_model(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Classifier, near-duplicates and tokenizer have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table ``documents``, one after another; odd rows are treated
    as each stage says, and an empty table gives the last stage's columns without rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
