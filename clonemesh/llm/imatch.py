"""I-Match document fingerprints with DataFrame functions only.

Terms whose document frequency lies in a band form the lexicon. Each of several randomised
subsets of the lexicon keeps a share of it; a document's distinct terms in a subset, sorted,
are hashed to one part of its fingerprint. Shares from 1/8 to 1/512 let short and long
documents keep some parts through an edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, text_or_empty, written

#: Shares of the lexicon, as powers of two, with up to SUBSETS disjoint subsets each.
LEVELS, SUBSETS = (3, 5, 7, 9), 16
#: Document frequencies kept, as shares of all documents.
BAND = (0.0005, 0.1)
#: A document with less than one of so many of its terms in the band brings in its others.
FEW = 8
#: Lexicon terms that are broadcast at most (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


#: What xxhash64 gives for an empty array: its seed.
_NOTHING = 42


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(term) with at least two documents and a document frequency within ``band``, and the
    terms of documents that this leaves with less than one term in FEW.

    Large groups of copies lift the terms of their text over the band. A term outside of it
    comes in if half of its documents or more are such ones, so words that are frequent
    everywhere stay out, and each text has one fingerprint wherever it stands."""
    n = docs.count()
    of = docs.select(F.xxhash64("_cm_text").alias("text"), terms(F.col("_cm_text")).alias("ts"))
    df = written(of.select(F.explode("ts").alias("term")).groupBy("term").count(), "frequencies")
    inside = (F.col("count") >= max(2.0, band[0] * n)) & (F.col("count") <= max(2.0, band[1] * n))
    words = written(df.where(inside).select("term"), "band")
    lex = words.withColumn("ok", F.lit(True))
    known = of.select("text", F.explode("ts").alias("term")).join(F.broadcast(lex) if words.count() <= MOST_BROADCAST else lex, "term", "left")
    bare = known.groupBy("text").agg(F.count("*").alias("n"), F.count("ok").alias("k")).where(F.col("k") * FEW < F.col("n"))
    bare = written(bare.select("text"), "bare")
    theirs = docs.withColumn("text", F.xxhash64("_cm_text")).join(F.broadcast(bare) if bare.count() <= MOST_BROADCAST else bare, "text", "left_semi")
    own = theirs.select(F.explode(terms(F.col("_cm_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("own"))
    return words.union(df.where(~inside).join(own, "term").where("2 * own >= count").select("term"))


def _parts(ts: Column, fallback: Column) -> Column:
    """Parts of the fingerprint of the sorted distinct terms ``ts``; 0 where a subset has
    none of them. The last part stands in where no term is in the lexicon."""
    levels, at = [], 0
    for bits in LEVELS:
        levels.append(_level(ts, at, bits))
        at += bits
    last = F.when(F.size(ts) == 0, fallback).otherwise(F.lit(_NOTHING))
    parts = F.concat(*levels, F.array(last))
    return F.transform(parts, lambda h: F.when(h == _NOTHING, F.lit(0)).otherwise(F.greatest(h.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(1))))


def _level(ts: Column, at: int, bits: int) -> Column:
    """Hashes of a level's subsets; the terms of any of them are sorted out first, as each
    subset looks through all of them."""
    n = min(SUBSETS, 1 << bits)
    some = F.filter(ts, lambda t: _class(t, at, bits) < n) if n < 1 << bits else ts
    return F.transform(F.array(some), lambda own: F.array(*(F.xxhash64(F.filter(own, _in_class(at, bits, i))) for i in range(n))))[0]


def _class(t: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1))


def _in_class(at: int, bits: int, i: int):
    """The subset: terms whose hash has the value i in these bits of it."""
    return lambda t: _class(t, at, bits) == i


def _tagged(column: str, kind: int) -> Column:
    return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(kind).alias("kind")))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else, of the levels where the two have four parts or more,
    the largest share of equal ones among the parts that either has, and the share over all
    parts if no level has as many."""

    def count(x: Column, y: Column, equal: bool) -> Column:
        test = (lambda p, q: (p == q) & (p != 0)) if equal else (lambda p, q: (p != 0) | (q != 0))
        return F.size(F.filter(F.zip_with(x, y, test), lambda z: z))

    shares, at = [], 1
    for n in [min(SUBSETS, 1 << bits) for bits in LEVELS]:
        x, y = F.slice(a, at, n), F.slice(b, at, n)
        some = count(x, y, False)
        shares.append(F.when(some >= 4, count(x, y, True).cast("double") / some))
        at += n
    some = count(a, b, False)
    over = F.when(some > 0, count(a, b, True).cast("double") / some).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.greatest(*shares), over))


def text_of(parts: Column) -> Column:
    return F.concat_ws("", F.transform(parts, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")))


#: What tells documents apart: id (null: the smallest number), hash and length of the text.
KEY = ("_cm_id", "_cm_th", "n_chars")
_PREV = tuple(f"prev_{c}" for c in KEY)
_NO_ID = -(1 << 63)
_FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def in_order(ids: DataFrame) -> DataFrame:
    """``ids`` (distinct KEY) and, in prev_*, the row before by KEY; the first row comes after
    the last."""
    placed = written(ids.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "order")
    row = F.struct(*KEY)
    last = placed.groupBy("part").agg(F.max(row).alias("tail"))  # a row for each partition
    before = last.select("part", F.lag("tail").over(Window.orderBy("part")).alias("tail"), F.max("tail").over(Window.partitionBy()).alias("end"))
    w = Window.partitionBy("part").orderBy(*KEY)
    rows = placed.withColumn("prev", F.lag(row).over(w)).join(F.broadcast(before), "part")
    prev = F.coalesce("prev", "tail", "end")
    return written(rows.select(*KEY, *(prev[c].alias(p) for c, p in zip(KEY, _PREV))), "order")


def _whole(text: str, ts: str) -> Column:
    """A hash of all terms, or of the text where it has none; of an empty text, nothing."""
    bare = F.when(F.col(text) == "", F.lit(_NOTHING)).otherwise(F.xxhash64(text))
    return F.when(F.size(ts) == 0, bare).otherwise(F.xxhash64(F.sort_array(ts)))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, the last floor(n/2) code
    points of which are replaced by the first as many (or all) of the next document's.

    Returns a row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (the likeness to the edited text's and the
    next document's). The next document is that with the next larger doc_id; after the last
    comes the first.

    A null text is an empty one, whose fingerprint is all zeros. A text without any term in
    the lexicon gets a fingerprint of all its terms' hash, and one without terms of the whole
    text's, so only equal ones are alike. Documents without an id come first. Rows that
    repeat an id are documents of their own, ordered by a hash of their texts; rows equal in id
    and text have equal results and count as one where the next document is looked for. A
    document alone is its own next. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_cm_id"), text_or_empty().alias("_cm_text"))
    slim = slim.withColumns({"_cm_th": F.xxhash64("_cm_text"), "n_chars": F.char_length("_cm_text")})
    words = written(lexicon(slim, band), "lexicon")
    release(spark)
    order = in_order(slim.select(*KEY).distinct())
    release(spark)
    one = slim.groupBy(*KEY).agg(F.min("_cm_text").alias("_cm_text"))
    heads = one.join(order.hint("merge"), list(KEY)).select(*(F.col(p).alias(c) for c, p in zip(KEY, _PREV)), F.expr("left(_cm_text, cast(floor(prev_n_chars / 2) as int))").alias("head"))
    both = one.join(heads.hint("merge"), list(KEY)).select(*KEY, "_cm_text", F.expr("concat(left(_cm_text, cast(n_chars - floor(n_chars / 2) as int)), left(head, cast(floor(n_chars / 2) as int)))").alias("edited"))
    both = both.select(*KEY, "_cm_text", "edited", F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha"), terms(F.col("_cm_text")).alias("t1"), terms(F.col("edited")).alias("t2"))
    tagged = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(0).alias("kind"))), _tagged("t1", 1), _tagged("t2", 2))
    whole = [_whole("_cm_text", "t1").alias("wt1"), _whole("edited", "t2").alias("wt2")]
    # what stands beside explode() is evaluated for each of its rows, so it comes first
    rows = both.select(*KEY, "sha", *whole, tagged.alias("xs")).select(*KEY, "sha", "wt1", "wt2", F.explode("xs").alias("x"))
    rows = rows.select(*KEY, "sha", "wt1", "wt2", "x.term", "x.kind")
    lex = words.withColumn("ok", F.lit(True))
    rows = rows.join(F.broadcast(lex) if words.count() <= MOST_BROADCAST else lex, "term", "left").where("ok or kind = 0")
    got = rows.groupBy(*KEY).agg(
        *(F.max(F.when(F.col("kind") == 0, F.col(c))).alias(c) for c in ("sha", "wt1", "wt2")),
        *(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("term")))).alias(f"t{k}") for k in (1, 2)),
    )
    got = got.select(*KEY, F.lower(F.hex("sha")).alias("edited_sha256"), _parts(F.col("t1"), F.col("wt1")).alias("fp"), _parts(F.col("t2"), F.col("wt2")).alias("ep"))
    was = spark.conf.get(_FALLBACK, None)
    spark.conf.set(_FALLBACK, "16384")  # groups that are hashed before sorting takes over
    try:
        got = written(got, "fingerprints")
    finally:
        spark.conf.set(_FALLBACK, was) if was is not None else spark.conf.unset(_FALLBACK)
    release(spark)
    after = got.select(*KEY, "fp").join(order, list(KEY)).select(*(F.col(p).alias(c) for c, p in zip(KEY, _PREV)), F.col("fp").alias("np"))
    out = slim.select(*KEY).join(got.join(after, list(KEY)), list(KEY))
    return out.select(
        F.when(F.col("_cm_id") != _NO_ID, F.col("_cm_id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("ep")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("ep")).alias("near_edited"), likeness(F.col("fp"), F.col("np")).alias("near_next"),
    )
