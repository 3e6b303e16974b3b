"""Importance resampling towards a target distribution over hashed n-grams, as a table of word
positions: words are exploded with their places, following words are put on by lead() for
each order, n-grams are hashed and grouped, and the buckets' gains are joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words after A-Z are lowered: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    """A-Z lowered and nothing else; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def positions(docs: DataFrame, order: int, buckets: int, keep: list[Column]) -> DataFrame:
    """(row, ``keep``, one, bucket) with a row for each n-gram of 1 to ``order`` words; one: it is a
    single word. A text without words has one row without a bucket. ``row`` numbers the
    rows of ``docs``."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, text.alias("_cm_text"))
    names = [c for c in rows.columns if c != "_cm_text"]
    words = rows.select(*names, F.posexplode_outer(F.regexp_extract_all("_cm_text", F.lit(WORD), F.lit(0))).alias("at", "word"))
    grams = F.array(F.col("word"))
    if order > 1:
        at = Window.partitionBy("row").orderBy("at")
        words = words.withColumns({f"_cm_w{k}": F.lead("word", k).over(at) for k in range(1, order)})
        runs = [F.col("word")]
        for k in range(1, order):  # null where the text ends
            runs.append(F.concat(runs[-1], F.lit(" "), F.col(f"_cm_w{k}")))
        grams = F.array_compact(F.array(*runs))
    grams = words.select(*names, F.posexplode_outer(grams).alias("n", "gram")) if order > 1 else words.select(*names, F.lit(0).alias("n"), F.col("word").alias("gram"))
    return grams.select(*names, (F.col("n") == 0).alias("one"), F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for each bucket that ``source`` uses: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))
    with the counts s, t of the bucket, all S, T and the number of buckets B."""
    count = lambda d, c: d.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(c))
    s, t = count(source, "s"), count(target, "t")
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("ss"), F.coalesce(F.sum("t"), F.lit(0)).alias("tt"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("ss") + buckets) / ((d("s") + 1) * (d("tt") + buckets))
    return both.where("s > 0").crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _ranked(rows: DataFrame, most: Column) -> DataFrame:
    """``rows`` with rank, 1 for the highest score, ties to the smaller doc_id, null beyond
    ``most``: sorted by range, so no task holds them all. Only the counts of the ranges meet."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = written(rows.repartitionByRange(*order).withColumn("_cm_p", F.spark_partition_id()), "ranged")
    parts = placed.groupBy("_cm_p").agg(F.count("*").alias("c"))
    before = parts.select("_cm_p", (F.sum("c").over(Window.orderBy("_cm_p")) - F.col("c")).alias("_cm_before"))
    n = F.row_number().over(Window.partitionBy("_cm_p").orderBy(*order)) + F.col("_cm_before")
    placed = placed.join(F.broadcast(before), "_cm_p").withColumn("rank", n)
    return placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).cast("long")).drop("_cm_p", "_cm_before")


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, least_words: int = 20, share: int = 10, seed: int = 2024) -> DataFrame:
    """Draw ``share`` per cent of the documents with at least ``least_words`` words, without
    replacement, with chances in proportion to how much likelier a text's n-grams are in
    ``target`` (column text) than in ``docs``: the highest sums of mean gain and Gumbel noise.

    A-Z are lowered; features are all runs of 1 to ``order`` words joined by a space, repeats
    counted. Returns one row for each row of ``docs``: doc_id, n_features, weight (floored mean
    of the features' gains in thousandths; 0 without features), score (weight plus noise from
    sha256 of ``seed:doc_id``), rank (1, 2, 3 ... of those drawn, null of others).

    A null text has no words; a null id counts as an empty one in the hash and comes last in
    ties. Rows that repeat an id are judged each by its own text, and have the same noise.
    Texts are read whole. An empty ``docs`` gives an empty result, and with an empty
    ``target`` all target counts are 0. The gains are at most ``buckets`` rows, which bounds their broadcast.
    """
    grams = written(positions(docs, order, buckets, [F.col("doc_id").cast("long").alias("doc_id")]), "positions")
    gains = written(bucket_gains(grams, positions(target, order, buckets, []), buckets), "gains")
    per = grams.join(F.broadcast(gains), "bucket", "left").groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count_if(F.col("one") & F.col("bucket").isNotNull()).alias("words"), F.sum("gain").alias("gain"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("gain").cast("double") / F.col("n_features"))).otherwise(F.lit(0)).cast("long")
    rows = per.select("doc_id", "n_features", "words", weight.alias("weight"), (weight + noise).cast("long").alias("score"))
    rows = written(rows, "scores")
    able = F.col("words") >= least_words
    most = rows.where(able).count() * share // 100
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return _ranked(rows.where(able), F.lit(most)).select(cols).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")).select(cols))


def drawn(docs: DataFrame, target: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with their columns. Rows that repeat
    an id are drawn together."""
    ids = resample(docs.select("doc_id", "text"), target, **kw).where("rank is not null").select(F.col("doc_id").alias("_cm_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_cm_id"]), "left_semi")
