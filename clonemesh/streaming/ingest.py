"""Incremental ingestion: a stream of receptor rows is cleaned and deduplicated, and every
micro-batch is joined with the deletion keys of what came before, giving new edit-distance
edges only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import deletions
from ..operators.preprocess import cdr3_reason


def clean_stream(stream: DataFrame, watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Upper-case CDR3s without bad ones, one row for each sequence and gene within the
    watermark; late repeats after it count as new."""
    c = F.upper(F.trim("cdr3_beta"))
    good = stream.withColumn("cdr3_beta", c).where(F.col("cdr3_beta").isNotNull() & cdr3_reason(F.col("cdr3_beta")).isNull())
    return good.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["cdr3_beta", "v_beta"])


class EdgeSink:
    """``foreachBatch`` target: the sequences so far, their keys and the edges found, as Parquet
    by batch. A sequence is in one batch's files only, so no batch makes the history distinct
    again: it is looked for among the sequences, and its keys are joined with the others'. A
    batch that is run again overwrites its own files, so each edge is there once."""

    def __init__(self, base: str):
        self.seqs, self.keys, self.edges = f"{base}/seqs", f"{base}/keys", f"{base}/edges"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seqs = batch.select(F.col("cdr3_beta").alias("seq")).distinct()
        known, keys = (self._before(spark, x, s, epoch) for x, s in ((self.seqs, "seq string"), (self.keys, "seq string, key string")))
        if known is not None:
            seqs = seqs.join(known, "seq", "left_anti")
        seqs.write.mode("overwrite").parquet(f"{self.seqs}/epoch={epoch}")
        fresh = spark.read.schema("seq string").parquet(f"{self.seqs}/epoch={epoch}")
        fresh.select("seq", F.explode(deletions(F.col("seq"))).alias("key")).write.mode("overwrite").parquet(f"{self.keys}/epoch={epoch}")
        new = spark.read.schema("seq string, key string").parquet(f"{self.keys}/epoch={epoch}")
        seen = new.unionByName(keys) if keys is not None else new
        pairs = new.select("key", F.col("seq").alias("x")).join(seen.select("key", F.col("seq").alias("y")), "key").where("x <> y")
        out = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("dist", F.levenshtein("a", "b", 1)).where("dist >= 0")
        out.write.mode("overwrite").parquet(f"{self.edges}/epoch={epoch}")

    def _before(self, spark: SparkSession, path: str, schema: str, epoch: int) -> DataFrame | None:
        """What earlier batches wrote below ``path``."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        old = spark.read.option("basePath", path).schema(f"{schema}, epoch int").parquet(path).where(F.col("epoch") < epoch).drop("epoch")
        return None if old.isEmpty() else old

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.edges).select("a", "b", "dist").distinct()


def start(stream: DataFrame, base: str, checkpoint: str, watermark: str = "1 hour"):
    return clean_stream(stream, watermark).writeStream.foreachBatch(EdgeSink(base)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
