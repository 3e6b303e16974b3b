"""Calibrating cluster confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import weight_of
from .refine import inner_edges


def cluster_features(members: DataFrame, edges: DataFrame, inner: bool = False) -> DataFrame:
    """Size and statistics of the edges inside each cluster; zeros without any. ``inner``: edges
    have the cluster_id that they are inside of already."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    n = weight_of(edges)
    mean = lambda c: F.sum(F.col(c) * n) / F.sum(n)
    e = (edges if inner else inner_edges(members, edges)).groupBy("cluster_id").agg(mean("final_score").alias("mean_edge"), F.min("final_score").alias("min_edge"), F.percentile("final_score", F.lit(0.5), n).alias("median_edge"), mean("method_support_count").alias("mean_support"), F.sum(n).alias("n_edges"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return size.join(e, "cluster_id", "left").select("cluster_id", "size", *(z(c) for c in ("mean_edge", "min_edge", "median_edge", "mean_support", "n_edges")))


def raw_confidence(features: DataFrame) -> DataFrame:
    """clip(mean edge + 0.05 (mean support - 1), 0, 1); 0 without edges."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_edge") + 0.05 * (F.col("mean_support") - 1)))
    return features.select("cluster_id", F.when(F.col("n_edges") > 0, r).otherwise(F.lit(0.0)).alias("raw_confidence"))


class Calibrator:
    """Isotonic regression of purity on raw confidence, clipped to [0, 1]. With fewer than
    ``least`` points it only clips."""

    def __init__(self, least: int = 5):
        self.least, self.x, self.y = least, None, None

    def fit(self, points: DataFrame, x: str = "raw_confidence", y: str = "purity") -> Calibrator:
        from pyspark.ml.regression import IsotonicRegression

        p = points.select(F.col(x).cast("double").alias("features"), F.col(y).cast("double").alias("label")).where("features is not null and label is not null")
        if p.count() >= self.least:
            m = IsotonicRegression(featuresCol="features", labelCol="label").fit(p)
            self.x, self.y = list(m.boundaries), list(m.predictions)
        return self

    @property
    def is_fitted(self) -> bool:
        return self.x is not None

    def predict(self, df: DataFrame, x: str = "raw_confidence", out: str = "calibrated") -> DataFrame:
        """Linear between the boundaries and flat outside, as a column expression."""
        c = F.col(x).cast("double")
        if self.x is None:
            return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
        xs, ys = F.array(*map(F.lit, self.x)), F.array(*map(F.lit, self.y))
        i = F.size(F.filter(xs, lambda v: v <= c))
        lo, hi = F.greatest(i, F.lit(1)), F.least(i + 1, F.lit(len(self.x)))
        xa, xb, ya, yb = (F.element_at(a, k) for a, k in ((xs, lo), (xs, hi), (ys, lo), (ys, hi)))
        v = F.when((i == 0) | (i == len(self.x)) | (xa == xb), ya).otherwise(ya + (yb - ya) * (c - xa) / F.when(xb != xa, xb - xa))
        return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def cluster_purity(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, purity): share of the commonest label among labelled members."""
    k = members.join(labels.where("epitope is not null"), "tcr_id").groupBy("cluster_id", "epitope").agg(F.count("*").alias("n"))
    return k.groupBy("cluster_id").agg((F.max("n") / F.sum("n")).alias("purity"))


def fit_calibration(members: DataFrame, edges: DataFrame, labels: DataFrame, inner: bool = False) -> Calibrator:
    raw = raw_confidence(cluster_features(members, edges, inner))
    return Calibrator().fit(raw.join(cluster_purity(members, labels), "cluster_id"))


def coverage_curve(points: DataFrame, n: int = 50, confidence: str = "confidence", purity: str = "purity") -> DataFrame:
    """(threshold, coverage, mean_purity) at ``n`` thresholds from 0 to 1: each point's grid
    index is found once and counts are accumulated from the top."""
    c = F.least(F.floor(F.col(confidence) * (n - 1) + 1e-9), F.lit(n - 1))
    per = points.where(F.col(confidence) >= 0).groupBy(c.cast("int").alias("i")).agg(F.count("*").alias("k"), F.sum(purity).alias("s"))
    spark = points.sparkSession
    from pyspark.sql import Window

    grid = spark.range(n).select(F.col("id").cast("int").alias("i")).join(F.broadcast(per), "i", "left")
    w = Window.orderBy(F.col("i").desc())
    total = Window.partitionBy()
    g = grid.select("i", F.sum(F.coalesce("k", F.lit(0))).over(w).alias("k"), F.sum(F.coalesce("s", F.lit(0.0))).over(w).alias("s"), F.sum(F.coalesce("k", F.lit(0))).over(total).alias("n"))
    return g.select((F.col("i") / float(n - 1)).alias("threshold"), (F.col("k") / F.when(F.col("n") > 0, F.col("n"))).alias("coverage"), F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(0.0).alias("mean_purity"))


def calibration_error(points: DataFrame, bins: int = 10, confidence: str = "confidence", accuracy: str = "purity") -> DataFrame:
    """One row: the expected calibration error; the last bin holds 1."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    per = points.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(accuracy).alias("a"))
    return per.agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), F.lit(0.0)).alias("ece"))
