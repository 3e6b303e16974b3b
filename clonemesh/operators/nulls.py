"""Null models of co-clustering and thresholds that control the false discovery rate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .pairs import coassociation, weight_of, weight_table


def cocluster_prob(assignments: DataFrame, over: str = "sizes", every: bool = False) -> DataFrame:
    """(method, p): the chance that two receptors share a cluster, sum of s(s-1) / n(n-1).
    n is the sum of sizes, or the number of distinct receptors (over="receptors"). Rows that
    repeat count once, or each (``every``)."""
    a = assignments.select("method", "cluster_id", "tcr_id")
    a = a if every else a.distinct()
    s = a.groupBy("method", "cluster_id").agg(F.count("*").alias("s")).groupBy("method").agg(F.sum(F.col("s") * (F.col("s") - 1)).alias("pairs"), F.sum("s").alias("n"))
    if over == "receptors":
        s = s.drop("n").join(a.groupBy("method").agg(F.count_distinct("tcr_id").alias("n")), "method")
    return s.select("method", F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("p"))


def expected_vote(assignments: DataFrame, weights: dict[str, float] | None = None, over: str = "sizes", every: bool = False) -> DataFrame:
    """One row: expected (sum of weight times p) and variance of the vote of a random pair."""
    p = cocluster_prob(assignments, over, every).join(F.broadcast(weight_table(assignments.sparkSession, weights or {})), "method", "left")
    w = F.coalesce("weight", F.lit(1.0))
    return p.agg(F.coalesce(F.sum(w * F.col("p")), F.lit(0.0)).alias("expected"), F.coalesce(F.sum(F.col("p") * (1 - F.col("p"))) / F.pow(F.count("*"), F.lit(2)), F.lit(0.0)).alias("variance"))


def permuted(assignments: DataFrame, rounds: int, seed: int = 0, every: bool = False) -> DataFrame:
    """(b, method, tcr_id, cluster_id): cluster labels shuffled within each method ``rounds``
    times; sizes stay. Receptors and labels are both ranked, by hashes, and joined on rank. Rows
    that repeat count once, or each (``every``)."""
    a = assignments.select("method", "tcr_id", "cluster_id")
    a = written(a if every else a.distinct(), "assignments")
    b = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b")
    ids = ranked(a, ["method"], ["tcr_id", "cluster_id"], "r").select("method", "tcr_id", "r", b)
    h = F.xxhash64(F.lit(seed), "b", "method", "tcr_id", "cluster_id")
    labels = ranked(a.select("*", b).withColumn("h", h), ["b", "method"], ["h", "tcr_id", "cluster_id"], "r").select("b", "method", "cluster_id", "r")
    # files are compressed, so by their size alone Spark takes these for small enough to broadcast
    return ids.join(labels.hint("merge"), ["b", "method", "r"]).select("b", "method", "tcr_id", "cluster_id")


def ranked(t: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``t`` with the place (from 1) of each row in its group by ``order``: rows are sorted by
    range and the counts of the ranges are added up, so a group of any size is in many tasks."""
    placed = written(t.repartitionByRange(*groups, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    parts = placed.groupBy("_p", *groups).agg(F.count("*").alias("_c"))
    before = parts.select("_p", *groups, (F.sum("_c").over(Window.partitionBy(*groups).orderBy("_p")) - F.col("_c")).alias("_c"))
    n = F.row_number().over(Window.partitionBy("_p", *groups).orderBy(*order)) + F.col("_c")
    # a row for each range and group in it; else the ranged table itself may be taken for the smaller one
    return placed.join(F.broadcast(before), ["_p", *groups]).withColumn(name, n).drop("_p", "_c")


def permutation_null(assignments: DataFrame, weights: dict[str, float] | None = None, rounds: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Null scores (b, tcr_id_a, tcr_id_b, score) of all rounds, and for each pair the rounds
    in which it co-clustered (tcr_id_a, tcr_id_b, cnt)."""
    p = permuted(assignments, rounds, seed)
    tagged = p.select("method", F.concat_ws("|", F.col("b").cast("string"), "cluster_id").alias("cluster_id"), F.concat_ws("|", F.col("b").cast("string"), "tcr_id").alias("tcr_id"))
    e = coassociation(tagged, weights)
    cut = lambda c: F.substring_index(c, "|", 1)
    rest = lambda c: F.expr(f"substr({c}, instr({c}, '|') + 1)")
    scores = written(e.select(cut("tcr_id_a").cast("int").alias("b"), rest("tcr_id_a").alias("x"), rest("tcr_id_b").alias("y"), "weighted_support").select("b", F.least("x", "y").alias("tcr_id_a"), F.greatest("x", "y").alias("tcr_id_b"), F.col("weighted_support").alias("score")), "null")
    return scores, scores.groupBy("tcr_id_a", "tcr_id_b").agg(F.count("*").alias("cnt"))


def from_above(t: DataFrame, *columns: str) -> DataFrame:
    """``t`` (one row for each score) with each of ``columns`` summed over the scores down to
    the row's: sums within range partitions plus those of the partitions above, so distinct
    scores are never in one task."""
    placed = written(t.repartitionByRange(F.col("score").desc()).withColumn("_p", F.spark_partition_id()), "ranged")
    parts = placed.groupBy("_p").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = parts.select("_p", *((F.sum(f"_{c}").over(Window.orderBy("_p")) - F.col(f"_{c}")).alias(f"_{c}") for c in columns))
    w = Window.partitionBy("_p").orderBy(F.col("score").desc())
    rest = [c for c in t.columns if c not in columns]
    return placed.join(F.broadcast(before), "_p").select(*rest, *((F.sum(c).over(w) + F.col(f"_{c}")).alias(c) for c in columns))


def fdr_table(observed: DataFrame, null: DataFrame, per_permutation: int = 1) -> DataFrame:
    """(score, n_obs, n_null, fdr) for each observed score: how many observed and null scores
    reach it. Distinct scores are counted before they are accumulated; a row may stand for n of them."""
    o = observed.groupBy("score").agg(F.sum(weight_of(observed)).alias("o"))
    n = null.groupBy("score").agg(F.sum(weight_of(null)).alias("n"))
    both = o.join(n, "score", "full").select("score", F.col("o").isNotNull().alias("seen"), F.coalesce("o", F.lit(0)).alias("n_obs"), F.coalesce("n", F.lit(0)).alias("n_null"))
    acc = from_above(both, "n_obs", "n_null")
    return acc.where("seen").select("score", "n_obs", "n_null", (F.col("n_null") / per_permutation / F.col("n_obs")).alias("fdr"))


def fdr_threshold(observed: DataFrame, null: DataFrame, q: float = 0.05, per_permutation: int = 1) -> float:
    """The smallest observed score whose ratio is at most q; none: just above the largest; no
    null scores: the smallest observed; no observed scores: infinity."""
    t = fdr_table(observed, null, per_permutation)
    row = t.agg(F.min(F.when(F.col("fdr") <= q, F.col("score"))).alias("t"), F.max("score").alias("hi")).first()
    if row["hi"] is None:
        return math.inf
    return float(row["t"]) if row["t"] is not None else float(row["hi"]) + 1e-9


def analytical_threshold(expected: float, margin: float = 1.0) -> float:
    return expected * margin


def significance_threshold(expected: float, variance: float, margin: float = 2.0, centred: bool = False) -> float:
    """E + margin * sigma; without E if scores are already less E (``centred``)."""
    return (0.0 if centred else expected) + margin * math.sqrt(max(variance, 0.0))


def edge_significance(edges: DataFrame, expected: float) -> DataFrame:
    """final_score becomes what the net vote has over the expected one, 0 at least."""
    return edges.withColumn("final_score", F.greatest(F.col("weighted_support") - F.col("repulsion_support") - F.lit(float(expected)), F.lit(0.0)))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 and, by symmetry, below: a rational
    approximation with a relative error below 1.2e-7."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + z / 2)
    # Coefficients of the approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    p = F.lit(c[-1])
    for v in reversed(c[:-1]):
        p = p * t + v
    r = t * F.exp(-z * z + p)
    return F.when(x >= 0, r).otherwise(F.lit(2.0) - r)


def analytical_fdr_threshold(edges: DataFrame, expected: float, variance: float, q: float = 0.05, keep_most: bool = False) -> float:
    """Scores by rank against a normal tail: n * erfc(z / sqrt 2) / 2 / rank <= q. The largest
    score that satisfies q, or the smallest (``keep_most``); none: infinity."""
    n = edges.agg(F.coalesce(F.sum(weight_of(edges)), F.lit(0))).first()[0]
    sd = math.sqrt(max(variance, 1e-300))
    s = edges.groupBy(F.col("final_score").alias("score")).agg(F.sum(weight_of(edges)).alias("c"))
    ranked = from_above(s.withColumnRenamed("c", "rank"), "rank")
    tail = 0.5 * erfc((F.col("score") - expected) / sd / math.sqrt(2)) * n / F.col("rank")
    row = ranked.where(tail <= q).agg((F.min if keep_most else F.max)("score").alias("t")).first()
    return math.inf if row["t"] is None else float(row["t"])
