"""Fusing votes with sequence, gene and noise signals into one edge score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import BETAS, default_scores, fused_score, noise_significance, sequence_similarity, shared_genes
from ..storage import written
from .pairs import weight_of
from .votes import Votes

SIGNALS = ("vote", "seq", "vj", "noise")


def pair_signals(edges: DataFrame, tcr: DataFrame, distances: DataFrame | None = None, scores: dict | None = None, tau: float = 50.0) -> DataFrame:
    """``edges`` with sequence_support and vj_support from the receptors of both ends and, if
    given, distances (tcr_id_a, tcr_id_b, dist) with a < b."""
    scores = scores or default_scores()
    t = tcr.select("tcr_id", "cdr3_beta", "v_beta", "j_beta")
    a, b = (t.toDF(f"tcr_id_{x}", f"_s{x}", f"_v{x}", f"_j{x}") for x in "ab")
    e = edges.join(a, "tcr_id_a", "left").join(b, "tcr_id_b", "left")
    dist = None
    if distances is not None:
        e = e.join(distances.select("tcr_id_a", "tcr_id_b", F.col("dist").alias("_d")), ["tcr_id_a", "tcr_id_b"], "left")
        dist = F.col("_d")
    e = e.withColumn("sequence_support", sequence_similarity(F.col("_sa"), F.col("_sb"), dist, scores, tau))
    e = e.withColumn("vj_support", shared_genes(F.col("_va"), F.col("_vb"), F.col("_ja"), F.col("_jb")))
    return e.drop(*(f"_{x}{y}" for x in "svj" for y in "ab"), "_d")


def fuse(edges: DataFrame, tcr: DataFrame, distances: DataFrame | None = None, pair_null: DataFrame | None = None, rounds: int = 0, betas: dict | None = None, intercept: float = 0.0, signals: tuple[str, ...] = SIGNALS, scores: dict | None = None, tau: float = 50.0) -> DataFrame:
    """All signals and the fused final_score. With ``pair_null`` (tcr_id_a, tcr_id_b, cnt) of
    ``rounds`` permutations p = (cnt + 1) / (rounds + 1); noise_penalty is -log10 p."""
    e = pair_signals(edges, tcr, distances, scores, tau)
    noise = F.lit(0.0)
    if pair_null is not None and rounds > 0:
        e = e.join(pair_null.select("tcr_id_a", "tcr_id_b", F.col("cnt").alias("_c")), ["tcr_id_a", "tcr_id_b"], "left")
        p = (F.coalesce("_c", F.lit(0)) + 1) / float(rounds + 1)
        e, noise = e.withColumn("noise_penalty", -F.log10(p)), noise_significance(p)
    else:
        e = e.withColumn("noise_penalty", F.lit(0.0))
    vote = F.col("weighted_support") - F.col("repulsion_support")
    return e.withColumn("final_score", fused_score(vote, F.col("sequence_support"), F.col("vj_support"), noise, betas, intercept, signals)).drop("_c")


def null_fused(null_scores: DataFrame, tcr: DataFrame, betas: dict | None = None, intercept: float = 0.0, signals: tuple[str, ...] = SIGNALS, **kw) -> DataFrame:
    """Null scores on the fused scale, without the noise term; signals of a pair are computed
    once, however many permutations it is in."""
    pairs = null_scores.select("tcr_id_a", "tcr_id_b").distinct()
    s = pair_signals(pairs, tcr, **kw)
    rest = tuple(x for x in signals if x != "noise")
    j = null_scores.join(s, ["tcr_id_a", "tcr_id_b"])
    return j.select("b", "tcr_id_a", "tcr_id_b", fused_score(F.col("score"), F.col("sequence_support"), F.col("vj_support"), F.lit(0.0), betas, intercept, rest).alias("score"))


def noise_gate(background: float, threshold: float = 0.4) -> bool:
    return background >= threshold


def use_signals(background: float | None = None, threshold: float = 0.4, base: tuple[str, ...] = SIGNALS) -> tuple[str, ...]:
    """Signals to fuse: noise only where the background noise reaches the gate or is unknown."""
    return base if background is None or noise_gate(background, threshold) else tuple(s for s in base if s != "noise")


def labeled_pairs(edges: DataFrame, labels: DataFrame, max_pairs: int | None = 10_000, balance: bool = True, seed: int = 0) -> DataFrame:
    """Edges whose ends both have a label, with same (1 or 0); each class in the order of a
    hash, up to ``max_pairs`` in all and, if balanced, equally many. Edges between classes of
    receptors with one label count as n pairs; of the last one taken n may be cut."""
    l = labels.where("epitope is not null").select("tcr_id", "epitope")
    e = edges.join(l.toDF("tcr_id_a", "la"), "tcr_id_a").join(l.toDF("tcr_id_b", "lb"), "tcr_id_b").withColumn("same", (F.col("la") == F.col("lb")).cast("int")).drop("la", "lb")
    w = weight_of(e)
    n = {r["same"]: r["n"] for r in e.groupBy("same").agg(F.sum(w).alias("n")).collect()}
    most = min(n.get(0, 0), n.get(1, 0)) if balance else max(n.values(), default=0)
    if max_pairs is not None:
        most = min(most, max_pairs // 2)
    if all(v <= most for v in n.values()):
        return e
    # rows lie by hash in ranges, so a class of any size is in many tasks
    order = ["_h", "tcr_id_a", "tcr_id_b"]
    placed = e.withColumn("_h", F.xxhash64(F.lit(seed), "tcr_id_a", "tcr_id_b")).repartitionByRange("same", *order)
    placed = written(placed.withColumn("_p", F.spark_partition_id()), "labeled")
    parts = placed.groupBy("_p", "same").agg(F.sum(w).alias("_c"))
    before = parts.select("_p", "same", (F.sum("_c").over(Window.partitionBy("same").orderBy("_p")) - F.col("_c")).alias("_b"))
    own = Window.partitionBy("_p", "same").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    some = placed.join(F.broadcast(before), ["_p", "same"]).withColumn("_b", F.sum(w).over(own) + F.col("_b") - w).where(F.col("_b") < most)
    if "n" in e.columns:
        some = some.withColumn("n", F.least("n", most - F.col("_b")))
    return some.select(*e.columns)


def labeled_counts(votes: Votes, labels: DataFrame, balance: bool = True) -> DataFrame:
    """(same, n): how many pairs :func:`labeled_pairs` has of each kind, without a limit, counted in
    blocks of classes; labels (tcr_id, epitope), of which each row counts."""
    n = written(votes.labelled(labels.select("tcr_id", F.col("epitope").alias("label"))), "labelled")
    return n.select("same", F.min("n").over(Window.partitionBy()).alias("n")) if balance else n


def learn_betas(pairs: DataFrame, signals: tuple[str, ...] = SIGNALS, c: float = 1.0) -> tuple[dict[str, float], float]:
    """Coefficients and intercept of a class-balanced logistic regression with an L2 penalty on
    standardised signals, back on their own scales. Fewer than 10 pairs or one class: the
    defaults."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = pairs.select((F.col("weighted_support") - F.col("repulsion_support")).alias("vote"), F.col("sequence_support").alias("seq"), F.col("vj_support").alias("vj"), F.least(F.col("noise_penalty") / 3.0, F.lit(1.0)).alias("noise"), "same")
    stats = x.agg(F.count("*").alias("n"), F.sum("same").alias("pos"), *(f(s).alias(f"{s}_{k}") for s in signals for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    n, pos = stats["n"], stats["pos"] or 0
    if n < 10 or pos in (0, n):
        return dict(BETAS), 0.0
    mean = {s: stats[f"{s}_m"] for s in signals}
    sd = {s: stats[f"{s}_s"] or 1.0 for s in signals}
    z = x.select(*(((F.col(s) - mean[s]) / sd[s]).alias(s) for s in signals), F.col("same").cast("double").alias("label"), F.when(F.col("same") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))).alias("w"))
    m = LogisticRegression(featuresCol="x", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=200, tol=1e-9).fit(VectorAssembler(inputCols=list(signals), outputCol="x").transform(z))
    w = np.array(m.coefficients)
    betas = dict(BETAS) | {s: float(v / sd[s]) for s, v in zip(signals, w)}
    return betas, float(m.intercept - sum(v * mean[s] / sd[s] for s, v in zip(signals, w)))
