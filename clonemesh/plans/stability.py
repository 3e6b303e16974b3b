"""Weights from agreement between methods, from resampling, and from iteration."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.calibrate import cluster_features, raw_confidence
from ..operators.consensus import Consensus, balanced
from ..operators.votes import MOST, Votes
from ..storage import written
from .weights import COEFFICIENTS, PRIORS, scaled


def first_labels(assignments: DataFrame) -> DataFrame:
    """(method, tcr_id, cluster_id): of several clusters of one method the first counts."""
    order = F.col("ord") if "ord" in assignments.columns else F.col("cluster_id")
    return assignments.groupBy("method", "tcr_id").agg(F.min_by("cluster_id", order).alias("cluster_id"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tcr_id, cluster_id, label) over the ids of either; an id that one lacks is a cluster of
    its own there."""
    j = a.select("tcr_id", F.col("cluster_id").alias("ca")).join(b.select("tcr_id", F.col("cluster_id").alias("cb")), "tcr_id", "full")
    solo = F.concat(F.lit("solo_"), "tcr_id")
    return j.select("tcr_id", F.coalesce("ca", solo).alias("cluster_id"), F.coalesce("cb", solo).alias("label"))


def leave_one_out(assignments: DataFrame, weights: dict[str, float], threshold: float = 0.3) -> dict[str, float]:
    """For each method, the NMI of its clusters with the consensus of the others."""
    first = written(first_labels(assignments), "labels")
    out = {}
    for m in weights:
        others = {k: v for k, v in weights.items() if k != m}
        rest = balanced(assignments.where(F.col("method") != m), scaled(others, "mean1"), threshold).members
        out[m] = float(metrics.nmi(metrics.contingency(aligned(first.where(F.col("method") == m), rest))).first()[0])
    return out


def variation_of_information(a: DataFrame, b: DataFrame) -> float:
    r = metrics.information(metrics.contingency(aligned(a, b))).first()
    return max(0.0, r["h_cluster"] + r["h_label"] - 2 * r["mi"])


def bootstrap_stability(run: Callable[[DataFrame], DataFrame], tcr: DataFrame, rounds: int = 20, share: float = 0.8, seed: int = 0) -> float:
    """1 - mean variation of information between runs on resamples / log n, on common ids."""
    got = [written(run(tcr.sample(withReplacement=True, fraction=share, seed=seed + b).dropDuplicates(["tcr_id"])).select("tcr_id", "cluster_id"), "resample") for b in range(rounds)]
    n = max(2, tcr.select("tcr_id").distinct().count())
    vi = []
    for x, y in zip(got, got[1:]):
        common = x.select("tcr_id").intersect(y.select("tcr_id"))
        vi.append(variation_of_information(x.join(common, "tcr_id", "left_semi"), y.join(common, "tcr_id", "left_semi")))
    return max(0.0, 1 - sum(vi) / max(len(vi), 1) / math.log(n))


def prior_score(method: str) -> float:
    return sum(v * PRIORS.get(method, {}).get(k, 0.5) for k, v in COEFFICIENTS.items())


def stability_weights(accuracy: dict[str, float], stability: dict[str, float] | None = None, alpha: float = 0.5, least: float = 0.03) -> dict[str, float]:
    """accuracy * stability * prior ** alpha, floored and made to add to 1."""
    raw = {m: max(a * (stability or {}).get(m, 1.0) * prior_score(m) ** alpha, least) for m, a in accuracy.items()}
    return scaled(raw, "sum1")


def method_reliability(assignments: DataFrame, members: DataFrame, confidence: DataFrame) -> dict[str, float]:
    """For each method the mean confidence of consensus clusters, weighted by overlaps of two
    receptors or more with its own clusters; a confidence of 0 counts as 0.5."""
    o = assignments.select("method", F.col("cluster_id").alias("own"), "tcr_id").distinct().join(members.select("cluster_id", "tcr_id"), "tcr_id").groupBy("method", "own", "cluster_id").agg(F.count("*").alias("n")).where("n >= 2")
    c = confidence.toDF("cluster_id", "c")
    r = o.join(c, "cluster_id").groupBy("method").agg((F.sum(F.col("n") * F.when(F.col("c") == 0, 0.5).otherwise(F.col("c"))) / F.sum("n")).alias("r"))
    return {x["method"]: float(x["r"]) for x in r.collect()}


def method_clusters(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("method", "cluster_id").agg(F.array_sort(F.collect_set("tcr_id")).alias("members"))


def iterative_reweight(assignments: DataFrame, weights: dict[str, float], rounds: int = 5, alpha: float = 0.6, least: float = 0.02, tolerance: float = 1e-3, threshold: float = 0.3, scale: str = "mean1") -> tuple[dict[str, float], list[dict[str, float]]]:
    """Consensus, confidence of its clusters, reliability of methods, a moving average of
    weights; until they stand still."""
    w, history = scaled({m: max(v, least) for m, v in weights.items()}, "sum1"), []
    history.append(w)
    for _ in range(rounds):
        c = balanced(assignments, scaled(w, scale), threshold)
        if len(w) <= MOST:  # pairs inside clusters are counted in blocks, none is a row
            members = written(c.members, "members")
            inner = written(Votes(assignments, scaled(w, scale), groups=members).counted(Votes.GROUP), "inner")
            c = Consensus(members, inner, threshold)
        conf = raw_confidence(cluster_features(c.members, c.edges, inner=len(w) <= MOST))
        r = method_reliability(assignments, c.members, conf)
        target = scaled({m: max(r.get(m, least), least) for m in w}, "sum1")
        new = scaled({m: max(alpha * target[m] + (1 - alpha) * w[m], least) for m in w}, "sum1")
        moved = max(abs(new[m] - w[m]) for m in w)
        w = new
        history.append(w)
        if moved < tolerance:
            break
    return w, history
