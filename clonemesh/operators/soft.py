"""Soft memberships of graphs of any size: affiliations by gradient ascent and spectral
coordinates by subspace iteration, from edge tables.

A node's row is (node, f) with an array of k numbers. A round joins edges with both ends' rows and
sums by node, with map-side combine; what couples all nodes is a vector of k sums or a matrix
of k * k products, which is all that comes to the driver.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, written

if TYPE_CHECKING:
    from .votes import Votes


def both_ways(edges: DataFrame, weight: str = "final_score") -> DataFrame:
    """(node, nbr, w) of edges (tcr_id_a, tcr_id_b), each both ways; loops are left out and
    repeated edges add up."""
    a, b = F.col("tcr_id_a"), F.col("tcr_id_b")
    e = edges.where(a != b).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "w").union(e.select("v", "u", "w"))


def drawn(node: Column, j: int, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of node, place and seed."""
    return F.conv(F.substring(F.md5(F.concat(node, F.lit(f":{j}:{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def begun(both: DataFrame, k: int, low: float = 0.1, width: float = 0.1, seed: int = 0) -> DataFrame:
    """(node, f): k drawn numbers from ``low`` on for each node with an edge."""
    return both.select("node").distinct().select("node", F.array(*(low + width * drawn(F.col("node"), j, seed) for j in range(k))).alias("f"))


def _summed(k: int, column: Column) -> list[Column]:
    return [F.sum(column[j]).alias(f"s{j}") for j in range(k)]


def _dot(a: Column, b: Column, k: int) -> Column:
    out = a[0] * b[0]
    for j in range(1, k):
        out = out + a[j] * b[j]
    return out


def pulls(both: DataFrame, f: DataFrame, k: int) -> DataFrame:
    """(node, s0, s1, ..., fit): sums over the neighbours in ``both`` (node, nbr) of their rows in ``f``,
    each times what shared affiliations leave to explain, and the likelihood of the edges."""
    f, g = f.select("node", "f"), F.col("g")
    ends = both.select("node", "nbr").join(f, "node").join(f.toDF("nbr", "g"), "nbr")
    p = F.least(F.greatest(_dot(F.col("f"), g, k), F.lit(1e-10)), F.lit(50.0))
    ends = ends.select("node", "g", p.alias("p")).withColumn("q", F.greatest(1 - F.exp(-F.col("p")), F.lit(1e-10)))
    pull = 1 + F.exp(-F.col("p")) / F.col("q")
    return ends.groupBy("node").agg(*(F.sum(pull * g[j]).alias(f"s{j}") for j in range(k)), F.sum(F.log("q") + F.col("p")).alias("fit"))


def stepped(f: DataFrame, near: DataFrame, k: int, rate: float = 0.005) -> tuple[DataFrame, float]:
    """One step up the likelihood of an edge being there by shared affiliations, and the
    likelihood before it. ``near`` has what :func:`pulls` gives for ``f``, a written table."""
    f = f.select("node", "f")
    sums = f.agg(*_summed(k, F.col("f")), F.sum(_dot(F.col("f"), F.col("f"), k)).alias("squares")).first()
    total = [float(sums[f"s{j}"] or 0.0) for j in range(k)]
    new = [F.least(F.greatest(F.col("f")[j] + rate * (F.col(f"s{j}") - F.lit(total[j]) + F.col("f")[j]), F.lit(0.0)), F.lit(1e3)) for j in range(k)]
    out = written(f.join(near, "node").select("node", F.array(*new).alias("f"), "fit"), "affiliations")
    fit = (out.agg(F.sum("fit")).first()[0] or 0.0) / 2 - (sum(t * t for t in total) - (sums["squares"] or 0.0)) / 2
    return out, float(fit)


def affiliation_round(both: DataFrame, f: DataFrame, k: int, rate: float = 0.005) -> tuple[DataFrame, float]:
    """:func:`stepped` over the edges ``both`` (node, nbr)."""
    return stepped(f, pulls(both, f, k), k, rate)


def affiliations(both: DataFrame, k: int, rounds: int = 500, rate: float = 0.005, seed: int = 0) -> DataFrame:
    """(node, f): affiliation strengths by projected gradient ascent, until the likelihood
    changes by less than a millionth."""
    spark, both = both.sparkSession, written(both, "both")
    f, before = written(begun(both, k, seed=seed), "affiliations"), -np.inf
    for r in range(rounds + 1):
        new, fit = affiliation_round(both, f, k, rate)
        if r == rounds or abs(fit - before) < 1e-6 * max(1.0, abs(fit)):
            drop(spark, new)
            break
        drop(spark, f)
        f, before = new, fit
    drop(spark, both)
    return f.select("node", "f")


#: Share of x in a step; over a half, so that every eigenvalue is above 0.
STAY = 5 / 9


def damped_step(both: DataFrame, degree: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """(node, f): STAY of x plus the rest of its product with the symmetric normalised
    adjacency."""
    scaled = x.join(degree, "node").select(F.col("node").alias("nbr"), F.transform("f", lambda v: v / F.sqrt("d")).alias("g"))
    near = both.join(scaled, "nbr").groupBy("node").agg(*(F.sum(F.col("w") * F.col("g")[j]).alias(f"s{j}") for j in range(k)))
    out = x.join(near, "node").join(degree, "node")
    return out.select("node", F.array(*(STAY * F.col("f")[j] + (1 - STAY) * F.col(f"s{j}") / F.sqrt("d") for j in range(k))).alias("f"))


def damped_step_of_votes(votes: Votes, least: float, seed: int = 0) -> DataFrame:
    """(node, x): :func:`damped_step` of one drawn number for each node, over all pairs of receptors with
    votes of at least ``least``. Receptors of a class have the same edges, so products are of sums
    over classes, less each one's own part."""
    degree = written(votes.strengths(least).join(votes.classes.select("class_id", "n"), "class_id").select("class_id", (F.col("k") / F.col("n")).alias("d")), "degree")
    own = votes.within().select("class_id", F.when(F.col("weighted_support") >= least, F.col("weighted_support")).otherwise(0.0).alias("w"))
    x = -0.5 + 1.0 * drawn(F.col("tcr_id"), 0, seed)
    x = written(votes.ids.join(degree, "class_id").select("class_id", "tcr_id", "d", x.alias("x")), "vectors")
    near = votes.product(x.groupBy("class_id").agg(F.sum(F.col("x") / F.sqrt("d")).alias("v")), least)
    out = x.join(near, "class_id").join(own, "class_id", "left")
    rest = F.col("s") - F.coalesce("w", F.lit(0.0)) * F.col("x") / F.sqrt("d")
    return out.select(F.col("tcr_id").alias("node"), (STAY * F.col("x") + (1 - STAY) * rest / F.sqrt("d")).alias("x"))


def _gram(x: DataFrame, y: Column, k: int) -> np.ndarray:
    r = x.agg(*(F.sum(F.col("f")[i] * y[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(k))).first()
    return np.array([[float(r[f"p{i}_{j}"]) for j in range(k)] for i in range(k)])


def _times(x: Column, m: np.ndarray) -> Column:
    """The row vector times a small matrix."""
    return F.array(*(sum((x[i] * float(m[i, j]) for i in range(1, len(m))), x[0] * float(m[0, j])) for j in range(m.shape[1])))


def spectral_rows(both: DataFrame, k: int, rounds: int = 200, steps: int = 3, tolerance: float = 1e-7, seed: int = 0) -> DataFrame:
    """(node, f): sizes of the 2nd to (k+1)th eigenvectors of the normalised Laplacian by subspace
    iteration: ``steps`` products a round, then the columns are made orthonormal from their
    products, until these and the eigenvalues settle."""
    spark, both, m = both.sparkSession, written(both, "both"), k + 1
    degree = written(both.groupBy("node").agg(F.sum("w").alias("d")), "degree")
    n = degree.count()
    m = min(m, n)
    x, values = written(begun(both, m, -0.5, 1.0, seed), "vectors"), None
    for _ in range(rounds):
        y = x
        for _ in range(steps):
            y = damped_step(both, degree, y, m)
        y = written(y, "vectors")
        low = np.linalg.cholesky(_gram(y, F.col("f"), m))
        q = written(y.select("node", _times(F.col("f"), np.linalg.inv(low).T).alias("f")), "vectors")
        z = damped_step(both, degree, q, m).select("node", F.col("f").alias("z"))
        ritz, turn = np.linalg.eigh(_gram(q.join(z, "node"), F.col("z"), m))
        turn = turn[:, ::-1]
        new = written(q.select("node", _times(F.col("f"), turn).alias("f")), "vectors")
        drop(spark, x, y, q)
        x, now = new, ritz[::-1]
        if values is not None and np.abs(now - values).max() < tolerance:
            break
        values = now
    sizes = [F.abs(F.col("f")[j]) if j < m else F.lit(0.0) for j in range(1, k + 1)]
    return x.select("node", F.array(*sizes).alias("f"))
