"""Clusterers: each gives assignments (method, tcr_id, cluster_id, membership_score)."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import trim_cdr3, with_allele
from ..schema import ASSIGNMENTS, MethodStatus
from ..storage import written
from .graph import components
from .kmotifs import enriched_motifs, motif_members
from .markov import two_step
from .receptor_distance import receptor_clusters
from .simjoin import hamming_pairs, levenshtein_pairs


@dataclass
class ClusterRun:
    """What a run of a clusterer left behind."""

    method: str
    assignments: DataFrame
    status: str = MethodStatus.SUCCESS.value
    seconds: float = 0.0
    error: str = ""
    parameters: dict = field(default_factory=dict)


def assigned(df: DataFrame, method: str) -> DataFrame:
    return df.select(F.lit(method).alias("method"), "tcr_id", F.col("cluster_id").cast("string").alias("cluster_id"), F.lit(1.0).alias("membership_score"))


def sequences(tcr: DataFrame, chain: str = "beta") -> DataFrame:
    c = F.col(f"cdr3_{chain}")
    ord_ = F.col("ord") if "ord" in tcr.columns else F.monotonically_increasing_id()
    return tcr.select("tcr_id", c.alias("seq"), ord_.alias("ord")).where("seq is not null and seq <> ''")


def leaders(seqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, leader): greedy leader clustering of distinct texts in the order of ``ord``, as
    the lexicographically first maximal independent set of the pair graph. Each round a text
    leads if every earlier neighbour has dropped out; neighbours of leaders drop out. A text
    that does not lead belongs to its earliest leading neighbour."""
    first = written(seqs.groupBy("seq").agg(F.min("ord").alias("ord")), "texts")
    o = first.toDF("b", "ob")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = written(both.join(first.toDF("a", "oa"), "a").join(o, "b").where("ob < oa").select("a", "b", "ob"), "earlier")
    state = written(first.select("seq", F.lit(0).alias("state")), "state")  # 0 open, 1 leads, 2 out
    while not state.where("state = 0").isEmpty():
        seen = near.join(state.toDF("b", "sb"), "b").groupBy("a").agg(F.max(F.col("sb") == 1).alias("led"), F.max(F.col("sb") == 0).alias("open"))
        nxt = state.join(seen.withColumnRenamed("a", "seq"), "seq", "left")
        s = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("led", F.lit(False)), 2).when(~F.coalesce("open", F.lit(False)), 1).otherwise(0)
        state = written(nxt.select("seq", s.alias("state")), "state")
    lead = near.join(state.where("state = 1").select(F.col("seq").alias("b")), "b", "left_semi").groupBy("a").agg(F.min_by("b", "ob").alias("leader"))
    return state.join(lead.withColumnRenamed("a", "seq"), "seq", "left").select("seq", F.when(F.col("state") == 1, F.col("seq")).otherwise(F.col("leader")).alias("leader"))


def hamming_clusters(tcr: DataFrame, chain: str = "beta", threshold: int = 1, min_size: int = 2) -> DataFrame:
    """Greedy leader clusters of equal-length CDR3s within ``threshold`` mismatches. The
    cluster id is the leader's sequence."""
    s = sequences(tcr, chain)
    led = leaders(s, hamming_pairs(s, threshold))
    rows = s.join(led, "seq").select("tcr_id", F.col("leader").alias("cluster_id"))
    return assigned(_sized(rows, min_size), "hd_baseline")


def levenshtein_clusters(tcr: DataFrame, chain: str = "beta", threshold: int = 1, min_size: int = 2) -> DataFrame:
    """Components of CDR3s within ``threshold`` edits; the id is the smallest sequence."""
    s = sequences(tcr, chain)
    roots = components(levenshtein_pairs(s, threshold), "a", "b")
    rows = s.join(roots.toDF("seq", "root"), "seq", "left").select("tcr_id", F.coalesce("root", "seq").alias("cluster_id"))
    return assigned(_sized(rows, min_size), "levenshtein")


def _sized(rows: DataFrame, least: int) -> DataFrame:
    big = rows.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster_id")
    return rows.join(big, "cluster_id", "left_semi")


def receptor_groups(hits: DataFrame, members: DataFrame, min_size: int = 2) -> DataFrame:
    """Clusters of queries that share a receptor group: components of the graph of queries
    and groups. ``hits`` has (query, receptor_group), ``members`` (query, tcr_id)."""
    edges = hits.where("receptor_group is not null and receptor_group <> ''").select(F.concat(F.lit("q:"), "query").alias("a"), F.concat(F.lit("g:"), "receptor_group").alias("b")).distinct()
    roots = components(edges, "a", "b").where("startswith(node, 'q:')").select(F.expr("substr(node, 3)").alias("query"), F.col("root").alias("cluster_id"))
    rows = members.join(roots, "query").select("tcr_id", "cluster_id").distinct()
    return assigned(_sized(rows, min_size), "tcrmatch")


# Inputs of outside tools.


def tcrmatch_input(tcr: DataFrame, chain: str = "beta") -> DataFrame:
    return sequences(tcr, chain).select(trim_cdr3(F.col("seq")).alias("query"), "tcr_id")


def junctions(tcr: DataFrame) -> DataFrame:
    """(junction, tcr_ids): one row for each distinct beta + alpha sequence."""
    j = F.concat(F.coalesce("cdr3_beta", F.lit("")), F.coalesce("cdr3_alpha", F.lit("")))
    return tcr.select(j.alias("junction"), "tcr_id").where("junction <> ''").groupBy("junction").agg(F.array_sort(F.collect_list("tcr_id")).alias("tcr_ids"))


def clonotypes(tcr: DataFrame) -> DataFrame:
    """(clonotype, count, tcr_id) with genes of both chains carrying an allele."""
    parts = []
    for g, s, j in (("v_alpha", "cdr3_alpha", "j_alpha"), ("v_beta", "cdr3_beta", "j_beta")):
        parts += [with_allele(F.col(g)), F.coalesce(F.col(s), F.lit("")), with_allele(F.col(j))]
    return tcr.select(F.concat_ws("_", *parts).alias("clonotype"), "tcr_id", "count")


def gliph_input(tcr: DataFrame) -> DataFrame:
    """One record for each CDR3 beta: genes, subject and count of its first row."""
    o = F.col("ord") if "ord" in tcr.columns else F.monotonically_increasing_id()
    row = F.struct("v_beta", "j_beta", "cdr3_alpha", "subject_id", "count")
    return tcr.where("cdr3_beta is not null").groupBy("cdr3_beta").agg(F.min_by(row, o).alias("r")).select("cdr3_beta", "r.*")


def giana_input(tcr: DataFrame) -> DataFrame:
    """(cdr3, v, tcr_id) of both chains, one below the other."""
    rows = tcr.select("tcr_id", F.explode(F.array(F.struct(F.col("cdr3_beta").alias("cdr3"), F.col("v_beta").alias("v")), F.struct(F.col("cdr3_alpha").alias("cdr3"), F.col("v_alpha").alias("v")))).alias("x"))
    return rows.select("x.cdr3", "x.v", "tcr_id").where("cdr3 is not null and cdr3 <> ''").distinct()


def external(assignments: DataFrame, method: str) -> DataFrame:
    """Assignments that an outside tool made, with (tcr_id, cluster_id) at least."""
    return assigned(assignments.dropDuplicates(["tcr_id", "cluster_id"]), method)


# Hierarchical clustering of a distance table.


def ward(d: np.ndarray) -> np.ndarray:
    """Merges (i, j, height) of Ward's method by nearest-neighbour chains; d: distances."""
    n = len(d)
    d = d.astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, ids, alive, out, chain = np.ones(n), list(range(n)), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain = chain[:-2]
        out.append((ids[x], ids[y], float(np.sqrt(d[x, y]))))
        total = size[x] + size[y] + size
        new = ((size[x] + size) * d[x] + (size[y] + size) * d[y] - size * d[x, y]) / total
        alive[y] = False
        d[x], d[:, x] = new, new
        d[x, x] = np.inf
        size[x] += size[y]
        ids[x] = n + len(out) - 1
    return np.array(out) if out else np.zeros((0, 3))


def cut(merges: np.ndarray, n: int, height: float) -> np.ndarray:
    """Flat labels from merges up to a height. Merges may come in any order."""
    up = list(range(2 * n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (i, j, h) in enumerate(merges.tolist()):
        if h <= height:
            up[find(int(i))] = up[find(int(j))] = n + k
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def silhouette(d: np.ndarray, label: np.ndarray) -> float:
    k = label.max() + 1
    if k < 2 or k >= len(label):
        return -1.0
    onehot = np.eye(k)[label]
    n = onehot.sum(axis=0)
    s = d @ onehot
    own = s[np.arange(len(label)), label] / np.maximum(n[label] - 1, 1)
    other = np.where(onehot > 0, np.inf, s / n).min(axis=1)
    v = np.where(n[label] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(v.mean())


def hierarchical_clusters(distances: DataFrame, min_size: int = 2, most: int = 5_000, missing: float = 100.0) -> DataFrame:
    """Ward clusters of a distance table (tcr_id_a, tcr_id_b, dist), cut at the whole
    threshold from 2 to the median (between 10 and 200) with the best silhouette. One dense
    group of at most ``most`` ids; distances that are missing count as ``missing``."""
    n = distances.select(F.col("tcr_id_a").alias("x")).union(distances.select("tcr_id_b")).distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"at most {most} ids; cluster a subset or blocks")

    def run(t: pa.Table) -> pa.Table:
        a, b = (np.array(t.column(c).to_pylist(), object) for c in ("tcr_id_a", "tcr_id_b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        m = np.full((len(nodes), len(nodes)), missing)
        v = np.nan_to_num(t.column("dist").to_numpy().astype(float), nan=missing)
        x, y = at[: len(a)], at[len(a) :]
        m[x, y] = m[y, x] = v
        np.fill_diagonal(m, 0.0)
        merges = ward(m)
        high = int(min(max(np.percentile(v, 50), 10), 200))
        best, label = -2.0, np.arange(len(nodes))
        for h in range(2, high + 1):
            got = cut(merges, len(nodes), h)
            s = silhouette(m, got)
            if s > best:
                best, label = s, got
        low = {c: nodes[label == c].min() for c in set(label.tolist())}
        return pa.table([list(nodes), [low[c] for c in label.tolist()]], names=["tcr_id", "cluster_id"])

    rows = distances.select(F.lit(0).alias("g"), "tcr_id_a", "tcr_id_b", F.col("dist").cast("double").alias("dist"))
    return assigned(_sized(rows.groupBy("g").applyInArrow(run, "tcr_id string, cluster_id string"), min_size), "tcrdist3")


# Clusterers that are told apart by what they compare.


def two_step_clusters(tcr: DataFrame, min_size: int = 2, **kw) -> DataFrame:
    """Markov clusters of neighbouring junctions (beta + alpha) within pre-clusters by
    composition; receptors of a junction without neighbours are in none."""
    j = written(junctions(tcr), "junctions")
    got = two_step(j.select(F.col("junction").alias("seq")), **kw)
    rows = j.join(got, j["junction"] == got["seq"]).select(F.explode("tcr_ids").alias("tcr_id"), F.col("cluster").alias("cluster_id"))
    return assigned(_sized(rows, min_size), "clustcr")


def motif_clusters(tcr: DataFrame, background: DataFrame | None = None, chain: str = "beta", min_size: int = 2, by: str | None = None, **kw) -> DataFrame:
    """Overlapping clusters by enriched motif, against the CDR3s in column seq of
    ``background``; without one every subject is held against the whole table."""
    s = written(tcr.select("tcr_id", F.col(f"cdr3_{chain}").alias("seq"), F.col("subject_id").cast("string").alias("subject_id")).where("seq is not null and seq <> ''"), "sequences")
    by = by or (None if background is not None else "subject_id")
    found = written(enriched_motifs(s, s if background is None else background, by, **kw), "motifs")
    m = motif_members(s, found, by)
    key = (s["seq"] == m["seq"]) & ((s["subject_id"] == m["by"]) if by else F.lit(True))
    rows = s.join(m, key).select("tcr_id", (F.concat_ws("|", "by", "cluster") if by else F.col("cluster")).alias("cluster_id")).distinct()
    return assigned(_sized(rows, min_size), "gliph2")


def distance_clusters(tcr: DataFrame, radius: float = 20.0, min_size: int = 2, **kw) -> DataFrame:
    """Receptors linked by steps of at most ``radius`` in receptor distance."""
    return assigned(_sized(receptor_clusters(tcr, radius, **kw), min_size), "tcrdist3")


# Supervised prediction of labels.


class LabelPredictor:
    """k-mer counts and logistic regression over several labels, on ``pyspark.ml``."""

    def __init__(self, k: int = 3, features: int = 1 << 14, reg: float = 0.01):
        self.k, self.features, self.reg, self.model = k, features, reg, None

    def _kmers(self, df: DataFrame) -> DataFrame:
        c = F.coalesce("cdr3_beta", F.lit(""))
        return df.withColumn("_k", F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - self.k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(self.k))))

    def fit(self, df: DataFrame, label: str = "epitope") -> LabelPredictor:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer

        index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df.where(F.col(label).isNotNull()))
        steps = [index, HashingTF(inputCol="_k", outputCol="_x", numFeatures=self.features), LogisticRegression(featuresCol="_x", labelCol="_y", regParam=self.reg), IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)]
        self.model = Pipeline(stages=steps).fit(self._kmers(df.where(F.col(label).isNotNull())))
        self.classes = index.labels
        return self

    @property
    def is_fitted(self) -> bool:
        return self.model is not None

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml import PipelineModel

        return PipelineModel(stages=self.model.stages[1:]).transform(self._kmers(df)).select("tcr_id", "predicted", "probability")


#: Clusterers that run here; others come in as assignments of outside tools.
BUILT_IN: dict[str, Callable[..., DataFrame]] = {"hd_baseline": hamming_clusters, "levenshtein": levenshtein_clusters, "clustcr": two_step_clusters, "gliph2": motif_clusters, "tcrdist3": distance_clusters}
EXTERNAL = ("giana", "tcrmatch", "deeptcr")
ALL_METHODS = ("hd_baseline", "levenshtein", "clustcr", "gliph2", "tcrdist3", *EXTERNAL)


def available_methods(outside: dict[str, DataFrame] | None = None) -> list[str]:
    return [m for m in ALL_METHODS if m in BUILT_IN or m in (outside or {})]


def run_method(method: str, tcr: DataFrame, outside: dict[str, DataFrame] | None = None, **params) -> ClusterRun:
    """Run a clusterer to its end, so that what fails fails here; a failure gives no rows."""
    spark, began = tcr.sparkSession, time.time()
    try:
        if method in (outside or {}):
            ids = tcr.select("tcr_id").distinct()
            got = external(outside[method].join(ids, "tcr_id", "left_semi"), method)
        elif method in BUILT_IN:
            got = BUILT_IN[method](tcr, **params)
        else:
            raise LookupError(f"{method} is not available")
        return ClusterRun(method, written(got, method), seconds=time.time() - began, parameters=params)
    except Exception as e:  # one method's failure must not end the others
        return ClusterRun(method, spark.createDataFrame([], ASSIGNMENTS), MethodStatus.FAILED.value, time.time() - began, str(e)[:500], params)
