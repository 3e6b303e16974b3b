"""Order-sensitive and numeric operators against plain Python on small random inputs."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from clonemesh.functions.sequences import default_scores, read_score_table, substitution_score
from clonemesh.operators import calibrate, clusterers, consensus, fusion, graph, metrics, motif, nulls, pairs, preprocess, profile, refine, simjoin
from clonemesh.plans import benchmark, config, planner, stability, weights
from clonemesh.plans.engine import Engine
from clonemesh.schema import DatasetProfile


def words(n, seed, letters="ACD", lengths=(4, 7)):
    r = random.Random(seed)
    return ["C" + "".join(r.choice(letters) for _ in range(r.randint(*lengths))) + "F" for _ in range(n)]


def tcr_rows(n, seed):
    r = random.Random(seed)
    return [(f"t{i:03d}", i, "beta_only", s, None, f"TRBV{r.randint(1, 3)}", "TRBJ1-1", r.choice("AB"), f"S{i % 3}", 1 + i % 4) for i, s in enumerate(words(n, seed))]


SCHEMA = "tcr_id string, ord long, chain_mode string, cdr3_beta string, cdr3_alpha string, v_beta string, j_beta string, epitope string, subject_id string, count long"


@pytest.fixture
def tcr(spark):
    return spark.createDataFrame(tcr_rows(80, 1), SCHEMA)


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@pytest.mark.parametrize("threshold", [1, 2])
def test_similarity_joins(spark, threshold):
    w = sorted(set(words(60, 3)))
    d = spark.createDataFrame([(x,) for x in w] * 2, "seq string")
    ham = {(r.a, r.b) for r in simjoin.hamming_pairs(d, threshold).collect()}
    lev = {(r.a, r.b) for r in simjoin.levenshtein_pairs(d, threshold).collect()}
    both = list(itertools.combinations(w, 2))
    assert ham == {(a, b) for a, b in both if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= threshold}
    assert lev == {(a, b) for a, b in both if edit(a, b) <= threshold}


@pytest.mark.parametrize("seed", range(3))
def test_leaders_equal_the_sequential_loop(spark, seed):
    rows = tcr_rows(70, seed + 10)
    got = {r.tcr_id: r.cluster_id for r in clusterers.hamming_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    lead, own = [], {}
    for row in rows:
        s = row[3]
        own[row[0]] = next((x for x in lead if len(x) == len(s) and sum(a != b for a, b in zip(x, s)) <= 1), None)
        if own[row[0]] is None:
            lead.append(s)
            own[row[0]] = s
    n = {}
    for v in own.values():
        n[v] = n.get(v, 0) + 1
    assert got == {k: v for k, v in own.items() if n[v] >= 2}


def test_components_both_ways(spark):
    r = random.Random(5)
    e = [(f"n{r.randint(0, 60):02d}", f"n{r.randint(0, 60):02d}") for _ in range(45)]
    d = spark.createDataFrame(e, "tcr_id_a string, tcr_id_b string")
    small = {x.node: x.root for x in graph.components(d).collect()}
    u = d.selectExpr("least(tcr_id_a, tcr_id_b) u", "greatest(tcr_id_a, tcr_id_b) v").where("u <> v").distinct()
    assert small == {x.node: x.root for x in graph.contract(u).collect()} == graph._union_find(*zip(*[x for x in e if x[0] != x[1]]))
    assert graph.components(d.limit(0)).count() == 0


ASSIGN = [("A", t, c) for c, m in (("1", "t1 t2 t3"), ("2", "t4 t5")) for t in m.split()] + [("B", t, c) for c, m in (("1", "t1 t2 t4"), ("2", "t3 t5")) for t in m.split()]


def test_coassociation_and_modes(spark):
    a = spark.createDataFrame(ASSIGN, "method string, tcr_id string, cluster_id string")
    e = {(r.tcr_id_a, r.tcr_id_b): (r.method_support_count, r.weighted_support) for r in pairs.coassociation(a, {"A": 2.0, "B": 1.0}).collect()}
    assert e == {("t1", "t2"): (2, 3.0), ("t1", "t3"): (1, 2.0), ("t2", "t3"): (1, 2.0), ("t4", "t5"): (1, 2.0), ("t1", "t4"): (1, 1.0), ("t2", "t4"): (1, 1.0), ("t3", "t5"): (1, 1.0)}
    assert {r.tcr_id for r in consensus.conservative(a).members.collect()} == {"t1", "t2"}
    assert consensus.balanced(a, None, 0.1).members.select("cluster_id").distinct().count() == 1
    assert {r.tcr_id for r in consensus.balanced(a, None, 1.5).members.collect()} == {"t1", "t2"}
    with pytest.raises(ValueError):
        pairs.coassociation(a, max_pairs=2)
    assert pairs.star_clusters(a).count() == 5


def test_consensus_options(spark, tcr):
    a = clusterers.hamming_clusters(tcr).unionByName(clusterers.levenshtein_clusters(tcr))
    w = {"hd_baseline": 1.0, "levenshtein": 1.0}
    fused = consensus.balanced(a, w, tcr=tcr, signals=("vote", "seq", "vj", "noise"), fdr_q=0.5, rounds=5)
    assert math.isfinite(fused.threshold)
    assert fused.edges.where("final_score < 0 or final_score > 1").count() == 0
    plain = consensus.coverage(a, w, analytical=True, fdr_q=0.9)
    assert plain.edges.where("final_score < 0").count() == 0
    signed = consensus.balanced(a, w, signed=True, purity={"levenshtein": 0.95})
    assert signed.edges.where("repulsion_support > 0").count() >= 0


def test_null_keeps_sizes(spark):
    a = spark.createDataFrame(ASSIGN, "method string, tcr_id string, cluster_id string")
    p = nulls.permuted(a, 4, 1).groupBy("b", "method", "cluster_id").count().collect()
    assert sorted(r["count"] for r in p) == sorted([3, 2, 3, 2] * 4)
    obs = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0)], "score double")
    none = spark.createDataFrame([], "score double")
    assert nulls.fdr_threshold(obs, none) == 1.0
    assert nulls.fdr_threshold(none, obs) == math.inf
    assert nulls.fdr_threshold(obs, spark.createDataFrame([(9.0,)] * 9, "score double")) == 3.0 + 1e-9
    x = spark.createDataFrame([(v,) for v in (-2.0, -0.3, 0.0, 0.5, 3.0)], "x double")
    for r in x.select("x", nulls.erfc(x.x).alias("y")).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=2e-7)


def test_merge_is_the_greedy_pass(spark):
    r = random.Random(2)
    n, size = 9, 3
    m = [(f"c{i}", f"t{i}_{j}") for i in range(n) for j in range(size)]
    e = [(a, b, r.random()) for (ca, a), (cb, b) in itertools.combinations(m, 2) if ca != cb and r.random() < 0.2]
    e = [(min(a, b), max(a, b), s) for a, b, s in e]
    got = {x.tcr_id: x.cluster_id for x in refine.merge_clusters(spark.createDataFrame(m, "cluster_id string, tcr_id string"), spark.createDataFrame(e, "tcr_id_a string, tcr_id_b string, final_score double"), 0.5).collect()}
    sets, gone = {f"c{i}": {t for c, t in m if c == f"c{i}"} for i in range(n)}, set()
    want = {}
    for i in range(n):
        a = f"c{i}"
        if a in gone:
            continue
        own = set(sets[a])
        for j in range(i + 1, n):
            b = f"c{j}"
            cross = [s for x, y, s in e if (x in own and y in sets[b]) or (y in own and x in sets[b])]
            if b not in gone and cross and sum(cross) / len(cross) >= 0.5:
                own |= sets[b]
                gone.add(b)
        want |= dict.fromkeys(own, a)
    assert got == want


def test_refine_and_motifs(spark, tcr):
    a = clusterers.levenshtein_clusters(tcr)
    c = consensus.balanced(a)
    out = refine.refine(c.members, c.edges, config.load_config()["refinement"], tcr, motifs=True)
    assert out.count() == c.members.count()
    assert {r.label for r in out.select("label").distinct().collect()} <= {"core", "peripheral", "low_confidence"}
    assert refine.clusters(out).count() == out.select("cluster_id").distinct().count()
    p = motif.pwm(["CAF", "CA", "CXF"])
    assert p.sum(axis=1) == pytest.approx(1)
    assert motif.symmetric_kl(p, p) == 0
    assert motif.two_groups(["CAAF"] * 4 + ["CDDF"] * 4).tolist() == [0] * 4 + [1] * 4
    assert motif.two_groups(["CAF"]) is None


def brute_pairs(pred, true):
    both = [(p == q, t == u) for (p, t), (q, u) in itertools.combinations(zip(pred, true), 2)]
    tp = sum(a and b for a, b in both)
    return tp, sum(a for a, _ in both), sum(b for _, b in both)


@pytest.mark.parametrize("seed", range(3))
def test_metrics_by_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(f"t{i}", f"c{r.randint(0, 4)}", f"l{r.randint(0, 3)}") for i in range(30)]
    d = spark.createDataFrame(rows, "tcr_id string, cluster_id string, label string")
    m = metrics.all_metrics(d).first()
    pred, true = [x[1] for x in rows], [x[2] for x in rows]
    tp, pp, tt = brute_pairs(pred, true)
    assert m.pairwise_precision == pytest.approx(tp / pp)
    assert m.pairwise_sensitivity == pytest.approx(tp / tt)
    n, total = len(rows), 30 * 29 / 2
    assert m.ari == pytest.approx((tp - pp * tt / total) / ((pp + tt) / 2 - pp * tt / total))
    precision = np.mean([sum(q == p and u == t for q, u in zip(pred, true)) / pred.count(p) for p, t in zip(pred, true)])
    assert m.bcubed_precision == pytest.approx(precision)

    def entropy(x):
        return -sum(x.count(v) / n * math.log(x.count(v) / n) for v in set(x))

    mi = entropy(pred) + entropy(true) - entropy(list(zip(pred, true)))
    assert m.nmi == pytest.approx(mi / ((entropy(pred) + entropy(true)) / 2))
    shuffled = []
    for _ in range(400):
        r.shuffle(true)
        shuffled.append(entropy(pred) + entropy(true) - entropy(list(zip(pred, true))))
    emi = metrics.expected_mi(metrics.contingency(d)).first()[0]
    assert emi == pytest.approx(np.mean(shuffled), abs=4 * np.std(shuffled) / 20)


def test_metrics_edge_cases(spark):
    same = spark.createDataFrame([(f"t{i}", f"c{i % 2}", f"l{i % 2}") for i in range(6)], "tcr_id string, cluster_id string, label string")
    m = metrics.all_metrics(same).first()
    assert all(m[c] == pytest.approx(1.0) for c in ("retention", "purity", "sensitivity", "ari", "ami", "nmi", "v_measure", "bcubed_f1", "f1"))
    empty = metrics.all_metrics(same.limit(0)).first()
    assert empty.retention == 0 and empty.purity == 0 and empty.sensitivity == 0
    assert metrics.f1_score(0.8, 0.8) == pytest.approx(0.8) and metrics.f1_score(0, 0) == 0


def test_wilcoxon_and_bootstrap(spark):
    d = spark.createDataFrame([(str(i), float(v), 0.0) for i, v in enumerate([1, 2, 3, 4, 5, -6])], "id string, a double, b double")
    w = metrics.wilcoxon(d).first()
    assert w.statistic == 6.0 and w.p_value == pytest.approx(0.4375)
    assert metrics.wilcoxon(d.withColumn("a", d.b)).first() == (0.0, 1.0)
    ci = metrics.paired_bootstrap_ci(d, rounds=300).first()
    assert ci.low <= ci["mean"] <= ci.high


def test_calibration(spark):
    pts = spark.createDataFrame([(x / 10, (x / 10) ** 2) for x in range(11)], "raw_confidence double, purity double")
    c = calibrate.Calibrator().fit(pts)
    got = {r.raw_confidence: r.calibrated for r in c.predict(pts).collect()}
    assert got[0.5] == pytest.approx(0.25) and got[1.0] == pytest.approx(1.0)
    few = calibrate.Calibrator().fit(pts.limit(3))
    assert not few.is_fitted
    assert few.predict(spark.createDataFrame([(1.7,)], "raw_confidence double")).first().calibrated == 1.0


def test_ward_finds_blocks():
    x = np.r_[np.zeros(5), np.full(5, 50.0)] + np.arange(10) * 0.1
    d = np.abs(x[:, None] - x[None, :])
    label = clusterers.cut(clusterers.ward(d), 10, 5.0)
    assert len(set(label[:5])) == 1 and len(set(label)) == 2
    assert clusterers.silhouette(d, label) > 0.9


def test_graph_communities(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 0.2)]
    d = spark.createDataFrame(e, "tcr_id_a string, tcr_id_b string, final_score double")
    got = {}
    for r in graph.louvain(d).collect():
        got.setdefault(r.cluster_id, set()).add(r.tcr_id)
    assert sorted(map(sorted, got.values())) == [[f"{g}{i}" for i in range(5)] for g in "ab"]
    f = graph.bigclam(d, 2, rounds=200)
    assert f.count() == 10 and len(f.first().f) == 2
    assert graph.spectral_soft(d, 3).count() == 10
    assert graph.memberships_to_clusters(graph.extract_memberships(f)).count() <= 2


def test_fusion_learning(spark):
    r = random.Random(1)
    rows = [(f"a{i}", f"b{i}", float(i % 2) + r.random(), 0.0, r.random(), 0.5, 0.0, i % 2) for i in range(60)]
    p = spark.createDataFrame(rows, "tcr_id_a string, tcr_id_b string, weighted_support double, repulsion_support double, sequence_support double, vj_support double, noise_penalty double, same int")
    betas, _ = fusion.learn_betas(p)
    assert betas["vote"] > 0.5
    assert fusion.learn_betas(p.limit(5))[0] == fusion.BETAS
    assert fusion.use_signals(0.1) == ("vote", "seq", "vj") and fusion.use_signals(None) == fusion.SIGNALS
    labels = spark.createDataFrame([(f"{x}{i}", "E" if i % 3 else "G" + x) for x in "ab" for i in range(60)], "tcr_id string, epitope string")
    n = {r["same"]: r["count"] for r in fusion.labeled_pairs(p.drop("same"), labels).groupBy("same").count().collect()}
    assert n[0] == n[1] == 20


def test_substitution(spark, tmp_path):
    d = spark.createDataFrame([("CAF", "CAY"), ("", "A"), ("CX", "CX")], "a string, b string")
    got = [r[0] for r in d.select(substitution_score(d.a, d.b, default_scores())).collect()]
    assert got == [pytest.approx((9 + 4 + 3) / 3), 0.0, pytest.approx((9 - 4) / 2)]
    assert len(default_scores()) == 400 and all(default_scores()[b, a] == v for (a, b), v in default_scores().items())
    (tmp_path / "m.txt").write_text("# c\n   A  R\nA  4 -1\nR -1  5\n")
    assert read_score_table(str(tmp_path / "m.txt")) == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}


def test_weights_and_plans():
    w = weights.empirical_weights(["gliph2", "levenshtein"])
    assert sum(w.values()) == pytest.approx(1)
    m = weights.method_weights(["gliph2", "giana"], "balanced", config.load_config(), {"giana": "failed"})
    assert m["giana"] == 0 and sum(m.values()) == pytest.approx(2)
    assert weights.active_methods(["tcrdist3", "new"], least=0.35) == ["new"]
    assert planner.tiers(["hd_baseline", "tcrdist3"]) == (["hd_baseline"], ["tcrdist3"])
    p = DatasetProfile(background_noise_score=0.9)
    assert planner.select_methods(p, config=config.load_config()).selected_methods == ["tcrdist3", "gliph2", "hd_baseline"]
    assert planner.select_methods(p, explicit=["levenshtein"]).selected_methods == ["levenshtein"]
    assert config.load_config(preset="high_purity")["consensus"]["balanced"]["threshold"] == 0.5
    assert config.load_config({"io": {"input_format": "airr"}})["io"]["input_format"] == "airr"
    assert stability.stability_weights({"gliph2": 0.5, "giana": 0.0})["giana"] > 0


def test_engine_benchmark_and_run_folder(spark, tcr, tmp_path):
    e = Engine(spark)
    r, d = e.run(tcr, str(tmp_path), "x", methods=["hd_baseline", "levenshtein"])
    assert [x.status for x in r.runs] == ["success", "success"]
    assert (tmp_path / "x" / "manifest.json").exists() and (tmp_path / "x" / "report" / "report.md").exists()
    labels = tcr.select("tcr_id", "epitope")
    assert r.metrics(labels).first().retention > 0
    assert benchmark.tradeoff(r.edges, labels, (0.1, 5.0)).count() == 2
    noisy = benchmark.noise_mix(tcr, 0.5)
    assert noisy.count() > tcr.count()
    outside = {"giana": tcr.selectExpr("tcr_id", "substr(cdr3_beta, 1, 3) as cluster_id"), "tcrdist3": tcr.selectExpr("tcr_id", "v_beta as cluster_id")}
    t = Engine(spark).fit_predict(tcr, methods=["hd_baseline", "giana", "tcrdist3"], outside=outside)
    assert len(t.runs) == 3 and "subset" in t.stats
    pair, both = ["hd_baseline", "giana"], {"giana": outside["giana"]}
    cut = [Engine(spark, mode="conservative", config={"consensus": {"conservative": c}}).fit_predict(tcr, methods=pair, outside=both) for c in ({"min_method_support": 1}, {"min_method_support": 3, "threshold": 0.2}, {"min_method_support": 1, "enforce_high_purity": True, "high_purity_methods": ["tcrmatch"]})]
    assert [x.members.count() > 0 for x in cut] == [True, False, False] and cut[1].threshold == 0.2
    bad = clusterers.run_method("nothing", tcr)
    assert bad.status == "failed" and bad.assignments.count() == 0


def test_profile_bounds(spark, tcr):
    p = profile.profile(preprocess.normalize(tcr))
    assert p.n_tcrs == 80 and 0 <= p.background_noise_score <= 1 and p.repertoire_type == "curated_db"
    assert profile.profile(preprocess.normalize(tcr).limit(0)) == DatasetProfile()


def test_bootstrap_stability(spark, tcr):
    s = stability.bootstrap_stability(clusterers.levenshtein_clusters, tcr, rounds=2)
    assert 0 <= s <= 1


def test_label_predictor(spark):
    rows = [(f"t{i}", ("CAAA" if i % 2 else "CDDD") + "ACDEF"[i % 5] + "F", "AB"[i % 2]) for i in range(40)]
    d = spark.createDataFrame(rows, "tcr_id string, cdr3_beta string, epitope string")
    m = clusterers.LabelPredictor().fit(d)
    got = {r.tcr_id: r.predicted for r in m.predict(d).collect()}
    assert m.is_fitted and got == {t: e for t, _, e in rows}


def test_large_clusters_are_split_as_small_ones(spark):
    import random

    from clonemesh.operators import refine

    r = random.Random(3)
    rows = [(f"t{i:03}", c, r.choice("AG") + a * r.randint(4, 6) + r.choice("XKF")) for c, kinds in (("c1", "DW"), ("c2", "D"), ("c3", "LKQ")) for a in kinds for i in r.sample(range(1000), 40)]
    rows = [(f"{c}{t}{i}", c, s) for i, (t, c, s) in enumerate(rows)] + [("c1z", "c1", None), ("c1y", "c1", "")]
    d = spark.createDataFrame(rows, "tcr_id string, cluster_id string, cdr3_beta string").repartition(5)
    key = lambda m: sorted(map(tuple, m.select("tcr_id", "cluster_id").collect()))
    m, t = d.select("cluster_id", "tcr_id"), d.select("tcr_id", "cdr3_beta")
    small, large = (key(refine.motif_split(m, t, kl=0.5, gain=0.02, most=most)) for most in (1000, 10))
    assert small == large and {"c1_m0", "c1_m1"} <= {c for _, c in small}


def test_hierarchical_clusters_take_all_sequences(spark):
    import pytest

    from clonemesh import catalog
    from clonemesh.operators import simjoin

    sf = "/root/testdata/sf0.01"
    seqs = sorted(x.cdr3_beta for x in catalog.tcr(spark, sf).select("cdr3_beta").distinct().collect())
    got = {x.cdr3_beta for x in catalog.hierarchical_clusters(spark, sf).collect()}
    assert got & set(seqs[200:]) and max(got) > seqs[-50]
    with pytest.raises(ValueError):
        simjoin.all_distances(spark.createDataFrame([(x,) for x in seqs], "seq string"), 100)


def test_all_labels_are_left_out_and_the_benchmark_has_them(spark, monkeypatch, tmp_path):
    from clonemesh.plans import benchmark

    monkeypatch.setattr(benchmark, "run_dataset", lambda *a, **k: (type("R", (), {"edges": None}), spark.createDataFrame([(1.0,)], "x double")))
    for f in ("noise_stress", "ablation", "tradeoff"):
        monkeypatch.setattr(benchmark, f, lambda *a, **k: spark.createDataFrame([(1.0,)], "x double"))
    labels = spark.createDataFrame([(f"t{i}", f"e{i // 2}") for i in range(121)], "tcr_id string, epitope string")
    tcr = labels.select("tcr_id")
    assert {x.left_out for x in benchmark.leave_one_label_out(None, tcr, labels).collect()} == {f"e{i}" for i in range(60)}
    few = labels.where("epitope in ('e0', 'e1', 'e2')")
    found = benchmark.full_benchmark(None, tcr, few, str(tmp_path), sets={"a": tcr, "b": tcr})
    assert found["leave_one_label_out"].count() == 3 and found["leave_one_dataset_out"].count() == 4


def test_made_ids_are_dense_and_distinct(spark):
    d = spark.createDataFrame([(f"CAS{i}F",) for i in range(400)], "cdr3_beta string").repartition(4)
    ids = sorted(r.tcr_id for r in preprocess.normalize(d).collect())
    assert ids == [f"tcr_{i:06d}" for i in range(400)]
    far = spark.createDataFrame([(1 << 33, "CASF"), ((1 << 33) + 1, "CASY")], "ord long, cdr3_beta string")
    assert {r.tcr_id for r in preprocess.normalize(far).collect()} == {"tcr_8589934592", "tcr_8589934593"}
    got = preprocess.sequential_ids(far, 999_999)
    assert sorted(r.tcr_id for r in got.collect()) == ["tcr_1000000", "tcr_999999"]


def test_clusters_beyond_four_digits(spark):
    m = spark.range(12_000).selectExpr("format_string('t%05d', id) as cluster_id", "format_string('t%05d', id) as tcr_id")
    got = {r.tcr_id: r.cluster_id for r in graph.numbered(m).collect()}
    assert len(set(got.values())) == 12_000 and got["t00000"] == "cons_0000" and got["t11999"] == "cons_11999"


def test_chains_and_hubs_contract(spark):
    e = [(5, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1100)]
    u = spark.createDataFrame(e, "u long, v long")
    assert {x.node: x.root for x in graph.contract(u).collect()} == graph._union_find(*zip(*e))


def test_unknown_methods_and_objectives():
    w = weights.empirical_weights(["gliph2", "new"])
    assert w["new"] == pytest.approx(0.28 / (0.28 + 0.4 * 0.196 + 0.1 * 0.458 + 0.3 * 0.89 + 0.1 * 0.22 + 0.1 * 0.8))
    assert planner.select_methods(DatasetProfile(), "paired_chain_analysis").selected_methods


def test_records_are_streamed(spark):
    rows = [("a", "CASF", " ", "3", None), (None, "nan", "x", "bad", "0.5")]
    got = list(preprocess.to_records(spark.createDataFrame(rows, "tcr_id string, cdr3_beta string, epitope string, count string, frequency string")))
    assert [(r["tcr_id"], r["cdr3_beta"], r["epitope"], r["count"], r["frequency"], r["chain_mode"].value) for r in got] == [("a", "CASF", None, 3, None, "beta_only"), ("", None, "x", 1, 0.5, "beta_only")]
    assert list(got[0]) == [f.name for f in preprocess.CANONICAL]
