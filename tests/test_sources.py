"""Reading, detecting, writing, streaming."""

from __future__ import annotations

import pytest

from clonemesh import cli
from clonemesh.operators import preprocess
from clonemesh.sources import readers, sinks
from clonemesh.streaming import ingest

ROWS = "tcr_id\tcdr3_beta\tv_beta\tj_beta\tepitope\tcount\nt1\t CASSF \tTRBV1\tTRBJ1-1\tE\t2\nt2\tCASSYF\tTRBV1\tTRBJ1-1\t\tx\nt3\t\tTRBV2\tTRBJ1-1\tE\t1\n"


@pytest.fixture
def tsv(tmp_path):
    (tmp_path / "a.tsv").write_text(ROWS)
    return str(tmp_path / "a.tsv")


def test_read_and_normalise(spark, tsv):
    d = readers.read_tcr(spark, tsv)
    assert [r.tcr_id for r in d.orderBy("tcr_id").collect()] == ["t1", "t2"]
    r = d.where("tcr_id = 't2'").first()
    assert r["count"] == 1 and r.epitope is None and r.chain_mode == "beta_only"


def test_detection(spark, tsv, tmp_path):
    assert readers.detect_format(spark, tsv) == "custom"
    assert readers.detect_columns(["Gene", "CDR3", "V", "J", "Score"]) == "vdjdb"
    assert readers.detect_columns(["TRBV", "Pathology"]) == "mcpas"
    assert readers.detect_columns(["sequence_id", "v_call"]) == "airr"
    assert readers.detect_columns(["barcode", "chain"]) == "10x"
    (tmp_path / "b.tsv").write_text("sequence_id\tcdr3\tv_call\tj_call\ns1\tCASSF\tTRBV1\tTRBJ1\n")
    assert readers.detect_format(spark, str(tmp_path / "b.tsv")) == "airr"
    assert readers.read_tcr(spark, str(tmp_path / "b.tsv")).first().v_beta == "TRBV1"
    with pytest.raises(ValueError):
        readers.read_tcr(spark, tsv, "other")


def test_generated_ids_and_names(spark):
    d = spark.createDataFrame([("CASSF",), ("CASSYF",)], "cdr3 string")
    n = preprocess.normalize(readers.apply_map(d, readers.aliases()))
    assert n.columns[:4] == ["tcr_id", "chain_mode", "cdr3_alpha", "cdr3_beta"]
    assert all(r.tcr_id.startswith("tcr_") for r in n.collect())


def test_metadata_and_dedup_flag(spark):
    d = spark.createDataFrame([("CASSF", '{"subject.id": "s1", "tissue": null}'), ("CASSF", "bad")], "cdr3_beta string, _meta string")
    rows = preprocess.extract_metadata(d).collect()
    assert rows[0].subject_id == "s1" and rows[0].tissue == "" and rows[1].subject_id == ""
    assert readers.preprocess(d, do_dedup=False).count() == 2
    assert readers.preprocess(d).count() == 1


def test_outside_outputs(spark, tmp_path):
    (tmp_path / "g.txt").write_text("##c\nCAF\t1\nCAF\t2\nCDF\t2\n")
    assert {(r.cdr3, r.cluster) for r in readers.read_giana(spark, str(tmp_path / "g.txt")).collect()} == {("CAF", "2"), ("CDF", "2")}
    (tmp_path / "h.txt").write_text("0.1 1 2 motif CAF CDF\n0.2 1 1 single CAF\n")
    assert sorted(r.cdr3 for r in readers.read_gliph2(spark, str(tmp_path / "h.txt")).collect()) == ["CAF", "CDF"]
    (tmp_path / "m.txt").write_text("trimmed_input_sequence\tmatch\tscore\tgroup\tepitope\nAS\tAS\t?\tg1\tE\nAS\tAT\t0.9\tg2\tE\n")
    got = readers.read_tcrmatch(spark, str(tmp_path / "m.txt")).orderBy("score").collect()
    assert [r.score for r in got] == [0.0, 0.9]
    members = spark.createDataFrame([("CAF", "t1"), ("CAF", "t2")], "cdr3 string, tcr_id string")
    clusters = readers.read_giana(spark, str(tmp_path / "g.txt"))
    assert readers.expand_clusters(clusters, members, "giana").count() == 2
    assert readers.unmatched(clusters, members).count() == 1


def test_sinks(spark, tmp_path):
    d = sinks.ensure_run_dir(str(tmp_path), "r")
    t = spark.createDataFrame([("c", ["a", "b"])], "cluster_id string, member_ids array<string>")
    assert spark.read.csv(sinks.write_clusters(t, d), sep="\t", header=True).first().member_ids == "a,b"
    sinks.write_manifest(d)


def test_cli(spark, tsv, tmp_path, capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--help"])
    assert e.value.code == 0
    assert cli.main(["profile", tsv]) == 0
    assert '"n_tcrs": 2' in capsys.readouterr().out


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("CASSF", "V1", "2024-01-01 00:00:00"), ("CASSYF", "V1", "2024-01-01 00:01:00"), ("cassf", "V1", "2024-01-01 00:02:00"), ("CAS*", "V1", "2024-01-01 00:03:00")]
    schema = "cdr3_beta string, v_beta string, ts string"
    spark.createDataFrame(rows[:2], schema).selectExpr("cdr3_beta", "v_beta", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("cdr3_beta string, v_beta string, ts timestamp").parquet(str(src))
    base, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = ingest.start(read(), base, ck)
    q.awaitTermination(120)
    more = [*rows[2:], ("CATSF", "V1", "2024-01-01 00:04:00")]
    spark.createDataFrame(more, schema).selectExpr("cdr3_beta", "v_beta", "cast(ts as timestamp) ts").coalesce(1).write.mode("append").parquet(str(src))
    ingest.start(read(), base, ck).awaitTermination(120)
    got = {(r.a, r.b) for r in ingest.EdgeSink(base).read(spark).collect()}
    assert got == {("CASSF", "CASSYF"), ("CASSF", "CATSF")}
