"""Receptor tables in the common tabular formats, label files, and outputs of outside tools."""

from __future__ import annotations

import csv
import io
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import blank_to_null
from ..operators.preprocess import NULLS, clean_cdr3, dedup, dense_order, extract_metadata, filter_chain, filter_score, normalize, with_order

# Columns of each source format and the canonical columns they become.
BASIC_MAPS = {
    "airr": {"sequence_id": "tcr_id", "cdr3": "cdr3_beta", "v_call": "v_beta", "j_call": "j_beta", "clone_count": "count", "clone_frequency": "frequency"},
    "vdjdb": {"CDR3": "cdr3_beta", "V": "v_beta", "J": "j_beta", "Epitope": "epitope", "MHC": "hla", "Species": "subject_id"},
    "custom": {"cdr3": "cdr3_beta", "v_gene": "v_beta", "j_gene": "j_beta", "subject": "subject_id"},
}
FULL_MAPS = {
    "vdjdb": {"CDR3": "cdr3_beta", "V": "v_beta", "J": "j_beta", "Gene": "_gene", "Score": "_score", "Epitope": "epitope", "Epitope gene": "epitope_gene", "Epitope species": "epitope_species", "MHC A": "hla", "MHC B": "mhc_b", "MHC class": "mhc_class", "Species": "species", "Reference": "reference", "Method": "ident_method", "Meta": "_meta", "CDR3fix": "_cdr3fix"},
    "mcpas": {"CDR3.beta.aa": "cdr3_beta", "CDR3.alpha.aa": "cdr3_alpha", "TRBV": "v_beta", "TRBJ": "j_beta", "TRAV": "v_alpha", "TRAJ": "j_alpha", "TRBD": "d_beta", "Species": "species", "Category": "category", "Pathology": "pathology", "Epitope.peptide": "epitope", "Epitope.ID": "epitope_id", "MHC": "hla", "Tissue": "tissue", "T.Cell.Type": "cell_type", "Antigen.protein": "antigen_protein", "Protein.ID": "protein_id", "PubMed.ID": "subject_id", "Antigen.identification.method": "ident_method"},
    "airr": {"sequence_id": "tcr_id", "cdr3": "cdr3_beta", "cdr3_aa": "cdr3_beta", "v_call": "v_beta", "j_call": "j_beta", "d_call": "d_beta", "clone_count": "count", "clone_frequency": "frequency", "locus": "_locus", "productive": "_productive", "sequence_alignment": "_seq_alignment"},
    "10x": {"barcode": "tcr_id", "cdr3": "cdr3_beta", "cdr3s_aa": "cdr3_beta", "v_gene": "v_beta", "j_gene": "j_beta", "d_gene": "d_beta", "chain": "_chain", "clono_id": "_clono_id", "raw_clono_id": "_raw_clono_id", "freq": "frequency"},
}
# Canonical column -> other names it goes by in files of no known format.
ALIASES = {
    "cdr3_beta": ("cdr3", "cdr3b", "junction_aa", "junctionaa", "amino_acid"),
    "cdr3_alpha": ("cdr3a",),
    "v_beta": ("v_gene", "v_call", "vseg", "trbv"),
    "j_beta": ("j_gene", "j_call", "jseg", "trbj"),
    "v_alpha": ("tra_v_call", "trav"),
    "j_alpha": ("tra_j_call", "traj"),
    "epitope": ("epitope_peptide", "epitope_peptid", "antigen", "epitope.aa"),
    "hla": ("mhc", "mhc_a"),
    "subject_id": ("subject", "donor", "patient", "pubmed_id"),
    "species": (), "count": (), "frequency": (),
}


def detect_columns(columns: list[str]) -> str:
    """vdjdb, mcpas, airr, 10x or custom, by which columns there are."""
    have = {c.lower() for c in columns}
    if {"gene", "cdr3", "v", "j", "score"} <= have:
        return "vdjdb"
    if "cdr3.beta.aa" in have or {"trbv", "pathology"} <= have:
        return "mcpas"
    if {"sequence_id", "v_call"} <= have:
        return "airr"
    return "10x" if {"barcode", "chain"} <= have else "custom"


def detect_basic(columns: list[str]) -> str:
    """airr, vdjdb or custom, as the short readers tell them apart."""
    have = {c.lower() for c in columns}
    if {"sequence_id", "cdr3"} <= have:
        return "airr"
    return "vdjdb" if {"cdr3", "epitope"} <= have else "custom"


def header(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """Column names and separator of a text table, from its first line."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip("﻿") if first else ""
    sep = max("\t,;|", key=line.count)
    sep = sep if line.count(sep) else "\t"
    return next(csv.reader(io.StringIO(line), delimiter=sep), []), sep


def detect_format(spark: SparkSession, path: str, full: bool = False) -> str:
    columns, _ = header(spark, path)
    return (detect_columns if full else detect_basic)(columns)


def read_text_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as texts, with ``ord``."""
    sep = sep or header(spark, path)[1]
    return with_order(spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding=encoding, escape='"', multiLine=False))


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def apply_map(df: DataFrame, mapping: dict[str, str], fold_case: bool = True) -> DataFrame:
    """Rename columns; where several become one, the first that is set counts."""
    want = {k.lower(): v for k, v in mapping.items()} if fold_case else mapping
    to: dict[str, list[str]] = {}
    for c in df.columns:
        to.setdefault(want.get(c.lower() if fold_case else c, c), []).append(c)
    return df.select(*(reduce(lambda a, b: F.coalesce(a, b), (F.when(F.trim(_q(c).cast("string")) != "", _q(c)) if len(cs) > 1 else _q(c) for c in cs)).alias(name) for name, cs in to.items()))


def aliases() -> dict[str, str]:
    return {a: name for name, others in ALIASES.items() for a in (name, *others)}


def read_tcr(spark: SparkSession, path: str, fmt: str = "auto", column_map: dict | None = None, empty_as_null: bool = True) -> DataFrame:
    """The canonical table of a file: detect, read, rename, normalise."""
    columns, sep = header(spark, path)
    fmt = detect_basic(columns) if fmt == "auto" else fmt
    if fmt not in BASIC_MAPS:
        raise ValueError(f"unknown format {fmt}")
    df = read_text_table(spark, path, "\t" if fmt != "custom" and sep == "\t" else sep)
    df = apply_map(df, column_map or BASIC_MAPS[fmt])
    if "tcr_id" not in df.columns:  # ids are made from the rows' places
        df = dense_order(df.drop("ord"))
    return normalize(df, empty_as_null=empty_as_null)


def load_airr(spark: SparkSession, path: str) -> DataFrame:
    return apply_map(read_text_table(spark, path, "\t"), BASIC_MAPS["airr"])


def load_vdjdb(spark: SparkSession, path: str) -> DataFrame:
    return apply_map(read_text_table(spark, path, "\t"), BASIC_MAPS["vdjdb"])


def load_custom(spark: SparkSession, path: str, column_map: dict | None = None, sep: str | None = None) -> DataFrame:
    return apply_map(read_text_table(spark, path, sep), column_map or BASIC_MAPS["custom"])


def map_columns(df: DataFrame, fmt: str = "auto") -> DataFrame:
    """Columns renamed by their format's full map, or by aliases for none."""
    fmt = detect_columns(df.columns) if fmt == "auto" else fmt
    return apply_map(df, FULL_MAPS.get(fmt) or aliases())


def preprocess(source: DataFrame | str, spark: SparkSession | None = None, fmt: str = "auto", gene: str | None = None, min_score: float = 0, do_dedup: bool = True, strategy: str = "keep_first", by: tuple[str, ...] = ("cdr3_beta", "v_beta"), clean: bool = True, json_columns: tuple[str, ...] = ()) -> DataFrame:
    """Load, map, filter by chain and score, clean, deduplicate, extract, normalise."""
    df = read_text_table(spark, source) if isinstance(source, str) else with_order(source)
    if isinstance(source, str) and "tcr_id" not in map_columns(df, fmt).columns:
        df = dense_order(df.drop("ord"))
    df = df.select(*(blank_to_null(_q(c), NULLS[:4]).alias(c) if c != "ord" else _q(c) for c in df.columns))
    df = map_columns(df, fmt).transform(filter_chain, gene).transform(filter_score, min_score)
    df = clean_cdr3(df) if clean else df
    df = dedup(df, by, strategy) if do_dedup else df
    return normalize(extract_metadata(df, json_columns=json_columns), keep_extra=True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    df = read_text_table(spark, path, "\t")
    return df.select("tcr_id", "epitope")


def read_pooled(spark: SparkSession, path: str) -> DataFrame:
    """A pooled database in Latin-1 with NA for missing values."""
    df = read_text_table(spark, path, "\t", "ISO-8859-1")
    return df.select(*(F.when(~_q(c).cast("string").isin("", "NA"), _q(c)).alias(c) if c != "ord" else _q(c) for c in df.columns))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return with_order(spark.read.text(path))


def read_giana(spark: SparkSession, path: str) -> DataFrame:
    """(cdr3, cluster): tab-separated lines, ## comments; of a CDR3's lines the last counts."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).where("not startswith(value, '##')").where(F.size(parts) >= 2)
    return rows.groupBy(parts[0].alias("cdr3")).agg(F.max_by(parts[1], "ord").alias("cluster"))


def read_gliph2(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, cdr3): blank-separated lines of p-value, ?, size, type, members; lines of
    type single are dropped and the others numbered."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.size(parts) >= 5).where(parts[3] != "single").select("ord", parts.alias("p"))
    return rows.select(F.concat(F.lit("gliph2_"), F.col("ord").cast("string")).alias("cluster"), F.explode(F.expr("slice(p, 5, size(p))")).alias("cdr3"))


def read_tcrmatch(spark: SparkSession, path: str) -> DataFrame:
    """(query, match, score, receptor_group, epitope): header skipped, bad scores 0."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).where(F.size(parts) >= 3).where(~F.lower("value").startswith("trimmed_input"))
    return rows.select(parts[0].alias("query"), parts[1].alias("match"), F.coalesce(parts[2].try_cast("double"), F.lit(0.0)).alias("score"), F.try_element_at(parts, F.lit(4)).alias("receptor_group"), F.try_element_at(parts, F.lit(5)).alias("epitope"))


def expand_clusters(clusters: DataFrame, members: DataFrame, method: str, key: str = "cdr3") -> DataFrame:
    """Assignments from clusters of sequences: ``members`` has (key, tcr_id)."""
    got = clusters.join(members, key).select("cluster", "tcr_id").distinct()
    return got.select(F.lit(method).alias("method"), "tcr_id", F.concat(F.lit(f"{method}_"), F.col("cluster").cast("string")).alias("cluster_id"), F.lit(1.0).alias("membership_score"))


def unmatched(clusters: DataFrame, members: DataFrame, key: str = "cdr3") -> DataFrame:
    return clusters.join(members.select(key).distinct(), key, "left_anti")


def exists(path: str) -> bool:
    return os.path.exists(path)
