"""Receptor tables derived from the driver's ``part`` table, in SQL that Spark and DuckDB read
alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TCR = """SELECT concat('tcr_', lpad(cast(p_partkey AS varchar(10)), 6, '0')) AS tcr_id, p_partkey AS ord, 'beta_only' AS chain_mode,
 concat('CAS', translate(substr(md5(p_name),1,3), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'),
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE substr('ACDEFGHIKLMNPQRSTVWY', 1 + p_size % 20, 1) END,
  translate(substr(md5(p_name),4,3), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 'QYF') AS cdr3_beta,
 CASE WHEN p_partkey % 3 = 0 THEN concat('CAV', translate(substr(md5(p_brand),1,5), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 'LTF') END AS cdr3_alpha,
 CASE WHEN p_partkey % 3 = 0 THEN concat('TRAV', cast(1 + p_size % 9 AS varchar(10))) END AS v_alpha,
 CASE WHEN p_partkey % 3 = 0 THEN concat('TRAJ', cast(1 + p_size % 7 AS varchar(10))) END AS j_alpha,
 concat('TRBV', regexp_extract(p_brand, '([0-9]+)', 1)) AS v_beta,
 concat('TRBJ', cast(1 + p_size % 2 AS varchar(10)), '-', cast(1 + p_partkey % 7 AS varchar(10))) AS j_beta,
 CASE WHEN p_partkey % 10 = 0 THEN p_type ELSE substr(p_name, 1, position(' ' IN p_name) - 1) END AS epitope,
 concat('S', cast(p_partkey % 5 AS varchar(10))) AS subject_id, CAST(1 + p_size % 10 AS BIGINT) AS count
FROM part"""
#: Raw rows with blanks, lower case, bad letters and bad numbers.
RAW = f"""SELECT tcr_id, ord, concat(' ', CASE WHEN ord % 11 = 0 THEN '' WHEN ord % 13 = 0 THEN lower(cdr3_beta) WHEN ord % 17 = 0 THEN concat(cdr3_beta, '*')
  WHEN ord % 19 = 0 THEN 'CAF' WHEN ord % 23 = 0 THEN substr(cdr3_beta, 2) ELSE cdr3_beta END, ' ') AS cdr3_beta, v_beta, j_beta,
 CASE WHEN ord % 8 = 0 THEN 'n/k' ELSE cast(count AS varchar(10)) END AS count, CASE WHEN ord % 6 = 0 THEN 'x' ELSE cast(ord % 100 AS varchar(10)) END AS score,
 CASE WHEN ord % 4 = 0 THEN 'TRA' ELSE 'trb' END AS gene, CASE WHEN ord % 9 = 0 THEN '' ELSE epitope END AS epitope FROM ({TCR}) t"""
ASSIGN = f"""SELECT 'clonotype' AS method, tcr_id, cdr3_beta AS cluster_id, ord FROM ({TCR}) t
 UNION ALL SELECT 'vj', tcr_id, concat(v_beta, '|', j_beta), ord FROM ({TCR}) t
 UNION ALL SELECT 'prefix7', tcr_id, substr(cdr3_beta, 1, 7), ord FROM ({TCR}) t"""
WEIGHTS = {"clonotype": 1.2, "vj": 0.7, "prefix7": 1.1}


#: Rows of ``part`` that a task derives receptors from; a file of few row groups is dealt out.
TASK_ROWS = 50_000


def _dealt(part: DataFrame) -> DataFrame:
    n = min(-(-part.count() // TASK_ROWS), 4 * part.sparkSession.sparkContext.defaultParallelism)
    return part.repartition(n, "p_partkey") if n > part.rdd.getNumPartitions() else part


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    part = _dealt(spark.read.parquet(f"{sf_dir}/part.parquet"))
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=part)


def tcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TCR)


def assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ASSIGN)


def keyed(d: DataFrame) -> DataFrame:
    """``d`` with an own tcr_id for each row of ``part``, in the same order: :data:`TCR` cuts keys
    from a million on to six digits, so rows then share ids."""
    return d.withColumn("tcr_id", F.concat("tcr_id", F.format_string("#%012d", "ord")))


def named(c: str) -> Column:
    """The id that :func:`keyed` was given."""
    return F.substring_index(c, "#", 1).alias(c)
