"""What the operators of this subpackage share: batch sizes for Arrow exchange, small input
helpers, and the library's tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop, new_path, release, written

__all__ = ["arrow_batches", "drop", "new_path", "release", "shuffle_partitions", "table", "text_or_empty", "written"]

#: Rows of one Arrow batch sent to Python; texts are kilobytes on average and may be far longer.
ARROW_ROWS = 512


def arrow_batches(spark: SparkSession) -> None:
    """Bound the rows that Python workers get at once. Results are lazy, so the bound has to
    outlast the call: it is one for all operators, and a session that has a bound of its own
    keeps it if that is smaller."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
