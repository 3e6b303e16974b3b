"""Tables in the folder that all executors share, used to cut lineage in iterative plans."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only where the session names none and its master is local, as in tests, a temporary
    folder is set; on a cluster that folder would be another one on each machine, so there a
    session without the setting is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clonemesh-"))
        base = jsc.getCheckpointDir().get()
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's file systems close."""
    path = f"{shared_dir(spark)}/clonemesh/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file on whatever file system the path is of."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def make_dirs(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path below ``path``, bytes) of the files there, sorted, checksum files left out."""
    fs, p = _hadoop(spark, path)
    top, found, it = fs.makeQualified(p).toString().rstrip("/") + "/", [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString().removeprefix(top)
        if not name.endswith(".crc"):
            found.append((name, f.getLen()))
    return sorted(found)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here, any executor
    can be lost afterwards, and the shuffle files that made the table go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, was) if was is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out.clonemesh_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that :func:`written` made."""
    for t in tables:
        drop_path(spark, t.clonemesh_path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, and let the JVM drop what no plan holds."""
    drop(spark, *tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
