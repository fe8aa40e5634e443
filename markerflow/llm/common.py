"""Helpers shared by the corpus operators: staging in the shared folder, word classes, byte columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_SPACE = r"[^ \t-\r]+"

_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset one is made and set on a local master, which
    has no other machine; elsewhere that is an error, as every executor would write to a disk of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="markerflow-")
        spark.sparkContext.setCheckpointDir(f"file://{path}")
        path = spark.sparkContext.getCheckpointDir()
    return path


@contextlib.contextmanager
def sweeping(spark: SparkSession):
    """Actions inside delete the files of their shuffles when they end: what they computed is staged, and nothing reads those again."""
    before = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SWEEP, before)


def _at(df_or_spark, path: str):
    """(file system, path) in the JVM."""
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, so a lost executor
    costs a re-read and not a recomputation. The table goes when it is unstaged, and at the latest when the driver ends, as a lazy
    result may need it until then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    with sweeping(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    fs, at = _at(df, df._staged)
    fs.delete(at, True)
    fs.cancelDeleteOnExit(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is merged, for tables with a row for each text, node or batch. Staged tables are small as files, a row of numbers a
    few bytes, so Spark would broadcast millions of their rows, which the driver builds."""
    return df.hint("merge")


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text column, null as no bytes."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def partitions(spark: SparkSession, least: int = 8) -> int:
    """How many key ranges an exchange of runs is dealt to: the session's shuffle partitions, which the cluster
    sets in proportion to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_training(doc_id: Column) -> Column:
    """True for rows from which labels may be learnt: crc32 of the id's text modulo 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))
