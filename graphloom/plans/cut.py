"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix=f"ckpt-{os.getpid()}-"))
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table and read it back: later plans start there, and a lost executor
    costs no recomputation of what came before."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """`cut` as a bucketed table: joins by the keys read it where it lies, without a shuffle."""
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._cut_path, out._cut_name = path, name
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by `cut` or `dealt` that nothing reads any more."""
    spark = df.sparkSession
    if hasattr(df, "_cut_name"):
        spark.sql(f"DROP TABLE {df._cut_name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing holds any more: it hears of
    them when the driver's garbage is collected, which a loop of small plans may leave for long."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Hold a batch for Python workers at 4 MB, unless the session's bound is lower: rows alone say
    nothing where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > 1 << 22:
        spark.conf.set(key, str(1 << 22))
