"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut, drop  # noqa: F401

#: ASCII white space as a character class body: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Arrow batches of texts have about so many bytes at most.
ARROW_BYTES = 1 << 22


def released(f):
    """`f`, after which a worker hands back the free memory that Arrow's pool and the C library hold:
    workers live on, and what each stage of a pipeline left there would add up."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return run


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """`mapInArrow` with a bound on the bytes of a batch, as rows alone say nothing where texts are
    long. It is set on the session, unless that has a lower one."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(released(f), schema)
