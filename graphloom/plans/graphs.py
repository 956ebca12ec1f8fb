"""Graphs derived from the relational tables, as DataFrames and as SQL for other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import KnowledgeGraph


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def handoff(spark: SparkSession, sf_dir: str, where: str = "true") -> KnowledgeGraph:
    """user -event_type-> the user of the next event of that type."""
    e = read(spark, sf_dir, "events").where(where)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    nxt = F.lead("user_id").over(w)
    t = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("predicate"), nxt.cast("string").alias("object"), (F.col("event_id") % 10 / 10).cast("float").alias("confidence"))
    return KnowledgeGraph.of(t.where(F.col("object").isNotNull()))


def handoff_sql(where: str = "true") -> str:
    """CTE body with the columns seq, s, p, o."""
    return f"""SELECT event_id AS seq, user_id::VARCHAR AS s, event_type AS p, o::VARCHAR AS o FROM (
      SELECT event_id, user_id, event_type, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS o FROM events WHERE {where}) WHERE o IS NOT NULL"""


#: (predicate, SQL of seq / s / o over one table); the same text serves Spark and DuckDB.
TPCH = {
    "in_region": ("nation", "n_nationkey", "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)"),
    "supplier_in": ("supplier", "s_suppkey", "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)"),
    "customer_in": ("customer", "c_custkey", "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)"),
    "placed_by": ("orders", "o_orderkey", "concat('order:', o_orderkey)", "concat('customer:', o_custkey)"),
    "contains": ("lineitem", "l_orderkey * 16 + l_linenumber", "concat('order:', l_orderkey)", "concat('part:', l_partkey)"),
    "supplies": ("lineitem", "l_orderkey * 16 + l_linenumber", "concat('supplier:', l_suppkey)", "concat('part:', l_partkey)"),
}
PLACE = 1 << 50


def tpch(spark: SparkSession, sf_dir: str, predicates: list[str] | None = None) -> KnowledgeGraph:
    out = None
    for k, (p, (table, seq, s, o)) in enumerate(TPCH.items()):
        if predicates is not None and p not in predicates:
            continue
        part = read(spark, sf_dir, table).select(F.expr(f"CAST({seq} AS BIGINT) + {k * PLACE}L").alias("seq"), F.expr(s).alias("subject"), F.lit(p).alias("predicate"), F.expr(o).alias("object"))
        out = part if out is None else out.unionByName(part)
    return KnowledgeGraph.of(out)


def tpch_sql(predicates: list[str] | None = None) -> str:
    return " UNION ALL ".join(f"SELECT {seq} + {k * PLACE} AS seq, {s} AS s, '{p}' AS p, {o} AS o FROM {table}" for k, (p, (table, seq, s, o)) in enumerate(TPCH.items()) if predicates is None or p in predicates)


def nodes_sql(t: str = "t") -> str:
    """CTE body with id and first_seen of the graph `t`."""
    return f"SELECT id, min(pos) AS first_seen FROM (SELECT s AS id, 2 * seq AS pos FROM {t} UNION ALL SELECT o, 2 * seq + 1 FROM {t}) GROUP BY id"
