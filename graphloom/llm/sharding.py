"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Every row gets a global row number without a global sort: rows are counted by their
digest (doc_id, size, crc), digests fall into a fixed number of buckets, and the
running count over buckets plus the running count inside a bucket is the number. A
keyed Feistel network over Z_a x Z_b (a * b just above the row count N) permutes the
numbers; a value that lands at N or above is sent through the network again (cycle
walking) until it falls below N, so the result is a permutation of 0..N-1. The
permuted number p gives the shard p mod n_shards and the slot p div n_shards, which
are gapless within a shard; counts of two shards differ by one at most (law "rows").

Edge cases: a null text has size 16 and a null crc; a null doc_id is a value like
any other; rows equal in doc_id, size and crc are interchangeable and share a run of
consecutive row numbers, counted before the shuffle, so a key with a third of all
rows is one counted digest; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

ROUNDS = 6
#: Modulus of the round function, the Mersenne prime 2**31 - 1.
PRIME = 2147483647
BUCKET_HEX = 3


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """(offset, multiplier) of each round, below PRIME, from the seed."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
        out.append((int.from_bytes(d[:4], "big") % PRIME, int.from_bytes(d[4:8], "big") % (PRIME - 1) + 1))
    return out


def _round(x: Column, key: tuple[int, int], modulus: Column) -> Column:
    y = (x + F.lit(key[0])) % F.lit(PRIME)
    return ((y * y) % F.lit(PRIME) * F.lit(key[1])) % F.lit(PRIME) % modulus


def feistel(p: Column, a: Column, b: Column, keys: list[tuple[int, int]]) -> Column:
    """One pass of the network over [0, a*b): alternate rounds move the left and right half."""
    state = F.struct(((p - p % b) / b).cast("long").alias("l"), (p % b).alias("r"))
    def rounds(i: int, key: tuple[int, int]):
        if i % 2 == 0:
            return lambda s: F.struct(((s["l"] + _round(s["r"], key, a)) % a).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), ((s["r"] + _round(s["l"], key, b)) % b).alias("r"))

    for i, key in enumerate(keys):
        state = let(state, rounds(i, key))
    return let(state, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, row: str, total: str, out: str, seed: int) -> DataFrame:
    """Add `out`, the permuted value of column `row` in [0, total)."""
    keys = round_keys(seed)
    a, b, n = F.col("_a"), F.col("_b"), F.col(total)
    df = df.withColumn("_a", F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long")))
    df = df.withColumn("_b", F.expr(f"greatest(({total} + _a - 1) div _a, 1L)"))
    df = df.withColumn("_l", F.expr(f"{row} div _b")).withColumn("_r", F.expr(f"{row} % _b"))
    for i, key in enumerate(keys):
        if i % 2 == 0:
            df = df.withColumn("_l", (F.col("_l") + _round(F.col("_r"), key, a)) % a)
        else:
            df = df.withColumn("_r", (F.col("_r") + _round(F.col("_l"), key, b)) % b)
    once = F.col("_l") * b + F.col("_r")
    df = df.withColumn("_p", once)
    # a * b - N values lie outside, so no walk is longer than that; only they enter this branch
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(a * b - n, F.lit(1).cast("long"))),
        F.col("_p"),
        lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, keys)),
    )
    df = df.withColumn(out, F.when(F.col("_p") < n, F.col("_p")).otherwise(walk))
    return df.drop("_a", "_b", "_l", "_r", "_p")


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, position, shard, slot), one row per input row."""
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )
    counted = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.coalesce(F.col("text_crc32").cast("string"), F.lit(""))))
    counted = counted.withColumn("bucket", F.conv(F.substring(digest, 1, BUCKET_HEX), 16, 10).cast("int"))
    # at most 16**BUCKET_HEX rows, whatever the input
    buckets = counted.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = buckets.select(
        "bucket",
        (F.sum("in_bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("before"),
        F.sum("in_bucket").over(every).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "size", F.asc_nulls_first("text_crc32")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = counted.withColumn("first", F.sum("copies").over(inside) - F.col("copies")).join(F.broadcast(buckets), "bucket")
    rows = numbered.select("doc_id", "size", "text_crc32", "total", (F.col("before") + F.col("first")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    rows = rows.withColumn("row_number", F.col("start") + F.col("copy"))
    out = permuted(rows, "row_number", "total", "position", seed)
    return out.select(
        "doc_id", "size", "text_crc32", "row_number", "position",
        (F.col("position") % n_shards).cast("int").alias("shard"),
        F.expr(f"position div {n_shards}").alias("slot"),
    )


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _sql_round(x: str, key: tuple[int, int], modulus: str) -> str:
    y = f"(({x} + {key[0]}) % {PRIME})"
    return f"((({y} * {y}) % {PRIME} * {key[1]}) % {PRIME} % {modulus})"


def oracle(n_shards: int = 40, seed: int = 7) -> str:
    """The same rows from DuckDB; crc32 is folded over the bytes with the table of its polynomial."""
    def network(source: str, p: str, tag: str) -> tuple[str, str]:
        steps, prev = [f"{tag}0 AS (SELECT rn, n, a, b, {p} // b AS l, {p} % b AS r FROM {source})"], f"{tag}0"
        for i, key in enumerate(round_keys(seed)):
            l, r = ("l", f"(r + {_sql_round('l', key, 'b')}) % b") if i % 2 else (f"(l + {_sql_round('r', key, 'a')}) % a", "r")
            steps.append(f"{tag}{i + 1} AS (SELECT rn, n, a, b, {l} AS l, {r} AS r FROM {prev})")
            prev = f"{tag}{i + 1}"
        return ", ".join(steps), prev

    inner, last = network("walk_in", "p", "w")
    return f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
slim AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 16 AS size,
    CASE WHEN text IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) END AS crc
  FROM documents, tab
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, coalesce(crc::VARCHAR, ''))), 1, {BUCKET_HEX}))::INT,
      doc_id NULLS FIRST, size, crc NULLS FIRST) - 1 AS rn, count(*) OVER () AS n
  FROM slim
), sided AS (SELECT *, greatest(ceil(sqrt(n::DOUBLE))::BIGINT, 1) AS a FROM numbered),
boxed AS (SELECT *, greatest((n + a - 1) // a, 1) AS b FROM sided),
walk(rn, n, a, b, p, k) AS (
  SELECT rn, n, a, b, rn::BIGINT, 0 FROM boxed
  UNION ALL
  (WITH walk_in AS (SELECT * FROM walk WHERE k = 0 OR p >= n), {inner}
   SELECT rn, n, a, b, l * b + r, 1 FROM {last})
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (p % {n_shards})::INT AS shard, (p // {n_shards})::BIGINT AS slot,
  NULL::INT AS grown_shard, x.rn::BIGINT AS row_number
FROM boxed x JOIN walk w ON x.rn = w.rn WHERE w.k = 1 AND w.p < w.n
"""
