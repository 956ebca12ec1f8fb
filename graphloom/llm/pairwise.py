"""Texts for pairs of texts, each text once for each block of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that share their `b` are worked on in blocks of about so many.
BLOCK = 128


def blocks_of_pairs(pairs: DataFrame, texts: DataFrame, extra: list[str]) -> DataFrame:
    """Rows (b, part, kind, a, *extra, text), sorted in their partitions by b, part, kind.

    pairs: (a, b, *extra); texts: (id, text). A row of kind 0 has the text of b, the rows of
    kind 1 after it the texts of its partners. A `b` with many partners is split into parts,
    so no task gets all pairs of one text, and b's text goes once to each part.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = left.join(texts.select(F.col("id").alias("a"), "text"), "a").select("b", "part", F.lit(1).alias("kind"), "a", *extra, "text")
    right = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.select(F.col("id").alias("b"), "text"), "b")
    types = dict(pairs.dtypes)
    right = right.select("b", "part", F.lit(0).alias("kind"), *[F.lit(None).cast(types[c]).alias(c) for c in ("a", *extra)], "text")
    return left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
