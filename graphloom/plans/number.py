"""Global numbers without a single task: ranges, counts of the ranges, places inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut

_PLACE = 33  # bits of monotonically_increasing_id below the partition's number


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """`df` with `name`: 0-based places by `order`, dense; ties in any order.

    Rows are dealt by ranges of the order and sorted there; the ordered table is written once. Only
    one count for each partition reaches the driver, and comes back as a map of as many entries.
    """
    place = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _PLACE)
    counts = sorted(tuple(r) for r in place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, at = [], 0
    for p, n in counts:
        starts += [F.lit(p), F.lit(at)]
        at += n
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return place.withColumn(name, (start + F.col("_place").bitwiseAND(F.lit((1 << _PLACE) - 1))).cast("long")).drop("_place")
