"""Connected components of an edge table, by hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut, drop
from .iterate import observed


def components(edges: DataFrame, trace: list[int] | None = None) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); label is the least node of its component.

    In a round every node hooks to its least neighbour, unless it is below all of them; chains of hooks
    are halved by pointer jumping until each node points at its root. Then links are set between
    roots, once each, and those within a tree are gone. At least half of the nodes with a link hook, so what is left
    shrinks with every round (a third is left of a chain under random names) and all links are read in the first round
    only. The component's least node never hooks, so it is the last root; nodes find it through the rounds' tables,
    from the smallest. Only counts reach the driver; `trace` takes the number of nodes that hooked in each round.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links, maps = cut(edges.where("a <> b").select(*pair("a", "b")).distinct()), []
    while True:
        both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        least = links.select(F.explode(both).alias("x")).groupBy(F.col("x.node").alias("node")).agg(F.min("x.other").alias("near"))
        up, m = observed(least.select("node", F.least("node", "near").alias("label")), n=F.count(F.lit(1)), hooked=F.count_if(F.col("label") < F.col("node")))
        if not m["n"]:
            drop(links)
            break
        if trace is not None:
            trace.append(m["hooked"])
        while True:
            # labels that point on, a row each: few where many nodes share one
            far = up.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("far")).join(up.select("label").distinct(), "label", "left_semi")
            new, m = observed(up.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")), moved=F.count_if("moved"))
            drop(up)
            up = new.select("node", "label")
            up._cut_path = new._cut_path
            if not m["moved"]:
                break
        maps.append(up)
        root = lambda c: up.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root"))  # noqa: B023, E731
        between = links.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root")
        new = cut(between.select(*pair("a_root", "b_root")).distinct())
        drop(links)
        links = new
    if not maps:
        return cut(edges.limit(0).select(F.col("a").alias("node"), F.col("b").alias("label")))
    state = maps.pop()
    while maps:
        above = state.select(F.col("node").alias("label"), F.col("label").alias("root"))
        lower = maps.pop()
        new = cut(lower.join(above, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        drop(state)
        drop(lower)
        state = new
    return state
