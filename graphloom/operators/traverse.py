"""Paths and neighbourhoods by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..plans.cut import cut
from ..plans.iterate import observed


def find_path(graph: KnowledgeGraph, a: str, b: str) -> DataFrame | None:
    """The triples of the shortest directed path a -> b, by `hop`; None if there is none.

    Two searches, forward from a and backward from b, grow a whole level at a time, always the one
    whose last level is smaller, until a level meets the other side. Of the forward levels only what
    leads to the meeting is kept. The path goes forward from a, always to the first-seen neighbour
    that is one level nearer to b. That is the path whose nodes come first by first appearance; of
    parallel triples the first is taken. Only the path's own nodes (one a level) come to the driver.
    """
    ids = cut(graph.entities().select("id", "first_seen"))
    if ids.where(F.col("id").isin([a, b])).count() < (1 if a == b else 2):
        return None
    if a == b:
        return graph.triples.limit(0).withColumn("hop", F.lit(0))
    edges = cut(graph.directed())
    sides = {}
    for side, end in (("ahead", a), ("back", b)):
        first = cut(ids.where(F.col("id") == end).select("id"))
        sides[side] = {"levels": [first], "seen": first, "size": 1}
    while True:
        side = min(("ahead", "back"), key=lambda s: sides[s]["size"])
        own, other = sides[side], sides["back" if side == "ahead" else "ahead"]
        at, to = ("src", "dst") if side == "ahead" else ("dst", "src")
        out = edges.join(own["levels"][-1].withColumnRenamed("id", at), at, "left_semi").select(F.col(to).alias("id")).distinct()
        level, m = observed(out.join(own["seen"], "id", "left_anti"), n=F.count(F.lit(1)))
        if not m["n"]:
            return None
        own["levels"].append(level)
        own["seen"], own["size"] = own["seen"].union(level), m["n"]
        # whole levels on both sides: the first meeting is with the other side's last level
        meet = cut(level.join(other["levels"][-1], "id", "left_semi"))
        if not meet.isEmpty():
            break
    nearer = [meet]
    for level in reversed(sides["ahead"]["levels"][1:-1]):
        on = edges.join(nearer[0].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        nearer.insert(0, cut(level.join(on, "id", "left_semi")))
    if len(sides["ahead"]["levels"]) == 1:
        nearer = []
    nearer += list(reversed(sides["back"]["levels"][:-1]))
    nodes = [a]
    for level in nearer:
        out = edges.where(F.col("src") == nodes[-1]).select(F.col("dst").alias("id"))
        nodes.append(out.join(level, "id").join(ids, "id").agg(F.min_by("id", "first_seen")).first()[0])
    hops = list(zip(range(len(nodes) - 1), nodes[:-1], nodes[1:], strict=True))
    wanted = graph.triples.sparkSession.createDataFrame(hops, "hop int, subject string, object string")
    first = Window.partitionBy("hop").orderBy("seq")
    found = graph.triples.join(F.broadcast(wanted), ["subject", "object"]).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return found.select(*graph.triples.columns, "hop").orderBy("hop")


def subgraph_around(graph: KnowledgeGraph, entity_id: str, depth: int) -> KnowledgeGraph:
    """All triples whose ends lie within `depth` undirected hops of the entity."""
    near = graph.entities().where(F.col("id") == entity_id).select("id")
    edges = graph.undirected()
    for _ in range(depth):
        step = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        near = cut(near.union(step).distinct())
    t = graph.triples
    t = t.join(near.withColumnRenamed("id", "subject"), "subject", "left_semi").join(near.withColumnRenamed("id", "object"), "object", "left_semi")
    return KnowledgeGraph(t.select(*graph.triples.columns))
