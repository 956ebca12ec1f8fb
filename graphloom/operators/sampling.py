"""Random walks and neighbour sampling with hash draws.

A draw is a hash of (seed, round, start, step) or (seed, node, place), so results do not
depend on partitioning. Neighbours keep their multiplicity: parallel triples make a step
likelier.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..plans.cut import cut, dealt, drop, shared_folder
from ..plans.number import numbered


@dataclass(frozen=True)
class RandomWalkConfig:
    walk_length: int = 80
    num_walks: int = 10
    p: float = 1.0
    q: float = 1.0
    seed: int = 42

    def validate(self) -> None:
        for name in ("p", "q"):
            v = getattr(self, name)
            if not (isfinite(v) and v > 0):
                raise ValueError(f"{name} must be finite and above 0")


def _uniform(*parts: Column) -> Column:
    """A draw in [0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") * F.lit(2.0**-53)


def _places(graph: KnowledgeGraph) -> tuple[DataFrame, DataFrame]:
    """((id, first, degree), (place, object, first, degree)): out-neighbours by a number over all
    triples, in insertion order and with multiplicity; a node's are `first` and the `degree` - 1 after.

    Numbers come from ranges of (subject, seq), so a hub's triples lie in many tasks, and a draw is
    a join by its number alone, which no hub makes heavy. A neighbour's own numbers are beside it.
    """
    nbr = numbered(graph.triples.select("subject", "seq", "object"), ["subject", "seq", "object"], "place")
    own = cut(nbr.groupBy(F.col("subject").alias("id")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("degree")))
    return own, nbr.select("place", "object").join(own.withColumnRenamed("id", "object"), "object", "left").select("place", "object", "first", "degree")


def _drawn(u: Column) -> Column:
    """The number of the neighbour that a draw in [0, 1) picks."""
    return F.col("first") + F.least(F.floor(u * F.col("degree")), F.col("degree") - 1)


#: Candidates that a walker draws at once for a weighted step, at most.
TRIES = 16
#: Rows of a part of the neighbours; a task holds as many at once.
PART = 1 << 18


def step_weight(candidate: Column, prev: Column, linked: Column, p: float, q: float) -> Column:
    """The weight of a step: 1/p back, 1 to a neighbour of the last node (`linked`), else 1/q; over the
    largest of the three."""
    top = max(1 / p, 1.0, 1 / q)
    return F.when(candidate == prev, 1 / p / top).when(linked, 1 / top).otherwise(1 / q / top)


def generate_steps(graph: KnowledgeGraph, config: RandomWalkConfig = RandomWalkConfig()) -> DataFrame:
    """(round, start, place, id, first, degree): a row for each node of each walk.

    A step draws a number among the out-neighbours and joins it; a walk ends at a node without
    out-neighbours. The first step is uniform, and so are all if p = q = 1. Otherwise a drawn
    neighbour is taken with its weight as the probability (rejection), where the edge from the last
    node is looked up by a join. Most walkers take their first candidate, so they draw one; those
    that took none draw again, twice as many as before, up to TRIES.

    Neighbours and edges are dealt once by what is looked up in them, so a step shuffles only its
    walkers. A step is a written part of one table and the next step reads only that part, so no plan
    grows with the walks' length and no walk is carried along. Walks are not stitched from halves: halves
    that walks share would tie their draws together, and here all walks are independent.
    """
    config.validate()
    spark = graph.triples.sparkSession
    own, nbr = _places(graph)
    plain = float(config.p) == 1 and float(config.q) == 1
    n = own.agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("n")).first()["n"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART))
    nbr = dealt(nbr, parts, "place")
    edges = None if plain else dealt(graph.directed().select(F.col("src").alias("prev"), F.col("dst").alias("object"), F.lit(True).alias("linked")), parts, "prev", "object")
    rounds = F.sequence(F.lit(0), F.lit(config.num_walks - 1)) if config.num_walks else F.array().cast("array<int>")
    path = f"{shared_folder(spark)}/walks-{uuid.uuid4().hex}"
    state = ["round", "start", "id", "prev", "first", "degree"]
    schema = "round int, start string, id string, prev string, first long, degree long, done boolean"
    part = lambda i: spark.read.schema(f"{schema}, wave int").parquet(f"{path}/place={i}").where("done").select(*state)
    add = lambda df, i, wave=0: df.select(*state, "done").write.parquet(f"{path}/place={i}/wave={wave}")
    who = ["round", "start"]
    # a part of these has PART rows with different keys, so it is what a task holds, whatever walkers come
    there = nbr.select("place", "object", F.col("first").alias("n_first"), F.col("degree").alias("n_degree")).hint("shuffle_hash")
    linked = None if plain else edges.hint("shuffle_hash")
    add(graph.entity_ids().join(own, "id", "left").select(F.explode(rounds).alias("round"), F.col("id").alias("start"), "id", F.lit(None).cast("string").alias("prev"), "first", "degree", F.lit(True).alias("done")), 0)
    for step in range(1, config.walk_length):
        at = part(step - 1).where("degree IS NOT NULL")
        draw = lambda *x: _uniform(F.lit(config.seed) + F.col("round"), F.col("start"), F.lit(step), *x)
        if step == 1 or plain:
            got = at.select(*who, F.col("id").alias("prev"), _drawn(draw()).alias("place")).join(there, "place")
            add(got.select(*who, F.col("object").alias("id"), "prev", F.col("n_first").alias("first"), F.col("n_degree").alias("degree"), F.lit(True).alias("done")), step)
            continue
        waiting, k, tries = at, 0, 1
        while True:
            tried = waiting.withColumn("k", F.explode(F.sequence(F.lit(k), F.lit(k + tries - 1))) if tries > 1 else F.lit(k))
            tried = tried.withColumn("place", _drawn(draw("k"))).join(there, "place").join(linked, ["prev", "object"], "left")
            taken = draw("k", F.lit("take")) < step_weight(F.col("object"), F.col("prev"), F.col("linked"), float(config.p), float(config.q))
            took = F.when(taken, F.struct("k", "object", "n_first", "n_degree"))
            if tries > 1:
                got = tried.groupBy(*who).agg(F.min(took).alias("took"), *[F.first(c).alias(c) for c in ("id", "prev", "first", "degree")])
            else:
                got = tried.withColumn("took", took)
            done = F.col("took").isNotNull()
            new = {"id": F.col("took.object"), "prev": F.col("id"), "first": F.col("took.n_first"), "degree": F.col("took.n_degree")}
            seen = Observation()
            got = got.select(*who, *[F.when(done, v).otherwise(F.col(c)).alias(c) for c, v in new.items()], done.alias("done"))
            add(got.observe(seen, F.count_if(~F.col("done")).alias("waiting")), step, k)
            if not seen.get["waiting"]:
                break
            waiting = spark.read.schema(schema).parquet(f"{path}/place={step}/wave={k}").where("NOT done").drop("done")
            k, tries = k + tries, min(2 * tries, TRIES)
    for table in (nbr, edges, own):
        if table is not None:
            drop(table)
    steps = spark.read.schema(f"{schema}, place int, wave int").parquet(path).where("done")
    return steps.select("round", "start", "id", "first", "degree", "place")


def generate_walks(graph: KnowledgeGraph, config: RandomWalkConfig = RandomWalkConfig()) -> DataFrame:
    """(walk_id, round, start, walk): num_walks walks from every node, of up to walk_length nodes; the
    steps of `generate_steps`, brought together once."""
    steps = generate_steps(graph, config).groupBy("round", "start").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("w"))
    return steps.select(F.concat_ws(":", F.col("round").cast("string"), "start").alias("walk_id"), "round", "start", F.transform("w", lambda x: x["id"]).alias("walk"))


def generate_walk_corpus(graph: KnowledgeGraph, config: RandomWalkConfig = RandomWalkConfig()) -> tuple[DataFrame, DataFrame]:
    """(nodes (idx, id), walks of idx); idx is the place by first appearance."""
    nodes = graph.entities().select(F.col("first_seen").alias("idx"), "id")
    walks = generate_walks(graph, config).select("walk_id", F.posexplode("walk").alias("k", "id")).join(nodes, "id")
    return nodes, walks.groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("k", "idx"))).alias("w")).select("walk_id", F.transform("w", lambda x: x["idx"]).alias("walk"))


def _least_by_hash(rows: DataFrame, key: str, k: int, *seed) -> DataFrame:
    """At most k rows of each key, those of least hash, ranked by `r`; first within salts, so the rows
    of a hub are ranked in many tasks and only k of each go on."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.xxhash64(*[F.lit(x) for x in seed], key, "seq"), "seq"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("seq", F.lit(1)), F.lit(salts)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).where(F.col("r") <= k)
    return few.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= k).drop("_salt")


def sample_neighbors(graph: KnowledgeGraph, nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, sample): up to k triples' objects without replacement; [] for unknown nodes."""
    edges = graph.triples.join(nodes.select(F.col("id").alias("subject")).distinct(), "subject", "left_semi")
    kept = _least_by_hash(edges.select("subject", "seq", "object"), "subject", k, seed)
    per = kept.groupBy(F.col("subject").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "object"))), lambda x: x["object"]).alias("sample"))
    return nodes.select("id").distinct().join(per, "id", "left").select("id", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def sample_neighbors_with_replacement(graph: KnowledgeGraph, nodes: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, sample): exactly k draws, or [] for nodes without out-neighbours."""
    ids = nodes.select("id").distinct()
    own, nbr = _places(graph)
    draws = ids.join(own, "id").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k)) if k > 0 else F.array().cast("array<int>")))
    draws = draws.select("id", "i", _drawn(_uniform(F.lit(seed), F.col("id"), F.col("i"))).alias("place"))
    per = draws.join(nbr.select("place", "object"), "place").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "object"))), lambda x: x["object"]).alias("sample"))
    return ids.join(per, "id", "left").select("id", F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


@dataclass(frozen=True)
class SubgraphBatch:
    """A sampled neighbourhood by number: nodes (idx, id, layer), the targets first and then by layer;
    edges (layer, src_idx, dst_idx) from the drawn neighbour to the node that drew it; the number of
    nodes up to each layer, the targets' first."""

    nodes: DataFrame
    edges: DataFrame
    layer_sizes: list[int]

    @property
    def num_layers(self) -> int:
        return len(self.layer_sizes) - 1

    @property
    def num_nodes(self) -> int:
        return self.layer_sizes[-1]

    def target_indices(self) -> range:
        return range(self.layer_sizes[0])


def subgraph_batch(graph: KnowledgeGraph, seeds: list[str], fanouts: list[int], seed: int = 42) -> SubgraphBatch:
    """`neighbor_sampler` as an indexed batch. A node's number is its place among the targets as given,
    else by layer, the id of the node that drew it first, and the place of that draw."""
    spark = graph.triples.sparkSession
    targets = list(dict.fromkeys(seeds))
    rows = [(0, "", i, s) for i, s in enumerate(targets)]
    seen = spark.createDataFrame(rows, "layer int, by string, place int, id string")
    frontier, edges = seen.select("id"), None
    for layer, k in enumerate(fanouts, 1):
        drawn = cut(sample_neighbors(graph, frontier, k, seed + layer).select(F.lit(layer).alias("layer"), F.col("id").alias("by"), F.posexplode("sample").alias("place", "id")))
        seen = seen.unionByName(drawn)
        edges = drawn if edges is None else edges.unionByName(drawn)
        frontier = drawn.select("id").distinct()
    first = seen.groupBy("id").agg(F.min(F.struct("layer", "by", "place")).alias("at")).select("id", "at.*")
    nodes = cut(numbered(first, ["layer", "by", "place", "id"], "idx").select("idx", "id", "layer"))
    per = {r["layer"]: r["n"] for r in nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a layer
    sizes = [sum(n for at, n in per.items() if at <= layer) for layer in range(len(fanouts) + 1)]
    if edges is None:
        return SubgraphBatch(nodes, spark.createDataFrame([], "layer int, src_idx long, dst_idx long"), sizes)
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("idx").alias(f"{c}_idx"))
    named = edges.select("layer", F.col("id").alias("src"), F.col("by").alias("dst")).join(name("src"), "src").join(name("dst"), "dst")
    return SubgraphBatch(nodes, named.select("layer", "src_idx", "dst_idx"), sizes)


def neighbor_sampler(graph: KnowledgeGraph, seeds: list[str], fanouts: list[int], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, layer), edges (layer, src, dst)): a sampled neighbourhood, hop by hop.

    Edges point from the neighbour to the node that drew it; every drawn neighbour is in the
    next frontier, also one seen before; unknown seeds stay as nodes of layer 0.
    """
    spark = graph.triples.sparkSession
    frontier = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "id string")
    nodes, edges = frontier.withColumn("layer", F.lit(0)), None
    for layer, k in enumerate(fanouts, 1):
        drawn = sample_neighbors(graph, frontier, k, seed + layer)
        e = cut(drawn.select(F.lit(layer).alias("layer"), F.explode("sample").alias("src"), F.col("id").alias("dst")))
        edges = e if edges is None else edges.union(e)
        frontier = e.select(F.col("src").alias("id")).distinct()
        nodes = nodes.union(frontier.withColumn("layer", F.lit(layer)))
    nodes = nodes.groupBy("id").agg(F.min("layer").alias("layer"))
    if edges is None:
        edges = spark.createDataFrame([], "layer int, src string, dst string")
    return nodes, edges


def hetero_neighbor_sampler(hetero, node_type: str, idxs: list[int], fanouts: dict[tuple[str, str, str], list[int]], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(nodes (node_type, idx), edges (layer, src_type, relation, dst_type, src_idx, dst_idx)).

    Edge types in sorted order; each layer draws again from all nodes so far of the source
    type, those added earlier in the same layer included.
    """
    spark = hetero.nodes.sparkSession
    nodes = spark.createDataFrame([(node_type, i) for i in sorted(set(idxs))], "node_type string, idx long")
    edges = spark.createDataFrame([], "layer int, src_type string, relation string, dst_type string, src_idx long, dst_idx long")
    depth = max((len(f) for f in fanouts.values()), default=0)
    for layer in range(depth):
        for edge_type in sorted(fanouts):
            if layer >= len(fanouts[edge_type]):
                continue
            at = nodes.where(F.col("node_type") == edge_type[0]).select(F.col("idx").alias("src_idx"))
            own = hetero.edges_from(edge_type, at)
            e = _least_by_hash(own, "src_idx", fanouts[edge_type][layer], seed, layer)
            e = cut(e.select(F.lit(layer).alias("layer"), "src_type", "relation", "dst_type", "src_idx", "dst_idx"))
            edges = edges.union(e)
            nodes = cut(nodes.union(e.select(F.col("dst_type").alias("node_type"), F.col("dst_idx").alias("idx"))).distinct())
    return nodes, edges
