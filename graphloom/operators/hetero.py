"""Typed graphs: nodes (node_type, local_idx, id) and edges (seq, src_type, relation, dst_type,
src_idx, dst_idx), dense indexes for each type by first appearance.

A built graph also keeps its edges by name, as they were given. What asks for counts, names or a few
nodes' edges reads those and looks up indexes of what is left, so no such plan joins every edge to
its two nodes; a loaded graph has edges by index only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..plans.cut import cut
from ..plans.number import numbered

EDGE_TYPE = ["src_type", "relation", "dst_type"]


@dataclass(frozen=True)
class HeteroGraph:
    nodes: DataFrame
    edges: DataFrame
    named: DataFrame | None = None  # (seq, src_type, src, relation, dst_type, dst), every end a node

    @staticmethod
    def build(edges: DataFrame, nodes: DataFrame | None = None) -> HeteroGraph:
        """From edges (seq, src_type, src, relation, dst_type, dst) and lone nodes (seq, node_type, id).

        Ends become nodes when first met; repeated nodes are one, repeated edges stay.
        """
        ends = edges.select(F.explode(F.array(
            F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("id"), (F.col("seq") * 2).alias("at")),
            F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("id"), (F.col("seq") * 2 + 1).alias("at")),
        )).alias("x")).select("x.*")
        if nodes is not None:
            ends = ends.unionByName(nodes.select("node_type", "id", (F.col("seq") * 2).alias("at")))
        seen = ends.groupBy("node_type", "id").agg(F.min("at").alias("at"))
        # one number for all types; a type's first one (a row a type) is its zero
        placed = numbered(seen, ["node_type", "at", "id"])
        zero = placed.groupBy("node_type").agg(F.min("n").alias("zero"))
        table = cut(placed.join(zero, "node_type").select("node_type", (F.col("n") - F.col("zero")).alias("local_idx"), "id"))
        # an end without a type or an id is no node's, and its edge none of the graph's
        named = edges.select("seq", "src_type", "src", "relation", "dst_type", "dst").where("src_type IS NOT NULL AND src IS NOT NULL AND dst_type IS NOT NULL AND dst IS NOT NULL")
        return HeteroGraph(table, _indexed(named, table), named)

    @staticmethod
    def with_reverse(edges: DataFrame) -> DataFrame:
        """Edges and their reverses, whose relation gets the prefix `rev_`."""
        back = edges.select(
            (F.col("seq") * 2 + 1).alias("seq"), F.col("dst_type").alias("src_type"), F.col("dst").alias("src"),
            F.concat(F.lit("rev_"), "relation").alias("relation"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst"),
        )
        return edges.withColumn("seq", F.col("seq") * 2).unionByName(back)

    @staticmethod
    def from_knowledge_graph(graph: KnowledgeGraph) -> HeteroGraph:
        """One node type `entity`, an edge type for each predicate; confidence and source are lost."""
        e = graph.triples.select("seq", F.lit("entity").alias("src_type"), F.col("subject").alias("src"), F.col("predicate").alias("relation"), F.lit("entity").alias("dst_type"), F.col("object").alias("dst"))
        lone = graph.entities().select(F.col("first_seen").alias("seq"), F.lit("entity").alias("node_type"), "id")
        return HeteroGraph.build(e, lone.withColumn("seq", F.expr("seq div 2")))

    def to_knowledge_graph(self) -> KnowledgeGraph:
        """Triples without node types: equal ids of two types become one, lone nodes are lost."""
        t = self.by_name()
        return KnowledgeGraph.of(t.select("seq", F.col("src").alias("subject"), F.col("relation").alias("predicate"), F.col("dst").alias("object")))

    def by_name(self) -> DataFrame:
        """(seq, src_type, src, relation, dst_type, dst) of all edges."""
        if self.named is not None:
            return self.named
        t = self.edges.join(_end(self.nodes, "src"), ["src_type", "src_idx"]).join(_end(self.nodes, "dst"), ["dst_type", "dst_idx"])
        return t.select("seq", "src_type", "src", "relation", "dst_type", "dst")

    def edges_from(self, edge_type: tuple[str, str, str], at: DataFrame) -> DataFrame:
        """Edges of a type from the nodes (src_idx) of its source type; only their ends are looked up."""
        if self.named is None:
            return self._of(edge_type).join(at, "src_idx", "left_semi").select("seq", *EDGE_TYPE, "src_idx", "dst_idx")
        src = self.nodes.where(F.col("node_type") == edge_type[0]).join(at.withColumnRenamed("src_idx", "local_idx"), "local_idx", "left_semi").select(F.col("id").alias("src"))
        return _indexed(_where(self.named, edge_type).join(src, "src", "left_semi"), self.nodes)

    def strangers(self, edges: DataFrame) -> DataFrame:
        """Those of the edges, by type and indexes, that the graph does not have."""
        key = [*EDGE_TYPE, "src_idx", "dst_idx"]
        if self.named is None:
            return edges.join(self.edges, key, "left_anti")
        named = edges.join(_end(self.nodes, "src"), ["src_type", "src_idx"], "left").join(_end(self.nodes, "dst"), ["dst_type", "dst_idx"], "left")
        return named.join(self.named, [*EDGE_TYPE, "src", "dst"], "left_anti").select(*edges.columns)

    def node_types(self) -> DataFrame:
        return self.nodes.select("node_type").distinct()

    def edge_types(self) -> DataFrame:
        return self.edges.select(*EDGE_TYPE).distinct()

    def num_nodes(self, node_type: str | None = None) -> int:
        return (self.nodes if node_type is None else self.nodes.where(F.col("node_type") == node_type)).count()

    def num_edges(self, edge_type: tuple[str, str, str] | None = None) -> int:
        rows = self._rows()
        return (rows if edge_type is None else _where(rows, edge_type)).count()

    def node_counts(self) -> DataFrame:
        return self.nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))

    def edge_counts(self) -> DataFrame:
        return self._rows().groupBy(*EDGE_TYPE).agg(F.count(F.lit(1)).alias("n"))

    def _rows(self) -> DataFrame:
        """A row an edge with its type, by name where known."""
        return self.edges if self.named is None else self.named

    def _of(self, edge_type: tuple[str, str, str]) -> DataFrame:
        return _where(self.edges, edge_type)

    def get_node_index(self, node_type: str, node_id: str) -> DataFrame:
        return self.nodes.where((F.col("node_type") == node_type) & (F.col("id") == node_id)).select("local_idx")

    def get_node_id(self, node_type: str, idx: int) -> DataFrame:
        return self.nodes.where((F.col("node_type") == node_type) & (F.col("local_idx") == idx)).select("id")

    def edge_index(self, edge_type: tuple[str, str, str]) -> DataFrame:
        """(seq, src_idx, dst_idx) of an edge type."""
        return self._of(edge_type).select("seq", "src_idx", "dst_idx")

    def neighbors(self, edge_type: tuple[str, str, str], idx: int) -> DataFrame:
        """Destinations, as often as there are edges, in insertion order."""
        return self._of(edge_type).where(F.col("src_idx") == idx).orderBy("seq").select("dst_idx")

    def incoming_neighbors(self, edge_type: tuple[str, str, str], idx: int) -> DataFrame:
        return self._of(edge_type).where(F.col("dst_idx") == idx).orderBy("seq").select("src_idx")

    def neighbors_by_id(self, edge_type: tuple[str, str, str], node_id: str) -> DataFrame:
        s = self.nodes.where((F.col("node_type") == edge_type[0]) & (F.col("id") == node_id)).select(F.col("local_idx").alias("src_idx"))
        d = self.nodes.where(F.col("node_type") == edge_type[2]).select(F.col("local_idx").alias("dst_idx"), "id")
        return self._of(edge_type).join(s, "src_idx", "left_semi").join(d, "dst_idx").orderBy("seq").select("id")

    def out_degrees(self) -> DataFrame:
        return self._degrees("src", "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst", "in_degree")

    def _degrees(self, end: str, name: str) -> DataFrame:
        n = F.count(F.lit(1)).alias(name)
        if self.named is None:
            return self.edges.groupBy(*EDGE_TYPE, f"{end}_idx").agg(n)
        # counted by name first: the nodes join a row a node and edge type
        per = self.named.groupBy(*EDGE_TYPE, end).agg(n)
        return per.join(_end(self.nodes, end), [f"{end}_type", end]).select(*EDGE_TYPE, f"{end}_idx", name)

    def metapath_neighbors(self, node_type: str, idx: int, metapath: list[tuple[str, str, str]]) -> DataFrame:
        """(node_type, idx) reached along the edge types, a set after each hop.

        Empty for an unknown start, or where an edge type does not start at the type reached;
        the start itself for an empty path.
        """
        now = self.nodes.where((F.col("node_type") == node_type) & (F.col("local_idx") == idx))
        if self.named is None:
            now = now.select("node_type", F.col("local_idx").alias("at"))
            rows, end = self.edges, "_idx"
        else:
            now, rows, end = now.select("node_type", F.col("id").alias("at")), self.named, ""
        for edge_type in metapath:
            e = _where(rows, edge_type).select(F.col("src_type").alias("node_type"), F.col(f"src{end}").alias("at"), "dst_type", F.col(f"dst{end}").alias("to"))
            now = e.join(now, ["node_type", "at"], "left_semi").select(F.col("dst_type").alias("node_type"), F.col("to").alias("at")).distinct()
        if self.named is None:
            return now.select("node_type", F.col("at").alias("idx"))
        return self.nodes.join(now.withColumnRenamed("at", "id"), ["node_type", "id"], "left_semi").select("node_type", F.col("local_idx").alias("idx"))

    def stats(self) -> DataFrame:
        """(kind, key, n): counts by node type, and by edge type as `src->dst:relation`."""
        key = F.concat(F.col("src_type"), F.lit("->"), F.col("dst_type"), F.lit(":"), F.col("relation"))
        n = self.node_counts().select(F.lit("node").alias("kind"), F.col("node_type").alias("key"), "n")
        return n.unionByName(self.edge_counts().select(F.lit("edge").alias("kind"), key.alias("key"), "n"))

    def save(self, folder: str, form: str = "parquet") -> None:
        """Two tables; `form` is `parquet` or `json` (an object a line, in gzip files)."""
        for name, table in (("nodes", self.nodes), ("edges", self.edges)):
            out = table.write.format(form)
            (out.option("compression", "gzip") if form == "json" else out).save(f"{folder}/{name}")

    @staticmethod
    def load(spark: SparkSession, folder: str, form: str = "parquet") -> HeteroGraph:
        tables = {"nodes": "node_type string, local_idx long, id string", "edges": "seq long, src_type string, relation string, dst_type string, src_idx long, dst_idx long"}
        return HeteroGraph(*[spark.read.format(form).schema(schema).load(f"{folder}/{name}") for name, schema in tables.items()])


def _where(edges: DataFrame, edge_type: tuple[str, str, str]) -> DataFrame:
    s, r, d = edge_type
    return edges.where((F.col("src_type") == s) & (F.col("relation") == r) & (F.col("dst_type") == d))


def _end(nodes: DataFrame, end: str) -> DataFrame:
    """The nodes as the sources (`src`) or destinations (`dst`) of edges."""
    return nodes.select(F.col("node_type").alias(f"{end}_type"), F.col("local_idx").alias(f"{end}_idx"), F.col("id").alias(end))


def _indexed(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, *EDGE_TYPE, src_idx, dst_idx) of edges by name."""
    e = named.join(_end(nodes, "src"), ["src_type", "src"]).join(_end(nodes, "dst"), ["dst_type", "dst"])
    return e.select("seq", *EDGE_TYPE, "src_idx", "dst_idx")


def reverse_edge_type(edge_type: tuple[str, str, str]) -> tuple[str, str, str]:
    """Ends swapped and `rev_` before the relation; twice is not the type again."""
    s, r, d = edge_type
    return d, f"rev_{r}", s
