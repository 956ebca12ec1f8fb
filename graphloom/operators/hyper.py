"""Qualified triples and n-ary edges.

hyper_triples (ord LONG, subject, predicate, object STRING, qualifiers MAP<STRING,STRING>)
hyperedges    (ord LONG, relation STRING, bindings ARRAY<STRUCT<role,entity>>, confidence FLOAT)
`ord` is the 0-based position in its list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..plans.number import numbered

# The names that reified statements use.
TYPE, SUBJECT, PREDICATE, OBJECT = "rdf:type", "rdf:subject", "rdf:predicate", "rdf:object"


def arity(qualifiers: str | Column = "qualifiers") -> Column:
    return F.size(qualifiers) + 2


def with_qualifier(qualifiers: Column, key: str, value: str) -> Column:
    """Put a qualifier; a later value replaces an earlier one."""
    rest = F.map_filter(qualifiers, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))


def entity_at(bindings: str, i: int) -> Column:
    return F.get(bindings, F.lit(i))["entity"]


def entity_by_role(bindings: str, role: str) -> Column:
    """The entity of the first binding with the role, null if none."""
    return F.get(F.filter(bindings, lambda b: b["role"] == role), F.lit(0))["entity"]


def roles(bindings: str) -> Column:
    return F.transform(bindings, lambda b: b["role"])


def edge_entities(bindings: str) -> Column:
    return F.transform(bindings, lambda b: b["entity"])


@dataclass(frozen=True)
class HyperGraph:
    triples: DataFrame  # (ord, subject, predicate, object)
    hyper_triples: DataFrame
    hyperedges: DataFrame

    @staticmethod
    def of(graph: KnowledgeGraph, hyper_triples: DataFrame, hyperedges: DataFrame) -> HyperGraph:
        return HyperGraph(graph.triples.select(F.col("seq").alias("ord"), "subject", "predicate", "object"), hyper_triples, hyperedges)

    def fact_count(self) -> int:
        return self.triples.count() + self.hyper_triples.count() + self.hyperedges.count()

    def entities(self) -> DataFrame:
        """Subjects, objects, qualifier values and bound entities."""
        ends = F.array("subject", "object")
        parts = [
            self.triples.select(F.explode(ends).alias("id")),
            self.hyper_triples.select(F.explode(F.concat(ends, F.map_values("qualifiers"))).alias("id")),
            self.hyperedges.select(F.explode(edge_entities("bindings")).alias("id")),
        ]
        return parts[0].union(parts[1]).union(parts[2]).distinct()

    def find_by_qualifier(self, key: str, value: str) -> DataFrame:
        return self.hyper_triples.where(F.col("qualifiers")[key] == value)

    def find_by_entity(self, entity: str) -> DataFrame:
        return self.hyper_triples.where((F.col("subject") == entity) | (F.col("object") == entity) | F.array_contains(F.map_values("qualifiers"), entity))

    def hyper_triples_for_subject(self, entity: str) -> DataFrame:
        return self.hyper_triples.where(F.col("subject") == entity)

    def reify_hyper_triples(self) -> DataFrame:
        """(ord, k, subject, predicate, object): the triple, three anchors, then the qualifiers."""
        node = F.concat(F.lit("_:stmt_"), F.col("ord").cast("string"))
        row = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
        fixed = F.array(
            row(F.col("subject"), F.col("predicate"), F.col("object")),
            row(node, F.lit(SUBJECT), F.col("subject")), row(node, F.lit(PREDICATE), F.col("predicate")), row(node, F.lit(OBJECT), F.col("object")),
        )
        more = F.transform(F.array_sort(F.map_entries("qualifiers")), lambda e: row(node, e["key"], e["value"]))
        return self.hyper_triples.select("ord", F.posexplode(F.concat(fixed, more)).alias("k", "t")).select("ord", "k", "t.*")

    def reify_hyperedges(self) -> DataFrame:
        """(ord, k, subject, predicate, object): the type, then one triple a binding, in order."""
        node = F.concat(F.lit("_:hyperedge_"), F.col("ord").cast("string"))
        row = lambda p, o: F.struct(node.alias("subject"), p.alias("predicate"), o.alias("object"))
        each = F.concat(F.array(row(F.lit(TYPE), F.col("relation"))), F.transform("bindings", lambda b: row(b["role"], b["entity"])))
        return self.hyperedges.select("ord", F.posexplode(each).alias("k", "t")).select("ord", "k", "t.*")

    def to_reified_triples(self) -> DataFrame:
        """(part, ord, k, subject, predicate, object), in the order part, ord, k."""
        plain = self.triples.select(F.lit(0).alias("part"), "ord", F.lit(0).alias("k"), "subject", "predicate", "object")
        one = self.reify_hyper_triples().withColumn("part", F.lit(1))
        two = self.reify_hyperedges().withColumn("part", F.lit(2))
        return plain.unionByName(one).unionByName(two)

    def to_knowledge_graph(self) -> KnowledgeGraph:
        """The reified triples, numbered in their order; any number of facts a statement, any `ord`."""
        return KnowledgeGraph.of(numbered(self.to_reified_triples(), ["part", "ord", "k"], "seq"))
