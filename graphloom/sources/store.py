"""Triples kept in two orders, so a lookup reads little.

One copy is ordered by subject, one by object; both lie in a folder for each predicate. A lookup by
predicate opens that folder only; one by subject or object goes to the copy in that order, where
the row groups' least and greatest values leave out all that cannot match. Spark does both from
the plain filters of a pattern; the graph below only picks the copy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ENTITY_SCHEMA, TRIPLE_SCHEMA, KnowledgeGraph, TripleQuery


@dataclass(frozen=True)
class ClusteredQuery(TripleQuery):
    """A pattern whose subject, if it has one, picks the copy by subject, else its object the other."""

    by_object: DataFrame | None = None

    def subject(self, value: str) -> ClusteredQuery:
        return ClusteredQuery(self.source, value, self.p, self.o, self.by_object)

    def predicate(self, value: str) -> ClusteredQuery:
        return ClusteredQuery(self.source, self.s, value, self.o, self.by_object)

    def object(self, value: str) -> ClusteredQuery:
        return ClusteredQuery(self.source, self.s, self.p, value, self.by_object)

    def execute(self) -> DataFrame:
        source = self.by_object if self.s is None and self.o is not None else self.source
        return TripleQuery(source, self.s, self.p, self.o).execute()


@dataclass(frozen=True)
class ClusteredGraph(KnowledgeGraph):
    """`triples` is the copy ordered by subject; changes give a plain graph."""

    by_object: DataFrame | None = None

    def relations_to(self, obj: str) -> DataFrame:
        return self.by_object.where(F.col("object") == obj)

    def query(self) -> ClusteredQuery:
        return ClusteredQuery(self.triples, by_object=self.by_object)


def write_clustered(graph: KnowledgeGraph, folder: str, row_group: int | None = None) -> None:
    """The two copies and the entities as Parquet; ranges of (predicate, key) are dealt to the tasks, so
    a frequent predicate or key lies in many files. `row_group` sets the bytes of a row group."""
    options = {} if row_group is None else {"parquet.block.size": str(row_group), "parquet.page.size": str(row_group // 8)}
    for name, key in (("by_subject", "subject"), ("by_object", "object")):
        order = ["predicate", key, "seq"]
        rows = graph.triples.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.options(**options).partitionBy("predicate").parquet(f"{folder}/{name}")
    graph.entities().write.parquet(f"{folder}/entities")


def open_clustered(spark: SparkSession, folder: str) -> ClusteredGraph:
    names = [f.strip().split()[0] for f in TRIPLE_SCHEMA.split(",")]
    copies = [spark.read.schema(TRIPLE_SCHEMA).parquet(f"{folder}/{name}").select(*names) for name in ("by_subject", "by_object")]
    return ClusteredGraph(copies[0], spark.read.schema(ENTITY_SCHEMA).parquet(f"{folder}/entities"), copies[1])
