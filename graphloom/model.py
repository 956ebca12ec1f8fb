"""The graph value: triples and entities as DataFrames.

triples  (seq LONG, subject, predicate, object STRING, confidence FLOAT, source STRING);
         seq is the insertion order, distinct but not dense.
entities (first_seen LONG, id STRING, label, entity_type STRING, properties VARIANT or
         STRING); first_seen orders nodes by first appearance, subject before object.

A graph is immutable: changes return a new graph. Duplicate triples are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIPLE_SCHEMA = "seq long, subject string, predicate string, object string, confidence float, source string"
ENTITY_SCHEMA = "first_seen long, id string, label string, entity_type string, properties string"
KEY = ["subject", "predicate", "object"]


def as_triples(df: DataFrame) -> DataFrame:
    """`df` with all columns of TRIPLE_SCHEMA; seq, subject, predicate and object must be there."""
    have = set(df.columns)
    extra = {"confidence": "float", "source": "string"}
    return df.select("seq", *KEY, *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in extra.items()])


def first_seen(triples: DataFrame) -> DataFrame:
    """(id, first_seen) of all nodes of the triples; partial minima before the shuffle."""
    ends = triples.select(F.explode(F.array(
        F.struct(F.col("subject").alias("id"), (F.col("seq") * 2).alias("at")),
        F.struct(F.col("object").alias("id"), (F.col("seq") * 2 + 1).alias("at")),
    )).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.min("x.at").alias("first_seen"))


def clamp(c, low: float = 0.0, high: float = 1.0):
    """Confidence within [low, high]; NaN and null stay."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low).cast("float")), F.lit(high).cast("float")))


@dataclass(frozen=True)
class KnowledgeGraph:
    triples: DataFrame
    extra_entities: DataFrame | None = None  # isolated or described entities, (first_seen, id, label, ...)

    @staticmethod
    def empty(spark: SparkSession) -> KnowledgeGraph:
        return KnowledgeGraph(spark.createDataFrame([], TRIPLE_SCHEMA))

    @staticmethod
    def of(df: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(as_triples(df))

    # entities

    def entities(self) -> DataFrame:
        """All entities: the ends of triples, and those added on their own."""
        seen = first_seen(self.triples)
        if self.extra_entities is None:
            return seen.select("first_seen", "id", *[F.lit(None).cast("string").alias(c) for c in ("label", "entity_type", "properties")])
        own = self.extra_entities
        both = seen.join(own.withColumnRenamed("first_seen", "own_seen"), "id", "full")
        return both.select(F.least("first_seen", "own_seen").alias("first_seen"), "id", "label", "entity_type", "properties")

    def entity_ids(self) -> DataFrame:
        return self.entities().select("id")

    def get_entity(self, entity_id: str) -> DataFrame:
        return self.entities().where(F.col("id") == entity_id)

    # reads

    def relations_from(self, subject: str) -> DataFrame:
        return self.triples.where(F.col("subject") == subject)

    def relations_to(self, obj: str) -> DataFrame:
        return self.triples.where(F.col("object") == obj)

    def triples_with_relation(self, predicate: str) -> DataFrame:
        return self.triples.where(F.col("predicate") == predicate)

    def query(self) -> TripleQuery:
        return TripleQuery(self.triples)

    def entity_count(self) -> int:
        return self.entity_ids().count()

    def triple_count(self) -> int:
        return self.triples.count()

    def relation_types(self) -> DataFrame:
        return self.triples.select("predicate").distinct()

    def relation_type_count(self) -> int:
        return self.relation_types().count()

    def neighbor_ids(self, entity_id: str) -> DataFrame:
        """Out-neighbours, as often as there are triples."""
        return self.relations_from(entity_id).select(F.col("object").alias("id"))

    def neighbors(self, entity_id: str) -> DataFrame:
        return self.neighbor_ids(entity_id).join(self.entities(), "id")

    def has_edge(self, a: str, b: str) -> bool:
        return not self.triples.where((F.col("subject") == a) & (F.col("object") == b)).isEmpty()

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree), counting parallel triples; one aggregation for both."""
        ends = self.triples.select(F.explode(F.array(
            F.struct(F.col("subject").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
            F.struct(F.col("object").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
        )).alias("x"))
        if self.extra_entities is not None:
            ends = ends.union(self.extra_entities.select(F.struct("id", F.lit(0).alias("o"), F.lit(0).alias("i"))))
        return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))

    def stats(self) -> DataFrame:
        """One row: entities, triples, relation types and mean out-degree (0 if empty)."""
        n = self.entity_ids().agg(F.count(F.lit(1)).alias("entity_count"))
        t = self.triples.agg(F.count(F.lit(1)).alias("triple_count"), F.count_distinct("predicate").alias("relation_type_count"))
        mean = F.coalesce(F.try_divide(F.col("triple_count"), F.col("entity_count")), F.lit(0.0))
        return n.crossJoin(t).withColumn("avg_out_degree", mean)  # one row each

    # changes

    def add(self, rows: DataFrame) -> KnowledgeGraph:
        """Append triples (columns as TRIPLE_SCHEMA, seq above the graph's)."""
        return KnowledgeGraph(self.triples.unionByName(as_triples(rows)), self.extra_entities)

    def remove(self, subject: str, predicate: str, obj: str) -> tuple[KnowledgeGraph, bool]:
        """Without the first matching triple, one row even if others share its seq; both entities stay.
        The flag tells of a match."""
        match = F.coalesce((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj), F.lit(False))
        found = self.triples.where(match).withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy("seq")))
        gone = found.where("_r = 1").drop("_r")
        if gone.isEmpty():
            return self, False
        held = first_seen(gone).select("first_seen", "id", *[F.lit(None).cast("string").alias(c) for c in ("label", "entity_type", "properties")])
        kept = held if self.extra_entities is None else _last_wins(held, self.extra_entities)
        return KnowledgeGraph(self.triples.where(~match).unionByName(found.where("_r > 1").drop("_r")), kept), True

    def clear(self) -> KnowledgeGraph:
        return KnowledgeGraph(self.triples.limit(0))

    def upsert_entities(self, rows: DataFrame) -> KnowledgeGraph:
        """Add or replace entities (id, label, entity_type, properties, first_seen)."""
        return KnowledgeGraph(self.triples, _last_wins(self.extra_entities, rows) if self.extra_entities is not None else _last_wins(None, rows))

    def update_entities(self, rows: DataFrame) -> KnowledgeGraph:
        """Replace those entities that exist; others are ignored."""
        return self.upsert_entities(rows.join(self.entity_ids(), "id", "left_semi"))

    # bag set operations on (subject, predicate, object)

    def merge(self, other: KnowledgeGraph) -> KnowledgeGraph:
        """Bag union, the other's triples after this graph's; entity data is not carried over."""
        top = self.triples.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_top"))
        low = other.triples.agg(F.min("seq").alias("_low"))
        shift = other.triples.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(low))  # one row each
        after = shift.withColumn("seq", F.col("seq") - F.col("_low") + F.col("_top")).drop("_top", "_low")
        return KnowledgeGraph(self.triples.unionByName(after))

    def diff(self, other: KnowledgeGraph) -> KnowledgeGraph:
        """Every copy of the triples whose key the other lacks."""
        return KnowledgeGraph(self.triples.join(other.triples.select(*KEY), KEY, "left_anti").select(*self.triples.columns))

    def intersection(self, other: KnowledgeGraph) -> KnowledgeGraph:
        """Every copy of the triples whose key the other has."""
        return KnowledgeGraph(self.triples.join(other.triples.select(*KEY), KEY, "left_semi").select(*self.triples.columns))

    def subgraph_by_predicates(self, predicates: list[str]) -> KnowledgeGraph:
        return KnowledgeGraph(self.triples.where(F.col("predicate").isin(list(predicates))))

    # adjacency for topology algorithms: parallel triples count once, self-loops stay

    def directed(self) -> DataFrame:
        return self.triples.select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct()

    def undirected(self) -> DataFrame:
        both = F.array(F.struct(F.col("subject").alias("src"), F.col("object").alias("dst")), F.struct(F.col("object").alias("src"), F.col("subject").alias("dst")))
        return self.triples.select(F.explode(both).alias("x")).select("x.*").distinct()


def _last_wins(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows by id: of `new` the last given (by first_seen), else those of `old`."""
    cols = ["first_seen", "id", "label", "entity_type", "properties"]
    rank = Window.partitionBy("id").orderBy(F.desc("_new"), F.desc("first_seen"))
    both = new.select(*cols).withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.select(*cols).withColumn("_new", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(*cols)


@dataclass(frozen=True)
class TripleQuery:
    """Equality filters, all of which must hold; a setter called again replaces its value."""

    source: DataFrame
    s: str | None = None
    p: str | None = None
    o: str | None = None

    def subject(self, value: str) -> TripleQuery:
        return TripleQuery(self.source, value, self.p, self.o)

    def predicate(self, value: str) -> TripleQuery:
        return TripleQuery(self.source, self.s, value, self.o)

    def object(self, value: str) -> TripleQuery:
        return TripleQuery(self.source, self.s, self.p, value)

    def execute(self) -> DataFrame:
        df = self.source
        for column, value in (("subject", self.s), ("predicate", self.p), ("object", self.o)):
            if value is not None:
                df = df.where(F.col(column) == value)
        return df

    def count(self) -> int:
        return self.execute().count()

    def exists(self) -> bool:
        return not self.execute().isEmpty()
