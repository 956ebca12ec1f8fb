"""Link-prediction datasets and rank metrics.

A dataset is a DataFrame (split, pos, head, relation, tail); the order is train, valid,
test, then pos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..plans.number import numbered

SPLITS = ["train", "valid", "test"]


class MetricError(ValueError):
    """Ranks or scores that a metric is not defined for."""


def _place():
    split = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(SPLITS) for x in (s, i)]), F.col("split"))
    return split.cast("long") * (1 << 60) + F.col("pos") * 2


def vocab(dataset: DataFrame, kind: str) -> DataFrame:
    """(id, name) by first appearance; kind is `entity` (head before tail) or `relation`."""
    at = _place()
    if kind == "relation":
        seen = dataset.select(F.col("relation").alias("name"), at.alias("at"))
    else:
        ends = F.array(F.struct(F.col("head").alias("name"), at.alias("at")), F.struct(F.col("tail").alias("name"), (at + 1).alias("at")))
        seen = dataset.select(F.explode(ends).alias("x")).select("x.*")
    first = seen.groupBy("name").agg(F.min("at").alias("at"))
    return numbered(first, ["at"], "id").select("id", "name")


def entities(dataset: DataFrame) -> DataFrame:
    return dataset.select(F.explode(F.array("head", "tail")).alias("name")).distinct()


def relations(dataset: DataFrame) -> DataFrame:
    return dataset.select(F.col("relation").alias("name")).distinct()


def interned(dataset: DataFrame) -> DataFrame:
    """(split, pos, head, relation, tail) as ids."""
    e, r = vocab(dataset, "entity"), vocab(dataset, "relation")
    out = dataset.join(e.select(F.col("id").alias("h"), F.col("name").alias("head")), "head")
    out = out.join(e.select(F.col("id").alias("t"), F.col("name").alias("tail")), "tail").join(r.select(F.col("id").alias("r"), F.col("name").alias("relation")), "relation")
    return out.select("split", "pos", F.col("h").alias("head"), F.col("r").alias("relation"), F.col("t").alias("tail"))


def from_arrays(ids: DataFrame, num_entities: int, num_relations: int) -> DataFrame:
    """Names e0.., r0.. for ids; an id out of range raises when read."""
    def name(c: str, prefix: str, n: int):
        return F.when((F.col(c) >= 0) & (F.col(c) < n), F.concat(F.lit(prefix), F.col(c).cast("string"))).otherwise(F.raise_error(F.concat(F.lit(f"{c} out of range: "), F.col(c).cast("string"))))

    return ids.select("split", "pos", name("head", "e", num_entities).alias("head"), name("relation", "r", num_relations).alias("relation"), name("tail", "e", num_entities).alias("tail"))


def filter_index(dataset: DataFrame) -> DataFrame:
    """Distinct (head, relation, tail) over all splits."""
    return dataset.select("head", "relation", "tail").distinct()


def known_tails(index: DataFrame) -> DataFrame:
    return index.groupBy("head", "relation").agg(F.sort_array(F.collect_set("tail")).alias("tails"))


def known_heads(index: DataFrame) -> DataFrame:
    return index.groupBy("relation", "tail").agg(F.sort_array(F.collect_set("head")).alias("heads"))


def contains(index: DataFrame, head, relation, tail) -> bool:
    return not index.where((F.col("head") == head) & (F.col("relation") == relation) & (F.col("tail") == tail)).isEmpty()


def _checked(rank: str):
    return F.when(F.col(rank) > 0, F.col(rank)).otherwise(F.raise_error(F.lit("rank 0")))


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 10), rank: str = "rank") -> DataFrame:
    """One row: mrr, mean_rank and hits_at_k over 1-based ranks; 0 for no ranks. A rank of 0 raises."""
    r = _checked(rank)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ranks.agg(zero(F.avg(1.0 / r)).alias("mrr"), zero(F.avg(r.cast("double"))).alias("mean_rank"), *[zero(F.avg((r <= k).cast("double"))).alias(f"hits_at_{k}") for k in ks])


def realistic_rank(scores: DataFrame, query: str = "query", score: str = "score", is_true: str = "is_true") -> DataFrame:
    """(query, rank): mean of the optimistic and the pessimistic rank; lower scores are better.

    A query without a finite true score raises.
    """
    own = scores.where(is_true).groupBy(query).agg(F.min(score).alias("_own"))
    fine = F.col("_own").isNotNull() & ~F.isnan("_own") & (F.abs("_own") < F.lit(float("inf")))
    own_value = F.when(fine, F.col("_own")).otherwise(F.raise_error(F.lit("no finite true score")).cast("double"))
    both = scores.join(own, query, "left").withColumn("_own", own_value)
    return both.groupBy(query).agg(((F.count_if(F.col(score) < F.col("_own")) + 1 + F.count_if(F.col(score) <= F.col("_own"))) / 2.0).alias("rank"))


def adjusted_mean_rank(ranks: DataFrame, rank: str = "rank", candidates: str = "candidates") -> DataFrame:
    """One row `amr`: mean of rank / ((candidates + 1) / 2); checks rank 0, count 0, rank > count."""
    value = (
        F.when(F.col(rank) <= 0, F.raise_error(F.lit("rank 0")).cast("double"))
        .when(F.col(candidates) <= 0, F.raise_error(F.lit("no candidates")).cast("double"))
        .when(F.col(rank) > F.col(candidates), F.raise_error(F.lit("rank above candidates")).cast("double"))
        .otherwise(F.col(rank) / ((F.col(candidates) + 1) / 2.0))
    )
    return ranks.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("amr"))


def per_relation_mrr(ranks: DataFrame, relation: str = "relation", rank: str = "rank") -> DataFrame:
    return ranks.groupBy(relation).agg(F.avg(1.0 / _checked(rank)).alias("mrr"))


def to_knowledge_graph(dataset: DataFrame) -> KnowledgeGraph:
    return KnowledgeGraph.of(dataset.select(_place().alias("seq"), F.col("head").alias("subject"), F.col("relation").alias("predicate"), F.col("tail").alias("object")))


def from_knowledge_graph(graph: KnowledgeGraph, split: str = "train") -> DataFrame:
    """Triples as a split; confidence and source are lost."""
    return graph.triples.select(F.lit(split).alias("split"), F.col("seq").alias("pos"), F.col("subject").alias("head"), F.col("predicate").alias("relation"), F.col("object").alias("tail"))
