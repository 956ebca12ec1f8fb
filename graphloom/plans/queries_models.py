"""Driver queries on typed graphs, hypergraphs, link-prediction data, walks and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..operators import kge, ranking, sampling
from ..operators.hetero import HeteroGraph
from ..operators.hyper import HyperGraph
from . import graphs as g
from .cut import cut
from .queries_graph import ppr_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# typed graphs

_TYPED = {"contains": ("order", "part"), "supplies": ("supplier", "part"), "placed_by": ("order", "customer"), "in_region": ("nation", "region")}


def typed(spark, d) -> HeteroGraph:
    t = g.tpch(spark, d, list(_TYPED)).triples
    kind = lambda c: F.substring_index(c, ":", 1)
    return HeteroGraph.build(t.select("seq", kind("subject").alias("src_type"), F.col("subject").alias("src"), F.col("predicate").alias("relation"), kind("object").alias("dst_type"), F.col("object").alias("dst")))


_T = f"""t AS ({g.tpch_sql(list(_TYPED))}), ends AS (SELECT split_part(s, ':', 1) AS node_type, s AS id, 2 * seq AS pos FROM t UNION ALL SELECT split_part(o, ':', 1), o, 2 * seq + 1 FROM t),
nodes AS (SELECT node_type, id, row_number() OVER (PARTITION BY node_type ORDER BY min(pos), id) - 1 AS local_idx FROM ends GROUP BY node_type, id),
edges AS (SELECT seq, split_part(s, ':', 1) AS src_type, p AS relation, split_part(o, ':', 1) AS dst_type, a.local_idx AS src_idx, b.local_idx AS dst_idx, s, o FROM t JOIN nodes a ON a.id = s JOIN nodes b ON b.id = o)"""


@query("hetero_nodes", f"WITH {_T} SELECT node_type, local_idx, id FROM nodes")
def _(spark, d):
    return typed(spark, d).nodes


@query("hetero_counts", f"WITH {_T} SELECT 'node' AS kind, node_type AS key, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', src_type || '->' || dst_type || ':' || relation, count(*) FROM edges GROUP BY ALL")
def _(spark, d):
    return typed(spark, d).stats()


@query("hetero_degrees", f"WITH {_T} SELECT 'out' AS side, src_type, relation, dst_type, src_idx AS idx, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'in', src_type, relation, dst_type, dst_idx, count(*) FROM edges GROUP BY ALL")
def _(spark, d):
    h = typed(spark, d)
    key = ["src_type", "relation", "dst_type"]
    out = h.out_degrees().select(F.lit("out").alias("side"), *key, F.col("src_idx").alias("idx"), F.col("out_degree").alias("n"))
    return out.unionByName(h.in_degrees().select(F.lit("in").alias("side"), *key, F.col("dst_idx").alias("idx"), F.col("in_degree").alias("n")))


@query("hetero_neighbors", f"WITH {_T} SELECT o AS id FROM edges WHERE relation = 'contains' AND s = 'order:7'")
def _(spark, d):
    return typed(spark, d).neighbors_by_id(("order", "contains", "part"), "order:7")


@query("metapath_supplier_part_order", f"""WITH {_T}, back AS (SELECT DISTINCT x.s AS o1 FROM edges x JOIN edges y ON x.o = y.o WHERE x.relation = 'contains' AND y.relation = 'supplies' AND y.src_idx = 0)
SELECT 'order' AS node_type, local_idx AS idx FROM nodes WHERE id IN (SELECT o1 FROM back)""")
def _(spark, d):
    t = g.tpch(spark, d, list(_TYPED)).triples
    kind = lambda c: F.substring_index(c, ":", 1)
    e = t.select("seq", kind("subject").alias("src_type"), F.col("subject").alias("src"), F.col("predicate").alias("relation"), kind("object").alias("dst_type"), F.col("object").alias("dst"))
    h = HeteroGraph.build(HeteroGraph.with_reverse(e))
    return h.metapath_neighbors("supplier", 0, [("supplier", "supplies", "part"), ("part", "rev_contains", "order")])


@query("hetero_to_triples", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql(list(_TYPED))})")
def _(spark, d):
    return typed(spark, d).to_knowledge_graph().triples.select("seq", "subject", "predicate", "object")


@query("hetero_from_kg", f"WITH t AS ({g.handoff_sql()}) SELECT p AS relation, count(*) AS n FROM t GROUP BY p")
def _(spark, d):
    return HeteroGraph.from_knowledge_graph(g.handoff(spark, d)).edge_counts().select("relation", "n")


# hypergraphs


def labelled(spark, d) -> HyperGraph:
    o = g.read(spark, d, "orders")
    h = o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("order:"), "o_orderkey").alias("subject"), F.lit("placed_by").alias("predicate"), F.concat(F.lit("customer:"), "o_custkey").alias("object"),
        F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("qualifiers"),
    )
    bind = lambda r, p, c: F.struct(F.lit(r).alias("role"), F.concat(F.lit(p), F.col(c).cast("string")).alias("entity"))
    e = g.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("ord"), F.lit("supply").alias("relation"),
        F.array(bind("order", "order:", "l_orderkey"), bind("part", "part:", "l_partkey"), bind("supplier", "supplier:", "l_suppkey")).alias("bindings"), F.lit(None).cast("float").alias("confidence"),
    )
    return HyperGraph.of(g.tpch(spark, d, ["in_region"]), h, e)


_HT = "h AS (SELECT o_orderkey AS ord, 'order:' || o_orderkey AS s, 'customer:' || o_custkey AS o, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"


@query("hyper_find_qualifier", f"WITH {_HT} SELECT ord, s AS subject, o AS object FROM h WHERE status = 'F'")
def _(spark, d):
    return labelled(spark, d).find_by_qualifier("status", "F").select("ord", "subject", "object")


@query("hyper_find_entity", f"WITH {_HT} SELECT ord, s AS subject, o AS object FROM h WHERE 'customer:7' IN (s, o, status, priority)")
def _(spark, d):
    return labelled(spark, d).find_by_entity("customer:7").select("ord", "subject", "object")


@query("hyper_for_subject", f"WITH {_HT} SELECT ord, s AS subject, o AS object FROM h WHERE s = 'order:7'")
def _(spark, d):
    return labelled(spark, d).hyper_triples_for_subject("order:7").select("ord", "subject", "object")


@query("hyper_entities", f"""WITH {_HT}, t AS ({g.tpch_sql(["in_region"])}) SELECT s AS id FROM t UNION SELECT o FROM t UNION SELECT s FROM h UNION SELECT o FROM h UNION SELECT status FROM h UNION SELECT priority FROM h
UNION SELECT 'order:' || l_orderkey FROM lineitem UNION SELECT 'part:' || l_partkey FROM lineitem UNION SELECT 'supplier:' || l_suppkey FROM lineitem""")
def _(spark, d):
    return labelled(spark, d).entities()


@query("hyper_facts", f"SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n")
def _(spark, d):
    return spark.createDataFrame([(labelled(spark, d).fact_count(),)], "n long")


_REIFY = """SELECT ord, 0 AS k, s AS subject, 'placed_by' AS predicate, o AS object FROM h UNION ALL SELECT ord, 1, '_:stmt_' || ord, 'rdf:subject', s FROM h UNION ALL SELECT ord, 2, '_:stmt_' || ord, 'rdf:predicate', 'placed_by' FROM h
UNION ALL SELECT ord, 3, '_:stmt_' || ord, 'rdf:object', o FROM h UNION ALL SELECT ord, 4, '_:stmt_' || ord, 'priority', priority FROM h UNION ALL SELECT ord, 5, '_:stmt_' || ord, 'status', status FROM h"""


@query("hyper_reify", f"WITH {_HT} {_REIFY}")
def _(spark, d):
    return labelled(spark, d).reify_hyper_triples()


@query("hyperedge_reify", """WITH e AS (SELECT l_orderkey * 16 + l_linenumber AS ord, * FROM lineitem) SELECT ord, 0 AS k, '_:hyperedge_' || ord AS subject, 'rdf:type' AS predicate, 'supply' AS object FROM e
UNION ALL SELECT ord, 1, '_:hyperedge_' || ord, 'order', 'order:' || l_orderkey FROM e UNION ALL SELECT ord, 2, '_:hyperedge_' || ord, 'part', 'part:' || l_partkey FROM e UNION ALL SELECT ord, 3, '_:hyperedge_' || ord, 'supplier', 'supplier:' || l_suppkey FROM e""")
def _(spark, d):
    return labelled(spark, d).reify_hyperedges()


@query("hyper_arity", f"WITH {_HT} SELECT 4 AS arity, count(*) AS n FROM h")
def _(spark, d):
    from ..operators.hyper import arity

    return labelled(spark, d).hyper_triples.groupBy(arity().alias("arity")).agg(F.count(F.lit(1)).alias("n"))


@query("hyperedge_roles", "SELECT 'supplier:' || l_suppkey AS entity, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    from ..operators.hyper import entity_by_role

    return labelled(spark, d).hyperedges.groupBy(entity_by_role("bindings", "supplier").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("hyper_to_kg", f"WITH {_HT}, t AS ({g.tpch_sql(['in_region'])}), r AS ({_REIFY}) SELECT predicate, count(*) AS n FROM (SELECT p AS predicate FROM t UNION ALL SELECT predicate FROM r UNION ALL SELECT unnest(['rdf:type', 'order', 'part', 'supplier']) FROM lineitem) GROUP BY predicate")
def _(spark, d):
    return labelled(spark, d).to_knowledge_graph().triples.groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


# link prediction


def dataset(spark, d):
    t = g.handoff(spark, d).triples
    split = F.when(F.col("seq") % 10 == 0, "test").when(F.col("seq") % 10 == 1, "valid").otherwise("train")
    return t.select(split.alias("split"), F.col("seq").alias("pos"), F.col("subject").alias("head"), F.col("predicate").alias("relation"), F.col("object").alias("tail"))


_K = f"k AS (SELECT CASE seq % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split, CASE seq % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS z, seq AS pos, s AS head, p AS relation, o AS tail FROM ({g.handoff_sql()}))"
_V = f"{_K}, ev AS (SELECT name, row_number() OVER (ORDER BY min(x)) - 1 AS id FROM (SELECT head AS name, (z, 2 * pos) AS x FROM k UNION ALL SELECT tail, (z, 2 * pos + 1) FROM k) GROUP BY name), rv AS (SELECT relation AS name, row_number() OVER (ORDER BY min((z, pos))) - 1 AS id FROM k GROUP BY relation)"


@query("kge_vocab", f"WITH {_V} SELECT 'entity' AS kind, id, name FROM ev UNION ALL SELECT 'relation', id, name FROM rv")
def _(spark, d):
    k = dataset(spark, d)
    return kge.vocab(k, "entity").withColumn("kind", F.lit("entity")).unionByName(kge.vocab(k, "relation").withColumn("kind", F.lit("relation")))


@query("kge_interned", f"WITH {_V} SELECT split, pos, h.id AS head, r.id AS relation, t.id AS tail FROM k JOIN ev h ON h.name = head JOIN ev t ON t.name = tail JOIN rv r ON r.name = relation")
def _(spark, d):
    return kge.interned(dataset(spark, d))


@query("kge_filter_index", f"WITH {_K} SELECT head, relation, count(DISTINCT tail) AS n, string_agg(DISTINCT tail, ',' ORDER BY tail) AS tails FROM k GROUP BY head, relation")
def _(spark, d):
    return kge.known_tails(kge.filter_index(dataset(spark, d))).select("head", "relation", F.size("tails").cast("long").alias("n"), F.array_join("tails", ",").alias("tails"))


@query("kge_known_heads", f"WITH {_K} SELECT relation, tail, count(DISTINCT head) AS n FROM k GROUP BY relation, tail")
def _(spark, d):
    return kge.known_heads(kge.filter_index(dataset(spark, d))).select("relation", "tail", F.size("heads").cast("long").alias("n"))


_RANK = "1 + (l_partkey * 7 + l_linenumber) % 20"


def _ranked(spark, d):
    return g.read(spark, d, "lineitem").select(F.expr(f"CAST({_RANK} AS BIGINT)").alias("rank"), F.col("l_returnflag").alias("relation"), F.lit(20).alias("candidates"))


@query("kge_metrics", f"SELECT round(avg(1.0 / r), 9) AS mrr, round(avg(r::DOUBLE), 9) AS mean_rank, round(avg((r <= 1)::INT), 9) AS hits_at_1, round(avg((r <= 3)::INT), 9) AS hits_at_3, round(avg((r <= 10)::INT), 9) AS hits_at_10 FROM (SELECT {_RANK} AS r FROM lineitem)")
def _(spark, d):
    out = kge.metrics(_ranked(spark, d))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("kge_per_relation_mrr", f"SELECT l_returnflag AS relation, round(avg(1.0 / ({_RANK})), 9) AS mrr FROM lineitem GROUP BY 1")
def _(spark, d):
    return kge.per_relation_mrr(_ranked(spark, d)).withColumn("mrr", F.round("mrr", 9))


@query("kge_adjusted_mean_rank", f"SELECT round(avg(({_RANK}) / 10.5), 9) AS amr FROM lineitem")
def _(spark, d):
    return kge.adjusted_mean_rank(_ranked(spark, d)).select(F.round("amr", 9).alias("amr"))


# of each order, its first line is the true one
@query("kge_realistic_rank", """WITH x AS (SELECT l_orderkey AS query, l_quantity AS score, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS is_true FROM lineitem), o AS (SELECT query, min(score) AS own FROM x WHERE is_true GROUP BY query)
SELECT query, (count(*) FILTER (score < own) + 1 + count(*) FILTER (score <= own)) / 2.0::DOUBLE AS rank FROM x JOIN o USING (query) GROUP BY query""")
def _(spark, d):
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return kge.realistic_rank(g.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_quantity").alias("score"), (F.col("l_linenumber") == first).alias("is_true")))


# walks and samples: what SQL can state about them


def _walk_checks(spark, d, p: float, q: float):
    k = KnowledgeGraph(cut(g.handoff(spark, d).triples))  # read by many jobs
    config = sampling.RandomWalkConfig(walk_length=10, num_walks=5, p=p, q=q, seed=7)
    w = cut(sampling.generate_walks(k, config))
    hops = w.select(F.posexplode("walk").alias("k", "a"), "walk").where(F.col("k") < F.size("walk") - 1).select(F.col("a").alias("src"), F.get("walk", F.col("k") + 1).alias("dst"))
    hops = hops.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    wrong = hops.join(k.directed(), ["src", "dst"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wrong_hops"))
    left = k.triples.select(F.col("subject").alias("src")).distinct()
    sinks = w.where(F.size("walk") < 10).select(F.element_at("walk", -1).alias("src")).join(left, "src", "left_semi").agg(F.count(F.lit(1)).alias("stopped_early"))
    n = w.agg(F.count(F.lit(1)).alias("walks"), F.count_distinct("start").alias("starts"), F.count_if(F.get("walk", F.lit(0)) != F.col("start")).alias("wrong_starts"))
    return n.crossJoin(wrong).crossJoin(sinks)  # one row each


_WALKS = f"WITH t AS ({g.handoff_sql()}), n AS ({g.nodes_sql()}) SELECT 5 * count(*) AS walks, count(*) AS starts, 0::BIGINT AS wrong_starts, 0::BIGINT AS wrong_hops, 0::BIGINT AS stopped_early FROM n"


@query("walk_invariants", _WALKS)
def _(spark, d):
    return _walk_checks(spark, d, 1.0, 1.0)


@query("biased_walk_invariants", _WALKS)
def _(spark, d):
    return _walk_checks(spark, d, 2.0, 0.5)


@query("sample_invariants", f"WITH t AS ({g.handoff_sql()}), n AS ({g.nodes_sql()}) SELECT n.id, least(5, count(t.s)) AS n, 0::BIGINT AS strangers FROM n LEFT JOIN t ON t.s = n.id GROUP BY n.id")
def _(spark, d):
    k = g.handoff(spark, d)
    return _sample_checks(k, sampling.sample_neighbors(k, k.entity_ids(), 5))


def _sample_checks(k, s):
    edges = k.directed().groupBy("src").agg(F.collect_set("dst").alias("own"))
    out = s.join(edges, s["id"] == edges["src"], "left")
    strangers = F.size(F.array_except("sample", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select("id", F.size("sample").cast("long").alias("n"), strangers.cast("long").alias("strangers"))


@query("sample_replacement_invariants", f"WITH t AS ({g.handoff_sql()}), n AS ({g.nodes_sql()}) SELECT n.id, CASE WHEN count(t.s) > 0 THEN 7 ELSE 0 END::BIGINT AS n, 0::BIGINT AS strangers FROM n LEFT JOIN t ON t.s = n.id GROUP BY n.id")
def _(spark, d):
    k = g.handoff(spark, d)
    return _sample_checks(k, sampling.sample_neighbors_with_replacement(k, k.entity_ids(), 7))


@query("neighbor_sampler_invariants", f"WITH t AS ({g.handoff_sql()}) SELECT least(4, count(*)) AS first_layer, 0::BIGINT AS strangers FROM t WHERE s = '1'")
def _(spark, d):
    k = g.handoff(spark, d)
    _, e = sampling.neighbor_sampler(k, ["1"], [4, 3])
    t = k.directed()
    bad = e.join(t, (e["src"] == t["dst"]) & (e["dst"] == t["src"]), "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    return e.where("layer = 1").agg(F.count(F.lit(1)).alias("first_layer")).crossJoin(bad)  # one row each


@query("hetero_sampler_invariants", f"WITH {_T} SELECT least(3, count(*)) AS first_edges, 0::BIGINT AS strangers FROM edges WHERE relation = 'supplies' AND src_idx = 0")
def _(spark, d):
    h = typed(spark, d)
    _, e = sampling.hetero_neighbor_sampler(h, "supplier", [0], {("supplier", "supplies", "part"): [3]})
    bad = h.strangers(e).agg(F.count(F.lit(1)).alias("strangers"))
    return e.agg(F.count(F.lit(1)).alias("first_edges")).crossJoin(bad)  # one row each


# a batch that draws every neighbour is the neighbourhood itself
_AROUND = f"""WITH t AS ({g.handoff_sql()}), a AS (SELECT s AS id FROM t ORDER BY seq LIMIT 1), one AS (SELECT s, o FROM t JOIN a ON s = id), two AS (SELECT s, o FROM t WHERE s IN (SELECT o FROM one))"""


def _batch(spark, d) -> sampling.SubgraphBatch:
    k = g.handoff(spark, d)
    return sampling.subgraph_batch(k, [k.triples.agg(F.min_by("subject", "seq")).first()[0]], [k.triple_count()] * 2)


@query("subgraph_batch_nodes", f"{_AROUND}, n AS (SELECT id, 0 AS layer FROM a UNION ALL SELECT o, 1 FROM one UNION ALL SELECT o, 2 FROM two), m AS (SELECT id, min(layer)::INT AS layer FROM n GROUP BY id) SELECT id, layer, (SELECT count(*) FROM m y WHERE y.layer <= m.layer) AS layer_size, true AS in_order FROM m")
def _(spark, d):
    b = _batch(spark, d)
    sizes = F.array(*[F.lit(n).cast("long") for n in b.layer_sizes])
    before = F.when(F.col("layer") > 0, F.get(sizes, F.col("layer") - 1)).otherwise(F.lit(0))
    return b.nodes.select("id", "layer", F.get(sizes, F.col("layer")).alias("layer_size"), ((F.col("idx") >= before) & (F.col("idx") < F.get(sizes, F.col("layer")))).alias("in_order"))


@query("subgraph_batch_edges", f"{_AROUND} SELECT 1 AS layer, o AS src, s AS dst, count(*) AS n FROM one GROUP BY ALL UNION ALL SELECT 2, o, s, count(*) FROM two GROUP BY ALL")
def _(spark, d):
    b = _batch(spark, d)
    name = lambda c: b.nodes.select(F.col("idx").alias(f"{c}_idx"), F.col("id").alias(c))
    return b.edges.join(name("src"), "src_idx").join(name("dst"), "dst_idx").groupBy("layer", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


# passages by lexical overlap and by graph score


@query("passage_overlap", r"""WITH q AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) > 2)) AS w FROM benchmark WHERE item_id = 0),
p AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: len(x) > 2)) AS w FROM benchmark)
SELECT item_id, len(list_intersect(p.w, q.w))::BIGINT AS overlap FROM p, q""")
def _(spark, d):
    b = g.read(spark, d, "benchmark")
    w = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: F.length(x) > 2))
    q = b.where("item_id = 0").select(w.alias("q"))
    return b.select("item_id", w.alias("w")).crossJoin(F.broadcast(q)).select("item_id", F.size(F.array_intersect("w", "q")).cast("long").alias("overlap"))  # one row


_RANKED = ppr_sql(g.handoff_sql(), 10)


@query("passage_rank", f"WITH r AS ({_RANKED}), x AS ({g.handoff_sql()}), seed AS (SELECT s FROM x ORDER BY seq LIMIT 1), m AS (SELECT DISTINCT p AS passage, s AS id FROM x UNION SELECT p, o FROM x) SELECT passage, round(sum(x), 9) AS score FROM m JOIN r USING (id) WHERE id <> (SELECT s FROM seed) GROUP BY passage")
def _(spark, d):
    k = g.handoff(spark, d)
    seed = k.entities().agg(F.min_by("id", "first_seen")).first()[0]
    scores = ranking.personalized_pagerank(k, seed, ranking.PageRankConfig(0.85, 10, 1e-300)).scores
    passages = k.triples.select(F.col("predicate").alias("passage"), F.explode(F.array("subject", "object")).alias("id")).distinct().where(F.col("id") != seed)
    return passages.join(scores, "id").groupBy("passage").agg(F.round(F.sum("score"), 9).alias("score")).orderBy(F.desc("score"), "passage")
