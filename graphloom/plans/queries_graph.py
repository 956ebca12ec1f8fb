"""Driver queries on triples: lookups, changes, set operations, traversal, centrality, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KnowledgeGraph
from ..operators import centrality, communities, ranking, traverse
from . import graphs as g

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
H = g.handoff_sql()
SPO = ["subject", "predicate", "object"]


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _show(df: DataFrame) -> DataFrame:
    return df.select("seq", *SPO)


@query("triples_by_subject", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql()}) WHERE s = 'order:7'")
def _(spark, d):
    return _show(g.tpch(spark, d).relations_from("order:7"))


@query("triples_by_object", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql()}) WHERE o = 'part:7'")
def _(spark, d):
    return _show(g.tpch(spark, d).relations_to("part:7"))


@query("triples_by_predicate", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql()}) WHERE p = 'customer_in'")
def _(spark, d):
    return _show(g.tpch(spark, d).triples_with_relation("customer_in"))


@query("pattern_spo", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql()}) WHERE s = 'supplier:3' AND p = 'supplies'")
def _(spark, d):
    return _show(g.tpch(spark, d).query().subject("x").subject("supplier:3").predicate("supplies").execute())


@query("pattern_exists", f"WITH t AS ({g.tpch_sql()}) SELECT (SELECT count(*) FROM t WHERE p = 'in_region' AND o = 'region:1') AS n, EXISTS (SELECT 1 FROM t WHERE o = 'region:1') AS found, EXISTS (SELECT 1 FROM t WHERE s = 'nobody') AS missing")
def _(spark, d):
    q = g.tpch(spark, d).query()
    return spark.createDataFrame([(q.predicate("in_region").object("region:1").count(), q.object("region:1").exists(), q.subject("nobody").exists())], "n long, found boolean, missing boolean")


@query("entity_list", f"WITH t AS ({g.tpch_sql()}) {g.nodes_sql()}")
def _(spark, d):
    return g.tpch(spark, d).entities().select("id", "first_seen")


@query("relation_types", f"SELECT DISTINCT p AS predicate FROM ({g.tpch_sql()})")
def _(spark, d):
    return g.tpch(spark, d).relation_types()


@query("kg_stats", f"WITH t AS ({g.tpch_sql()}), n AS ({g.nodes_sql()}) SELECT (SELECT count(*) FROM n) AS entity_count, count(*) AS triple_count, count(DISTINCT p) AS relation_type_count, round(count(*) / (SELECT count(*) FROM n), 9) AS avg_out_degree FROM t")
def _(spark, d):
    return g.tpch(spark, d).stats().withColumn("avg_out_degree", F.round("avg_out_degree", 9))


@query("neighbor_ids", f"SELECT o AS id FROM ({H}) WHERE s = '1'")
def _(spark, d):
    return g.handoff(spark, d).neighbor_ids("1")


@query("has_edge", f"SELECT EXISTS (SELECT 1 FROM ({H}) WHERE s = '1' AND o = '2') AS one_two, EXISTS (SELECT 1 FROM ({H}) WHERE s = '1' AND o = 'none') AS one_none")
def _(spark, d):
    k = g.handoff(spark, d)
    return spark.createDataFrame([(k.has_edge("1", "2"), k.has_edge("1", "none"))], "one_two boolean, one_none boolean")


@query("multigraph_degrees", f"WITH t AS ({H}) SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT s AS id, 1 AS o, 0 AS i FROM t UNION ALL SELECT o, 0, 1 FROM t) GROUP BY id")
def _(spark, d):
    return g.handoff(spark, d).degrees()


@query("remove_first_match", f"WITH t AS ({H}), f AS (SELECT s, p, o FROM t WHERE s = '1' ORDER BY seq LIMIT 1), x AS (SELECT min(seq) AS m FROM t JOIN f USING (s, p, o)) SELECT seq, s AS subject, p AS predicate, o AS object FROM t, x WHERE seq <> m")
def _(spark, d):
    k = g.handoff(spark, d)
    r = k.relations_from("1").orderBy("seq").first()
    return _show(k.remove(r["subject"], r["predicate"], r["object"])[0].triples)


@query("upsert_entities", f"WITH t AS ({H}), n AS ({g.nodes_sql()}), c AS (SELECT 'customer:' || c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT c_custkey::VARCHAR, c_name FROM customer) SELECT coalesce(n.id, c.id) AS id, label FROM n FULL JOIN c ON n.id = c.id")
def _(spark, d):
    c = g.read(spark, d, "customer")
    rows = c.select(F.explode(F.array(F.concat(F.lit("customer:"), "c_custkey"), F.col("c_custkey").cast("string"))).alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("entity_type"), F.lit(None).cast("string").alias("properties"), (F.lit(g.PLACE) + F.col("c_custkey")).alias("first_seen"))
    return g.handoff(spark, d).upsert_entities(rows).entities().select("id", "label")


@query("update_entities", f"WITH t AS ({H}), n AS ({g.nodes_sql()}) SELECT n.id, c_name AS label FROM n LEFT JOIN customer ON n.id = c_custkey::VARCHAR")
def _(spark, d):
    c = g.read(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("entity_type"), F.lit(None).cast("string").alias("properties"), (F.lit(g.PLACE) + F.col("c_custkey")).alias("first_seen"))
    return g.handoff(spark, d).update_entities(rows).entities().select("id", "label")


_EVEN, _ODD = "event_id % 2 = 0", "event_id % 3 = 0"


@query("merge_bag", f"SELECT s AS subject, p AS predicate, o AS object, count(*) AS n FROM ({g.handoff_sql(_EVEN)} UNION ALL {g.handoff_sql(_ODD)}) GROUP BY ALL")
def _(spark, d):
    return g.handoff(spark, d, _EVEN).merge(g.handoff(spark, d, _ODD)).triples.groupBy(*SPO).agg(F.count(F.lit(1)).alias("n"))


@query("diff_anti", f"WITH a AS ({g.handoff_sql(_EVEN)}), b AS ({g.handoff_sql(_ODD)}) SELECT seq, s AS subject, p AS predicate, o AS object FROM a ANTI JOIN b USING (s, p, o)")
def _(spark, d):
    return _show(g.handoff(spark, d, _EVEN).diff(g.handoff(spark, d, _ODD)).triples)


@query("intersect_semi", f"WITH a AS ({g.handoff_sql(_EVEN)}), b AS ({g.handoff_sql(_ODD)}) SELECT seq, s AS subject, p AS predicate, o AS object FROM a SEMI JOIN b USING (s, p, o)")
def _(spark, d):
    return _show(g.handoff(spark, d, _EVEN).intersection(g.handoff(spark, d, _ODD)).triples)


@query("subgraph_predicates", f"SELECT seq, s AS subject, p AS predicate, o AS object FROM ({g.tpch_sql()}) WHERE p IN ('in_region', 'supplier_in')")
def _(spark, d):
    return _show(g.tpch(spark, d).subgraph_by_predicates(["in_region", "supplier_in"]).triples)


@query("khop_subgraph", f"""WITH RECURSIVE t AS ({H}), u AS (SELECT s, o FROM t UNION SELECT o, s FROM t),
near AS (SELECT (SELECT s FROM t ORDER BY seq LIMIT 1) AS id, 0 AS k UNION SELECT u.o, k + 1 FROM near JOIN u ON u.s = near.id WHERE k < 2)
SELECT seq, s AS subject, p AS predicate, o AS object FROM t WHERE s IN (SELECT id FROM near) AND o IN (SELECT id FROM near)""")
def _(spark, d):
    k = g.handoff(spark, d)
    return _show(traverse.subgraph_around(k, k.triples.agg(F.min_by("subject", "seq")).first()[0], 2).triples)


@query("shortest_path", f"""WITH RECURSIVE t AS ({H}), n AS ({g.nodes_sql()}),
e AS (SELECT DISTINCT s, o FROM t), a AS (SELECT id FROM n ORDER BY first_seen LIMIT 1), b AS (SELECT id FROM n ORDER BY first_seen DESC LIMIT 1),
dist AS (SELECT id, 0 AS k FROM b UNION SELECT e.s, k + 1 FROM dist JOIN e ON e.o = dist.id WHERE k < 12),
near AS (SELECT id, min(k) AS k FROM dist GROUP BY id),
walk AS (SELECT a.id, near.k, 0 AS hop, NULL::VARCHAR AS back FROM a JOIN near USING (id)
  UNION ALL SELECT x.id, x.k, x.hop, x.back FROM (SELECT near.id, near.k, walk.hop + 1 AS hop, walk.id AS back, row_number() OVER (ORDER BY n.first_seen) AS r
    FROM walk JOIN e ON e.s = walk.id JOIN near ON near.id = e.o AND near.k = walk.k - 1 JOIN n ON n.id = near.id) x WHERE r = 1)
SELECT (hop - 1)::INT AS hop, back AS subject, arg_min(p, seq) AS predicate, id AS object FROM walk JOIN t ON t.s = back AND t.o = id WHERE hop > 0 GROUP BY hop, back, id""")
def _(spark, d):
    k = g.handoff(spark, d)
    ends = k.entities().agg(F.min_by("id", "first_seen"), F.max_by("id", "first_seen")).first()
    return traverse.find_path(k, *ends).select("hop", *SPO)


_DEGREE = f"""t AS ({H}), e AS (SELECT DISTINCT s, o FROM t), n AS ({g.nodes_sql()}),
deg AS (SELECT id, (SELECT count(*) FROM e WHERE o = id) AS in_degree, (SELECT count(*) FROM e WHERE s = id) AS out_degree, greatest((SELECT count(*) FROM n) - 1, 1) AS m FROM n)"""


@query("degree_centrality", f"WITH {_DEGREE} SELECT id, in_degree, out_degree, in_degree + out_degree AS total, round(in_degree / m, 9) AS in_centrality, round(out_degree / m, 9) AS out_centrality, round((in_degree + out_degree) / m, 9) AS total_normalized FROM deg")
def _(spark, d):
    out = centrality.degree_centrality(g.handoff(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in ("in_centrality", "out_centrality", "total_normalized")})


@query("top_n_degree", f"WITH {_DEGREE} SELECT id, round((in_degree + out_degree) / m, 9) AS score FROM deg ORDER BY (in_degree + out_degree) / m DESC, id LIMIT 10")
def _(spark, d):
    out = centrality.degree_centrality(g.handoff(spark, d)).select("id", F.col("total_normalized").alias("score"))
    return ranking.top_n(out, 10).withColumn("score", F.round("score", 9))


def _paths(undirected: bool) -> str:
    e = "SELECT DISTINCT s, o FROM (SELECT s, o FROM t UNION ALL SELECT o, s FROM t) WHERE s <> o" if undirected else "SELECT DISTINCT s, o FROM t WHERE s <> o"
    return f"""WITH RECURSIVE t AS ({H}), n AS ({g.nodes_sql()}), e AS ({e}),
dist AS (SELECT id AS a, id AS b, 0 AS k FROM n UNION SELECT a, e.o, k + 1 FROM dist JOIN e ON e.s = b WHERE k < 12),
near AS (SELECT a, b, min(k) AS k FROM dist GROUP BY a, b),
paths AS (SELECT id AS a, id AS b, 0 AS k, 1.0::DOUBLE AS w FROM n
  UNION ALL SELECT x.a, x.b, x.k, x.w FROM (SELECT paths.a, e.o AS b, paths.k + 1 AS k, sum(w) AS w FROM paths JOIN e ON e.s = paths.b JOIN near ON near.a = paths.a AND near.b = e.o AND near.k = paths.k + 1 GROUP BY paths.a, e.o, paths.k) x)"""


def _betweenness(undirected: bool) -> str:
    return f"""{_paths(undirected)},
through AS (SELECT x.b AS id, sum(x.w * y.w / z.w) AS c FROM paths x JOIN paths y ON y.a = x.b JOIN paths z ON z.a = x.a AND z.b = y.b AND z.k = x.k + y.k
  WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b GROUP BY x.b), m AS (SELECT count(*) AS n FROM n)
SELECT id, round(coalesce(c, 0) / ((m.n - 1) * (m.n - 2)), 9) AS score FROM n LEFT JOIN through USING (id), m"""


@query("betweenness_directed", _betweenness(False))
def _(spark, d):
    return centrality.betweenness_centrality(g.handoff(spark, d)).withColumn("score", F.round("score", 9))


@query("betweenness_undirected", _betweenness(True))
def _(spark, d):
    return centrality.betweenness_centrality(g.handoff(spark, d), undirected=True).withColumn("score", F.round("score", 9))


@query("closeness_harmonic", f"{_paths(False)}, m AS (SELECT count(*) AS n FROM n) SELECT id, round(coalesce(sum(CASE WHEN k > 0 THEN 1.0 / k END), 0) / (max(m.n) - 1), 9) AS score FROM n LEFT JOIN near ON a = id, m GROUP BY id")
def _(spark, d):
    return centrality.closeness_centrality(g.handoff(spark, d)).withColumn("score", F.round("score", 9))


@query("closeness_classic", f"{_paths(False)}, m AS (SELECT count(*) AS n FROM n) SELECT id, round(coalesce(count(*) FILTER (k > 0) / nullif(sum(k), 0) * count(*) FILTER (k > 0) / (max(m.n) - 1), 0), 9) AS score FROM n LEFT JOIN near ON a = id, m GROUP BY id")
def _(spark, d):
    return centrality.closeness_centrality(g.handoff(spark, d), harmonic=False).withColumn("score", F.round("score", 9))


@query("closeness_sketched", f"WITH t AS ({H}), n AS ({g.nodes_sql()}) SELECT count(*) AS nodes, count(*) AS near FROM n")
def _(spark, d):
    """How many nodes' sketched scores lie within a tenth of the exact ones: all."""
    k = g.handoff(spark, d)
    exact = centrality.closeness_centrality(k)
    both = exact.join(centrality.closeness_sketch(k).scores.withColumnRenamed("score", "about"), "id")
    return both.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.abs(F.col("about") - F.col("score")) <= 0.1 * F.col("score")).alias("near"))


def _power(t: str, rounds: int, body: str, start: str) -> str:
    """A recursive table v(it, id, x) of score vectors."""
    return f"""WITH RECURSIVE t AS ({t}), n AS ({g.nodes_sql()}), e AS (SELECT DISTINCT s, o FROM t), m AS (SELECT count(*) AS n FROM n),
deg AS (SELECT s AS id, count(*) AS out FROM e GROUP BY s),
v AS (SELECT 0 AS it, id, {start} AS x FROM n, m UNION ALL {body.replace('@R', str(rounds))})"""


_EIGEN = """SELECT it + 1, id, CASE WHEN sum(y * y) OVER () > 0 THEN y / sqrt(sum(y * y) OVER ()) ELSE 1 / sqrt(count(*) OVER ()) END
  FROM (SELECT max(it) AS it, id, sum(y) AS y FROM (SELECT it, id, 0.0::DOUBLE AS y FROM v UNION ALL SELECT it, e.o, v.x FROM v JOIN e ON e.s = v.id) GROUP BY id) WHERE it < @R"""


@query("eigenvector", _power(H, 8, _EIGEN, "1 / sqrt(m.n)") + " SELECT id, round(x, 9) AS score FROM v WHERE it = 8")
def _(spark, d):
    return centrality.eigenvector_centrality(g.handoff(spark, d), 8, 1e-300).scores.withColumn("score", F.round("score", 9))


_TREE = ["in_region", "supplier_in"]


@query("eigenvector_dag_reset", _power(g.tpch_sql(_TREE), 5, _EIGEN, "1 / sqrt(m.n)") + " SELECT id, round(x, 9) AS score FROM v WHERE it = 5")
def _(spark, d):
    return centrality.eigenvector_centrality(g.tpch(spark, d, _TREE), 5, 1e-300).scores.withColumn("score", F.round("score", 9))


_KATZ = """SELECT max(it) + 1, id, 0.01 * sum(y) + 1.0 FROM (SELECT it, id, 0.0::DOUBLE AS y FROM v UNION ALL SELECT it, e.o, v.x FROM v JOIN e ON e.s = v.id) GROUP BY id HAVING max(it) < @R"""


@query("katz", _power(H, 8, _KATZ, "1.0::DOUBLE") + " SELECT id, round(x / max(x) OVER (), 9) AS score FROM v WHERE it = 8")
def _(spark, d):
    return centrality.katz_centrality(g.handoff(spark, d), 0.01, 1.0, 8, 1e-300).scores.withColumn("score", F.round("score", 9))


@query("hits", f"""WITH RECURSIVE t AS ({H}), n AS ({g.nodes_sql()}), e AS (SELECT DISTINCT s, o FROM t), m AS (SELECT count(*) AS n FROM n),
v AS (SELECT 0 AS it, id, 1 / sqrt(m.n) AS h, 1 / sqrt(m.n) AS a FROM n, m UNION ALL
  (WITH ra AS (SELECT max(it) AS it, id, sum(y) AS y FROM (SELECT it, id, 0.0::DOUBLE AS y FROM v UNION ALL SELECT it, e.o, v.h FROM v JOIN e ON e.s = v.id) GROUP BY id),
   na AS (SELECT it, id, y / sqrt(sum(y * y) OVER ()) AS a FROM ra),
   rh AS (SELECT max(it) AS it, id, sum(y) AS y FROM (SELECT it, id, 0.0::DOUBLE AS y FROM na UNION ALL SELECT it, e.s, na.a FROM na JOIN e ON e.o = na.id) GROUP BY id)
   SELECT rh.it + 1, rh.id, y / sqrt(sum(y * y) OVER ()), na.a FROM rh JOIN na ON rh.id = na.id WHERE rh.it < 6))
SELECT id, round(h / sum(h) OVER (), 9) AS hub, round(a / sum(a) OVER (), 9) AS authority FROM v WHERE it = 6""")
def _(spark, d):
    return centrality.hits(g.handoff(spark, d), 6, 1e-300).scores.select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


_PR = """SELECT max(it) + 1, id, 0.15 / max(n) + 0.85 * (sum(y) + max(loose) / max(n)) FROM (
  SELECT it, v.id, 0.0::DOUBLE AS y, n, sum(CASE WHEN out IS NULL THEN x ELSE 0 END) OVER () AS loose FROM v CROSS JOIN m LEFT JOIN deg ON deg.id = v.id
  UNION ALL SELECT it, e.o, x / out, 0, 0 FROM v JOIN deg ON deg.id = v.id JOIN e ON e.s = v.id) GROUP BY id HAVING max(it) < @R"""


def _pr(t: str, rounds: int) -> str:
    return _power(t, rounds, _PR, "1.0 / m.n") + f" SELECT id, round(x, 9) AS score FROM v WHERE it = {rounds}"


def _ranks(graph: KnowledgeGraph, rounds: int) -> DataFrame:
    return ranking.pagerank(graph, ranking.PageRankConfig(0.85, rounds, 1e-300)).scores.withColumn("score", F.round("score", 9))


@query("pagerank", _pr(H, 10))
def _(spark, d):
    return _ranks(g.handoff(spark, d), 10)


@query("pagerank_dangling", _pr(g.tpch_sql(), 10))
def _(spark, d):
    return _ranks(g.tpch(spark, d), 10)


@query("pagerank_top10", f"SELECT id, score FROM ({_pr(H, 10)}) ORDER BY score DESC, id LIMIT 10")
def pagerank_top10(spark, d):
    return ranking.top_n(_ranks(g.handoff(spark, d), 10), 10)


_SEED = "(SELECT id FROM n ORDER BY first_seen LIMIT 1)"
_PPR = f"""SELECT max(it) + 1, id, CASE WHEN id = {_SEED} THEN 0.15 + 0.85 * max(loose) ELSE 0 END + 0.85 * sum(y) FROM (
  SELECT it, v.id, 0.0::DOUBLE AS y, sum(CASE WHEN out IS NULL THEN x ELSE 0 END) OVER () AS loose FROM v LEFT JOIN deg ON deg.id = v.id
  UNION ALL SELECT it, e.o, x / out, 0 FROM v JOIN deg ON deg.id = v.id JOIN e ON e.s = v.id) GROUP BY id HAVING max(it) < @R"""


def ppr_sql(t: str, rounds: int) -> str:
    """(id, x): scores of the first node seen."""
    return _power(t, rounds, _PPR, f"CASE WHEN id = {_SEED} THEN 1.0 ELSE 0.0 END::DOUBLE") + f" SELECT id, x FROM v WHERE it = {rounds}"


@query("ppr_seed", f"SELECT id, round(x, 9) AS score FROM ({ppr_sql(H, 10)})")
def _(spark, d):
    k = g.handoff(spark, d)
    seed = k.entities().agg(F.min_by("id", "first_seen")).first()[0]
    return ranking.personalized_pagerank(k, seed, ranking.PageRankConfig(0.85, 10, 1e-300)).scores.withColumn("score", F.round("score", 9))


def _reach(t: str, both: bool) -> str:
    e = "SELECT s, o FROM t UNION SELECT o, s FROM t" if both else "SELECT DISTINCT s, o FROM t"
    return f"WITH RECURSIVE t AS ({t}), n AS ({g.nodes_sql()}), e AS ({e}), r AS (SELECT id AS a, id AS b FROM n UNION SELECT a, o FROM r JOIN e ON s = b)"


# the whole graph is one component; its places and what was ordered are two sorts of them
_WCC = f"""WITH RECURSIVE t AS ({g.tpch_sql()}), n AS ({g.nodes_sql()}), e AS (SELECT s, o FROM t UNION SELECT o, s FROM t),
v AS (SELECT 0 AS it, id, id AS component FROM n UNION ALL SELECT max(it) + 1, id, min(component) FROM (
  SELECT it, id, component FROM v UNION ALL SELECT it, e.o, component FROM v JOIN e ON e.s = v.id) GROUP BY id HAVING max(it) < 12), c AS (SELECT id, component FROM v WHERE it = 12)"""


@query("wcc", f"{_WCC} SELECT * FROM c")
def _(spark, d):
    return communities.weakly_connected_components(g.tpch(spark, d))


@query("component_stats", f"{_WCC}, z AS (SELECT count(*) AS size FROM c GROUP BY component) SELECT count(*) AS num_components, max(size) AS max_size, min(size) AS min_size, round(avg(size), 9) AS avg_size, round(max(size) / sum(size), 9) AS largest_fraction FROM z")
def _(spark, d):
    out = communities.component_stats(communities.weakly_connected_components(g.tpch(spark, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("avg_size", "largest_fraction")})


@query("scc", _reach(H, False) + " SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def _(spark, d):
    return communities.strongly_connected_components(g.handoff(spark, d))


_VOTES = """SELECT it + 1, id, -max(struct_pack(n := n, l := -label)).l FROM (SELECT max(it) AS it, id, label, count(*) AS n FROM (
  SELECT it, id, label FROM v UNION ALL SELECT it, e.o, label FROM v JOIN e ON e.s = v.id) GROUP BY id, label) WHERE it < 10 GROUP BY it, id"""


@query("label_propagation", f"""WITH RECURSIVE t AS ({H}), n AS ({g.nodes_sql()}), e AS (SELECT s, o FROM t WHERE s <> o UNION SELECT o, s FROM t WHERE s <> o),
v AS (SELECT 0 AS it, id, first_seen AS label FROM n UNION ALL {_VOTES}) SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS label FROM v WHERE it = 10""")
def _(spark, d):
    return communities.label_propagation(g.handoff(spark, d), 10)


@query("pr_degree_corr", f"WITH pr AS ({_pr(H, 10)}), e AS (SELECT DISTINCT s, o FROM ({H})), deg AS (SELECT o AS id, count(*) AS k FROM e GROUP BY o) SELECT round(corr(score, k), 6) AS r FROM pr JOIN deg USING (id)")
def _(spark, d):
    k = g.handoff(spark, d)
    deg = k.directed().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return _ranks(k, 10).join(deg, "id").agg(F.round(F.corr("score", "k"), 6).alias("r"))
