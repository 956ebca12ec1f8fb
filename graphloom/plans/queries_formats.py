"""Driver queries on formats: rendering, reading back, exchange documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import terms
from ..model import KnowledgeGraph
from ..sources import documents, lines
from . import graphs as g
from .cut import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


_T = f"t AS ({g.tpch_sql()})"
_IRI = "'<' || {0} || '>'"
_LOCAL = "'<urn:local:' || {0} || '>'"


def _places(spark, d) -> KnowledgeGraph:
    return g.tpch(spark, d)


@query("ntriples_render", f"WITH {_T} SELECT seq, {_IRI.format('s')} || ' ' || {_LOCAL.format('p')} || ' ' || {_IRI.format('o')} || ' .' AS value FROM t")
def _(spark, d):
    return lines.ntriples_lines(_places(spark, d).triples)


@query("ntriples_roundtrip", f"WITH {_T} SELECT seq, s AS subject, p AS predicate, o AS object FROM t")
def _(spark, d):
    return lines.parse(lines.ntriples_lines(_places(spark, d).triples)).where("ok").select("seq", "subject", "predicate", "object")


@query("ntriples_skipped", "SELECT count(*) FILTER (item_id % 3 = 0) AS loaded, count(*) FILTER (item_id % 3 = 1) AS skipped FROM benchmark")
def _(spark, d):
    b = g.read(spark, d, "benchmark")
    good = F.concat(F.lit("<urn:x:a> <urn:x:p> "), F.lit('"'), terms.escape_literal(F.col("text")), F.lit('" .'))
    text = F.when(F.col("item_id") % 3 == 0, good).when(F.col("item_id") % 3 == 1, F.concat(F.lit("<urn:x:a> "), F.regexp_replace("text", "[\r\n]", " "))).otherwise("# a comment")
    rows = lines.parse(b.select(F.col("item_id").alias("seq"), text.alias("value")))
    return rows.agg(F.count_if("ok").alias("loaded"), F.count_if(~F.col("ok")).alias("skipped"))


@query("literal_roundtrip", "SELECT item_id, sha256(text) AS text_sha256 FROM benchmark")
def _(spark, d):
    b = g.read(spark, d, "benchmark")
    t = KnowledgeGraph.of(b.select(F.col("item_id").alias("seq"), F.lit("a").alias("subject"), F.lit("says").alias("predicate"), terms.render_literal(F.col("text"), F.lit(None), F.lit(None)).alias("object")))
    back = lines.parse(lines.ntriples_lines(t.triples)).where("ok")
    return back.select(F.col("seq").alias("item_id"), F.sha2(terms.literal_parts(F.col("object"))["lexical"], 256).alias("text_sha256"))


@query("nquads_by_graph", f"WITH {_T} SELECT CASE WHEN p = 'in_region' THEN NULL ELSE p END AS graph, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    q = _places(spark, d).triples.withColumn("graph", F.when(F.col("predicate") != "in_region", F.col("predicate")))
    return lines.parse(lines.nquads_lines(q), quads=True).where("ok").groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


_W = f"t AS ({g.tpch_sql()})"


@query("adjacency_json", f"WITH {_W} SELECT s AS subject, 'related_to' AS predicate, o AS object FROM t")
def _(spark, d):
    t = g.tpch(spark, d).triples.groupBy("subject").agg(F.collect_list("object").alias("o"))
    json = t.select(F.to_json(F.create_map("subject", "o")).alias("value"))
    return lines.adjacency(json).triples.select("subject", "predicate", "object")


@query("turtle_roundtrip", f"WITH {_W} SELECT s AS subject, p AS predicate, o AS object FROM t")
def _(spark, d):
    prefixes = {"n": "nation:", "s": "supplier:"}
    text = documents.turtle_blocks(g.tpch(spark, d).triples, prefixes)  # a document for each subject
    return documents.parse_turtle(text.select(F.concat(F.lit(documents.turtle_head(prefixes)), "value").alias("value"))).select("subject", "predicate", "object")


@query("jsonld_roundtrip", f"WITH {_W} SELECT s AS subject, p AS predicate, o AS object FROM t")
def _(spark, d):
    return documents.parse_jsonld(documents.jsonld_nodes(g.tpch(spark, d).triples)).select("subject", "predicate", "object")


def _document(spark, d) -> documents.GraphDocument:
    n = g.read(spark, d, "nation")
    r = g.read(spark, d, "region")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("Nation").alias("node_type"), F.col("n_name").alias("name"), F.to_json(F.struct(F.col("n_nationkey").alias("key"))).alias("properties"))
    nodes = nodes.unionByName(r.select((F.col("r_regionkey") + 1000).cast("long").alias("pos"), F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit("Region").alias("node_type"), F.col("r_name").alias("name"), F.lit("{}").alias("properties")))
    edges = n.select(F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("nation:"), "n_nationkey").alias("source"), F.concat(F.lit("region:"), "n_regionkey").alias("target"), F.lit("in region").alias("relation"), F.when(F.col("n_nationkey") % 2 == 0, 1.0).otherwise(0.5).alias("confidence"), F.lit("{}").alias("properties"))
    return documents.GraphDocument(nodes, edges, {})


@query("exchange_to_kg", "SELECT 'nation:' || n_nationkey AS subject, 'in region' AS predicate, 'region:' || n_regionkey AS object, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 0.5 END::FLOAT AS confidence FROM nation")
def _(spark, d):
    return _document(spark, d).to_knowledge_graph().triples.select("subject", "predicate", "object", "confidence")


@query("cypher_export", r"""SELECT 0 AS part, n_nationkey::BIGINT AS pos, 'CREATE (nnation_' || n_nationkey || ':Nation {id: ''nation:' || n_nationkey || ''', key: ' || n_nationkey || '});' AS value FROM nation
UNION ALL SELECT 0, r_regionkey + 1000, 'CREATE (nregion_' || r_regionkey || ':Region {id: ''region:' || r_regionkey || '''});' FROM region
UNION ALL SELECT 1, n_nationkey, 'MATCH (a {id: ''nation:' || n_nationkey || '''}), (b {id: ''region:' || n_regionkey || '''}) CREATE (a)-[:in_region' || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' {confidence: 0.500}' END || ']->(b);' FROM nation""")
def _(spark, d):
    return _document(spark, d).cypher_lines()


@query("networkx_export", "SELECT (SELECT count(*) FROM nation)::INT AS links, (SELECT count(*) FROM nation)::INT + (SELECT count(*) FROM region)::INT AS nodes")
def _(spark, d):
    json = _document(spark, d).networkx_json()
    v = F.from_json("value", "nodes array<map<string,string>>, links array<map<string,string>>, directed boolean, multigraph boolean")
    return json.select(v.alias("v")).select(F.size("v.links").alias("links"), F.size("v.nodes").alias("nodes"))


@query("jsonld_export", "SELECT (SELECT count(*) FROM nation)::INT + (SELECT count(*) FROM region)::INT AS n, (SELECT count(*) FROM nation)::INT AS links")
def _(spark, d):
    nodes = _document(spark, d).jsonld_nodes()
    return nodes.agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("value").contains("region:") & F.col("value").contains("nation:")).cast("int").alias("links"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("csv_two_col", f"WITH {_W} SELECT s AS subject, 'related_to' AS predicate, o || ',' || chr(10) AS object FROM t")
def _(spark, d):
    at = _folder(spark)
    g.tpch(spark, d).triples.select(F.concat_ws(",", "subject", F.concat(F.lit('"'), "object", F.lit(',\n"')))).write.text(at)
    return lines.read_csv(spark, at).triples.select("subject", "predicate", "object")


@query("csv_three_col", f"WITH {_W} SELECT s AS subject, p AS predicate, o AS object FROM t")
def _(spark, d):
    at = _folder(spark)
    g.tpch(spark, d).triples.select(F.concat_ws(",", "subject", "predicate", "object")).write.text(at)
    return lines.read_csv(spark, at).triples.select("subject", "predicate", "object")


@query("csv_texts", "SELECT doc_id::VARCHAR AS subject, coalesce(lang, '') AS predicate, sha256(coalesce(text, '')) AS object FROM documents")
def _(spark, d):
    at = _folder(spark)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    g.read(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.col("lang")), quoted(F.col("text")))).write.text(at)
    return lines.read_csv(spark, at).triples.select("subject", "predicate", F.sha2("object", 256).alias("object"))


@query("turtle_files", f"WITH {_W} SELECT s AS subject, p AS predicate, o AS object FROM t")
def _(spark, d):
    at = _folder(spark)
    documents.turtle_blocks(g.tpch(spark, d).triples, {}).select("value").write.text(at)
    return documents.read_turtle(spark, at).triples.select("subject", "predicate", "object")


@query("kge_files", f"SELECT 'train' AS split, s AS head, p AS relation, o AS tail FROM ({g.handoff_sql()})")
def _(spark, d):
    at = _folder(spark)
    g.handoff(spark, d).triples.select(F.concat_ws("\t", "subject", "predicate", "object")).write.text(at)
    return lines.read_kge_split(spark, at).select("split", "head", "relation", "tail")


@query("json_roundtrip", f"WITH t AS ({g.handoff_sql()}) SELECT seq, s AS subject, p AS predicate, o AS object, (seq % 10 / 10)::FLOAT AS confidence FROM t")
def _(spark, d):
    at = _folder(spark)
    lines.save(g.handoff(spark, d), at, "json")
    return lines.load(spark, at, "json").triples.select("seq", "subject", "predicate", "object", "confidence")


@query("ntriples_files", f"WITH {_W} SELECT seq_of.n AS triples, (SELECT count(DISTINCT (s, p, o)) FROM t) AS different, seq_of.n AS strict FROM (SELECT count(*) AS n FROM t) seq_of")
def _(spark, d):
    at = _folder(spark)
    lines.ntriples_lines(g.tpch(spark, d).triples).select("value").write.text(at)
    t = lines.read_ntriples(spark, at).triples
    strict = lines.read_ntriples_strict(spark, at).triples.agg(F.count(F.lit(1)).alias("strict"))
    return t.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("subject", "predicate", "object").alias("different")).crossJoin(strict)  # one row each


@query("graph_changes", f"WITH t AS ({g.handoff_sql()}) SELECT (SELECT count(*) FROM t) + (SELECT count(*) FROM nation) AS added, 0::BIGINT AS cleared, (SELECT count(*) FROM t WHERE s = '1') AS neighbors")
def _(spark, d):
    k = g.handoff(spark, d)
    top = k.triples.agg((F.max("seq") + 1).alias("top"))
    more = g.tpch(spark, d, ["in_region"]).triples.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("top")).drop("top")  # one row
    added = k.add(more).triples.agg(F.count(F.lit(1)).alias("added"))
    cleared = k.clear().triples.agg(F.count(F.lit(1)).alias("cleared"))
    return added.crossJoin(cleared).crossJoin(k.neighbors("1").agg(F.count(F.lit(1)).alias("neighbors")))  # one row each


@query("binary_roundtrip", f"WITH t AS ({g.handoff_sql()}) SELECT seq, s AS subject, p AS predicate, o AS object, (seq % 10 / 10)::FLOAT AS confidence FROM t")
def _(spark, d):
    at = _folder(spark)
    lines.save(g.handoff(spark, d), at)
    return lines.load(spark, at).triples.select("seq", "subject", "predicate", "object", "confidence")


@query("hetero_files", f"WITH t AS ({g.tpch_sql()}) SELECT split_part(id, ':', 1) AS node_type, count(*) AS n FROM ({g.nodes_sql()}) GROUP BY 1")
def _(spark, d):
    from ..operators.hetero import HeteroGraph

    t = g.tpch(spark, d).triples
    kind = lambda c: F.substring_index(c, ":", 1)
    h = HeteroGraph.build(t.select("seq", kind("subject").alias("src_type"), F.col("subject").alias("src"), F.col("predicate").alias("relation"), kind("object").alias("dst_type"), F.col("object").alias("dst")))
    at = _folder(spark)
    h.save(at, "json")
    return HeteroGraph.load(spark, at, "json").node_counts()
