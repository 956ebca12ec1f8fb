"""Typed graphs, hypergraphs, metrics, formats."""

from math import isclose

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.model import KnowledgeGraph
from graphloom.operators import kge
from graphloom.operators.hetero import HeteroGraph
from graphloom.operators.hyper import HyperGraph, entity_by_role, with_qualifier
from graphloom.sources import documents, lines, split


def triples(spark, *rows):
    return KnowledgeGraph.of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, subject string, predicate string, object string"))


def spo(df):
    return [tuple(r) for r in df.orderBy("seq").select("subject", "predicate", "object").collect()]


def test_metapath(spark):
    e = spark.createDataFrame([(0, "author", "alice", "writes", "paper", "paper1"), (1, "paper", "paper2", "cites", "paper", "paper1")], "seq long, src_type string, src string, relation string, dst_type string, dst string")
    h = HeteroGraph.build(HeteroGraph.with_reverse(e))
    path = [("author", "writes", "paper"), ("paper", "rev_cites", "paper")]
    assert h.metapath_neighbors("author", 0, path).count() == 1
    assert h.metapath_neighbors("paper", 0, path).count() == 0
    assert [tuple(r) for r in h.metapath_neighbors("author", 0, []).collect()] == [("author", 0)]
    assert h.num_nodes("paper") == 2 and h.num_edges(("paper", "rev_writes", "author")) == 1 and h.num_nodes("none") == 0


def test_reification(spark):
    plain = triples(spark, ("Einstein", "born_in", "Ulm"))
    h = spark.createDataFrame([(0, "Einstein", "won", "Nobel Prize", {"year": "1921"})], "ord long, subject string, predicate string, object string, qualifiers map<string,string>")
    e = spark.createDataFrame([(0, "award", [("recipient", "Einstein"), ("prize", "Nobel"), ("year", "1921")], None)], "ord long, relation string, bindings array<struct<role:string,entity:string>>, confidence float")
    g = HyperGraph.of(plain, h, e)
    assert g.reify_hyper_triples().count() + 1 == 6
    first = g.reify_hyperedges().orderBy("k").first()
    assert g.reify_hyperedges().count() == 4 and first["predicate"] == "rdf:type" and first["subject"] == "_:hyperedge_0"
    assert g.find_by_qualifier("year", "1921").count() == 1 and g.find_by_entity("1921").count() == 1
    assert g.fact_count() == 3 and e.select(entity_by_role("bindings", "prize")).first()[0] == "Nobel"
    assert h.select(with_qualifier(F.col("qualifiers"), "year", "1922")).first()[0] == {"year": "1922"}


def test_rank_metrics(spark):
    r = spark.createDataFrame([(x,) for x in (1, 2, 4)], "rank long")
    assert isclose(kge.metrics(r).first()["mrr"], 0.5833333333333334)
    r = spark.createDataFrame([(x,) for x in (1, 2, 5, 10, 20)], "rank long")
    m = kge.metrics(r).first()
    assert isclose(m["hits_at_10"], 0.8) and isclose(m["hits_at_1"], 0.2)
    assert kge.metrics(r.limit(0)).first()["mrr"] == 0.0
    with pytest.raises(Exception, match="rank 0"):
        kge.metrics(spark.createDataFrame([(0,)], "rank long")).collect()
    rank = lambda xs, t: kge.realistic_rank(spark.createDataFrame([("q", x, i == t) for i, x in enumerate(xs)], "query string, score float, is_true boolean")).first()["rank"]
    assert rank([0.3, 0.3, 0.3, 0.9], 0) == 2.0 and rank([0.1, 0.5, 0.9], 2) == 3.0
    a = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 4)], "rank long, candidates long")
    assert kge.adjusted_mean_rank(a).first()["amr"] == 1.0


def test_filter_index_and_vocab(spark):
    d = spark.createDataFrame([("train", 0, "a", "r1", "b"), ("train", 1, "a", "r1", "c"), ("train", 2, "b", "r2", "c"), ("valid", 0, "a", "r2", "c"), ("test", 0, "c", "r1", "a")], "split string, pos long, head string, relation string, tail string")
    i = kge.filter_index(d)
    assert i.count() == 5 and kge.contains(i, "a", "r1", "b")
    assert kge.known_tails(i).where("head = 'a' AND relation = 'r1'").first()["tails"] == ["b", "c"]
    assert {r["name"]: r["id"] for r in kge.vocab(d, "entity").collect()} == {"a": 0, "b": 1, "c": 2}


def test_lenient_and_strict_ntriples(spark, tmp_path):
    f = tmp_path / "x.nt"
    f.write_text("# c\n<http://e/a> <http://e/p> <http://e/b> .\nbad line\n\n<http://e/a> <http://e/p> \"v\"@fr-CA .\n<http://e/a> <http://e/p> .\n")
    k, skipped = lines.read_ntriples_lenient(spark, str(f))
    assert skipped == 2 and spo(k.triples) == [("http://e/a", "http://e/p", "http://e/b"), ("http://e/a", "http://e/p", '"v"@fr-ca')]
    with pytest.raises(lines.ParseError, match="line 3"):
        lines.read_ntriples_strict(spark, str(f))
    assert lines.read_folder(spark, str(tmp_path)).triple_count() == 2


@pytest.mark.parametrize("name", ['Alice "A"', "related to", 'café "central"', "東京", "", "a%b", "x" * 2000])
def test_local_names_round_trip(spark, name):
    k = triples(spark, (name or "s", "knows", name or "s"))
    assert spo(lines.parse(lines.ntriples_lines(k.triples)).where("ok")) == spo(k.triples)


def test_literals(spark):
    rows = ['"chat"@fr-CA', '"42"^^<http://www.w3.org/2001/XMLSchema#integer>', '"a \\"q\\" b\\n"', '"broken']
    out = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "o string").select(terms.render_object(F.col("o"))).collect()]
    assert out[1] == rows[1] and out[2] == rows[2] and out[3].startswith("<urn:local:")
    assert terms.parse_literal('"a"b"') == ('a"b', None, None)
    assert terms.percent_decode("%GG") is None and terms.unescape("\\q") is None


def test_nquads(spark, tmp_path):
    f = tmp_path / "x.nq"
    f.write_text("<http://e/a> <http://e/p> <http://e/b> <http://e/g> .\n<http://e/a> <http://e/p> _:x .\n")
    q = lines.read_nquads(spark, str(f))
    assert lines.graph_of(q, "http://e/g").triple_count() == 1 and lines.graph_of(q, None).triple_count() == 1 and lines.merged(q).triple_count() == 2
    assert [r["value"] for r in lines.nquads_lines(q).orderBy("seq").collect()] == f.read_text().splitlines()


def test_csv_and_adjacency(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('a,"b, c",d\ne,f,g\n')
    assert spo(lines.read_csv(spark, str(f)).triples) == [("a", "b, c", "d"), ("e", "f", "g")]
    f.write_text('a,"line1\nline2",c\nd,"say ""x""",\n')
    assert [(r["subject"], r["predicate"], r["object"]) for r in lines.read_csv(spark, str(f)).triples.orderBy("seq").collect()] == [("a", "line1\nline2", "c"), ("d", 'say "x"', "")]
    f.write_text("a\nb\n")
    assert lines.read_csv(spark, str(f)).triples.count() == 0
    f.write_text("a,b\n")
    assert spo(lines.read_csv(spark, str(f)).triples) == [("a", "related_to", "b")]
    f.write_text("a,b\na,b,c\n")
    with pytest.raises(ValueError):
        lines.read_csv(spark, str(f))
    j = spark.createDataFrame([('{"h":["t","u"]}',), ('{"h":["v"]}',)], "value string").coalesce(1)
    assert spo(lines.adjacency(j).triples) == [("h", "related_to", "t"), ("h", "related_to", "u"), ("h", "related_to", "v")]
    assert sorted(r["seq"] for r in lines.adjacency(j).triples.collect()) == [0, 1, 2]


def test_order_over_many_documents(spark, tmp_path):
    """seq goes on from document to document, so one triple can be removed."""
    for i in range(3):
        (tmp_path / f"{i}.ttl").write_text(f"<urn:a{i}> <urn:p> <urn:b>, <urn:c> .")
    k = documents.read_turtle(spark, f"{tmp_path}/*.ttl")
    rows = k.triples.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(6)) and len({r["subject"] for r in rows[:2]}) == 1
    one = rows[3]
    assert k.remove(one["subject"], one["predicate"], one["object"])[0].triple_count() == 5
    d = spark.createDataFrame([('{"@id":"a","p":"x"}',), ('{"@graph":[{"@id":"b","p":["y","z"]}]}',)], "value string").coalesce(1)
    assert [(r["seq"], r["subject"], r["object"]) for r in documents.parse_jsonld(d).orderBy("seq").collect()] == [(0, "a", "x"), (1, "b", "y"), (2, "b", "z")]


def test_json_storage(spark, tmp_path):
    k = KnowledgeGraph.of(spark.createDataFrame([(0, "a", "p", "b", 0.5, "s"), (1, "a", "p", "b", None, None)], "seq long, subject string, predicate string, object string, confidence float, source string"))
    lines.save(k, f"{tmp_path}/k", "json")
    assert sorted(map(tuple, lines.load(spark, f"{tmp_path}/k", "json").triples.collect())) == sorted(map(tuple, k.triples.collect()))


def test_kge_files(spark, tmp_path):
    for s in ("train", "valid", "test"):
        (tmp_path / f"{s}.txt").write_text("# c\na\tr 1\tb\n\nc r d\n")
    d = lines.read_kge(spark, str(tmp_path))
    assert d.count() == 6 and d.where("relation = 'r 1'").count() == 3
    (tmp_path / "test.txt").write_text("a b\n")
    with pytest.raises(ValueError, match="a b"):
        lines.read_kge(spark, str(tmp_path))


def test_turtle(spark):
    text = '''@prefix e: <http://e/> . @base <http://b/> .
e:a a e:T ; e:p "x"@EN , 'y' , 1, 2.5, true ; e:q [ e:r <rel> ] .
<s> e:list ( "i" e:j ) .
_:n e:p """long
"text" """ .'''
    got = {(r[1], r[2], r[3]) for r in documents.parse_turtle(spark.createDataFrame([(text,)], "value string")).collect()}
    assert ("http://e/a", documents.RDF + "type", "http://e/T") in got and ("http://e/a", "http://e/p", '"x"@en') in got
    assert any(o == "http://b/rel" for _, _, o in got) and ("_:n", "http://e/p", '"long\\n\\"text\\" "') in got
    assert sum(p == documents.RDF + "first" for _, p, _ in got) == 2
    with pytest.raises(Exception, match="Turtle"):
        documents.parse_turtle(spark.createDataFrame([("<a> <b> .",)], "value string")).collect()


def test_jsonld(spark):
    text = '{"@graph":[{"@id":"a","@type":"T","p":{"@id":"http://e/b"},"q":["x","y"],"n":3}]}'
    got = spo(documents.parse_jsonld(spark.createDataFrame([(text,)], "value string")))
    assert sorted(got) == [("a", "p", "http://e/b"), ("a", "q", "x"), ("a", "q", "y")]
    k = triples(spark, *got)
    assert sorted(spo(documents.parse_jsonld(documents.jsonld_document(k)))) == sorted(got)


def test_exchange(spark):
    text = '{"nodes":[{"id":"Alice","node_type":"Person","name":"Alice","properties":{"age":30}},{"id":"OpenAI","node_type":"Org","name":"O"}],"edges":[{"source":"Alice","target":"OpenAI","relation":"WORKS_AT","confidence":0.7},{"source":"x","target":"Alice","relation":"r"}]}'
    d = documents.GraphDocument.from_json(spark, text)
    k = d.to_knowledge_graph()
    assert k.get_entity("Alice").first()["label"] == "Alice" and round(k.relations_from("Alice").first()["confidence"], 3) == 0.7
    assert k.relations_from("x").first()["confidence"] == 0.0 and d.node_count() == 2 and not d.is_empty()
    values = [r["value"] for r in d.cypher_lines().orderBy("part", "pos").collect()]
    assert values[0] == "CREATE (nAlice:Person {id: 'Alice', age: 30});" and "confidence: 0.700" in values[2]
    assert '"age": 30' in d.networkx_json().first()["value"] and len(d.jsonld_nodes().collect()) == 2


def test_save_and_load(spark, tmp_path):
    k = triples(spark, ("a", "p", "b"))
    lines.save(k, str(tmp_path / "g"))
    assert spo(lines.load(spark, str(tmp_path / "g")).triples) == spo(k.triples)


def test_csv_in_ranges(spark, tmp_path):
    """One file in many ranges, some of which start inside quotes, reads as it does in one."""
    import csv
    import random

    r = random.Random(2)
    part = lambda: "".join(r.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é", ""]) for _ in range(r.randrange(30)))
    rows = [(f"s{i}", part(), part()) for i in range(300)] + [("long", "x\n" * 3000, 'quo"te' * 500), ("", "", "z")]
    f = tmp_path / "x.csv"
    with open(f, "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows(rows)
    want = [tuple(x) for x in csv.reader(open(f, newline=""))]
    assert want == rows
    for parts in (1, 8, 60):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(f.stat().st_size // parts + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = [(x["subject"], x["predicate"], x["object"]) for x in lines.read_csv(spark, str(f)).triples.orderBy("seq").collect()]
            assert parts == 1 or split.lines(spark, str(f)).select("start").distinct().count() > parts // 2
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == rows
    f.write_text(',"",x\r\na,b,c\r\n\r\n', newline="")
    assert [(x["subject"], x["predicate"], x["object"]) for x in lines.read_csv(spark, str(f)).triples.orderBy("seq").collect()] == [("", "", "x"), ("a", "b", "c")]


def test_turtle_in_ranges(spark, tmp_path):
    """Ranges that start inside long strings, comments and lists; directives in the middle of the file."""
    text = "@prefix ex: <http://x.org/> . # a dot . in a comment\n"
    for i in range(60):
        text += f'ex:s{i} ex:p """line one . \n@prefix ex: <http://no.org/> .\n it\\"s "" {i}\n"""@en ; ex:q <http://y.org/a.b#{i}> , \'\'\'single\n.\n{i}\'\'\' .\n'
        text += f'ex:n{i} ex:r 1.5 , {i} , "short . # no comment" .\n'
    text += 'PREFIX ex: <http://z.org/>\n@base <http://base.org/> .\n'
    for i in range(40):
        text += f"<t{i}>\n  ex:p\n  ( ex:a{i} ex:b )\n  .ex:c{i} a ex:d .\n"
    f = tmp_path / "x.ttl"
    f.write_text(text)
    plain = documents.parse_turtle(spark.createDataFrame([(text,)], "value string")).orderBy("seq").collect()
    def named(rows):
        """Nodes without a name by order of appearance."""
        seen = {}
        return [tuple(seen.setdefault(x, f"_:{len(seen)}") if x.startswith("_:") else x for x in (r["subject"], r["predicate"], r["object"])) for r in rows]
    for parts in (1, 8, 90):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(f.stat().st_size // parts + 1))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = documents.read_turtle(spark, str(f)).triples.orderBy("seq").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert named(got) == named(plain) and len(got) == 60 * 6 + 40 * 6
    f.write_text("<a> <b> .\n")
    with pytest.raises(Exception, match="Turtle"):
        documents.read_turtle(spark, str(f)).triples.count()


def test_built_graph_counts_without_joins(spark, tmp_path):
    """A graph by name answers as the same graph by index does; counts and names join no edge to its nodes."""
    rows = [(0, "a", "x", "r", "b", "y"), (1, "a", "x", "r", "b", "y"), (2, "a", "x", "q", "a", "y"), (3, "b", "y", "r", "b", "z"), (4, "a", None, "r", "b", "y"), (5, "b", "z", "r", "b", "w")]
    e = spark.createDataFrame(rows, "seq long, src_type string, src string, relation string, dst_type string, dst string")
    h = HeteroGraph.build(e)
    h.save(str(tmp_path / "h"), "json")
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "h" / "edges").glob("part-*"))
    back = HeteroGraph.load(spark, str(tmp_path / "h"), "json")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(h.edge_counts()) and "Join" not in plan(h.to_knowledge_graph().triples)
    same = lambda f: sorted(map(tuple, f(h).collect())) == sorted(map(tuple, f(back).collect()))
    path = [("a", "r", "b"), ("b", "r", "b")]
    for f in (lambda g: g.edge_counts(), lambda g: g.out_degrees(), lambda g: g.in_degrees(), lambda g: g.edges, lambda g: g.to_knowledge_graph().triples, lambda g: g.metapath_neighbors("a", 0, path), lambda g: g.edges_from(path[0], g.nodes.select(F.col("local_idx").alias("src_idx")))):
        assert same(f)
    assert h.num_edges() == back.num_edges() == 5 and h.metapath_neighbors("a", 0, path).count() == 1
    bad = spark.createDataFrame([("a", "r", "b", 0, 0), ("a", "r", "b", 0, 1), ("a", "r", "b", 0, 99)], "src_type string, relation string, dst_type string, src_idx long, dst_idx long")
    assert h.strangers(bad).count() == back.strangers(bad).count() == 2


def test_csv_batches_equal_lines():
    """Whole batches of lines give the states, ends and texts that one line after another gives."""
    import random

    import pyarrow as pa

    r = random.Random(5)
    bulk = 0
    for _ in range(400):
        rows = ["".join(r.choice(["a", ",", '"', '""', ',"', '",', "é", "", "b"]) for _ in range(r.randrange(6))) for _ in range(r.randrange(1, 6))]
        codes = split.csv_codes(pa.array(rows, pa.string()))
        for start in (0, 1):
            state, piece, ends, texts = start, [], [], []
            for i, line in enumerate(rows):
                state, at = split.scan_csv(line, state)
                piece.append(line)
                if at:
                    ends.append(i)
                    texts.append("\n".join(piece))
                    piece = []
            if codes is not None:
                bulk += 1
                assert codes[0][start] == state and codes[1][start] == bool(ends)
                got = split.csv_bulk(pa.array(rows, pa.string()), start)
                assert got[0] == state and list(got[1]) == ends and got[2].to_pylist() == texts
    assert bulk > 100


def test_usual_statements_in_bulk(spark, tmp_path):
    """Files of plain statements are read in whole batches, in order, beside lines that need the scan;
    prefixes of a file do not reach the next."""
    (tmp_path / "ttl").mkdir()
    a = "".join(f"<s:{i}> <urn:local:p%20q> <o:{i}> ;\n    <p> <o:{i + 1}> .\n\n" for i in range(40))
    (tmp_path / "ttl" / "a.ttl").write_text("@prefix x: <x:> .\n" + a + 'x:s x:p """long .\n<a> <b> <c> .\n""" .\n' + a)
    (tmp_path / "ttl" / "b.ttl").write_text(a + "<s> <p> _:z .")
    want = [x for i in range(40) for x in ((f"s:{i}", "p q", f"o:{i}"), (f"s:{i}", "p", f"o:{i + 1}"))]
    for size in ("100000", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        try:
            got = documents.read_turtle(spark, str(tmp_path / "ttl")).triples
            assert spo(got) == want + [("x:s", "x:p", '"long .\\n<a> <b> <c> .\\n"')] + want + want + [("s", "p", "_:z")]
            assert got.select("seq").distinct().count() == got.count()
        finally:
            for c in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
                spark.conf.unset(f"spark.sql.{c}")
    (tmp_path / "ttl" / "c.ttl").write_text("x:s <p> <o> .\n")
    with pytest.raises(Exception, match="prefix"):
        documents.read_turtle(spark, str(tmp_path / "ttl")).triples.count()
    nt = ["<a:b> <urn:local:p%20q> <c:d> .", '<a:b> <a:p> "x" .', "<a> <a:p> <c:d> .", "# no", "<a:\\u0041> <a:p> <urn:local:%zz> ."]
    rows = lines.parse(spark.createDataFrame(list(enumerate(nt)), "seq long, value string")).orderBy("seq").collect()
    assert [tuple(x)[:5] for x in rows] == [(0, True, "a:b", "p q", "c:d"), (1, True, "a:b", "a:p", '"x"'), (2, False, None, None, None), (4, True, "a:A", "a:p", "urn:local:%zz")]
