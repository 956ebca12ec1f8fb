"""Whole-document formats: Turtle, JSON-LD, and the property-graph exchange document."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..model import KnowledgeGraph
from ..plans.cut import cut
from ..plans.number import numbered
from . import split
from .lines import ParseError, literal

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
DEFAULT_PREFIXES = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
XSD = "http://www.w3.org/2001/XMLSchema#"

# Turtle, writing


def _compact(c: Column, prefixes: dict[str, str]) -> Column:
    """`prefix:local` by the longest base that fits, if the rest is a plain local name."""
    out = terms.render_object(c)
    for name, base in sorted(prefixes.items(), key=lambda x: (len(x[1]), x[0])):
        rest = F.substring(c, F.lit(len(base) + 1), F.length(c))
        out = F.when(c.startswith(base) & rest.rlike(r"^[A-Za-z0-9_.\-]+$"), F.concat(F.lit(f"{name}:"), rest)).otherwise(out)
    return out


def turtle_head(prefixes: dict[str, str] | None = None) -> str:
    prefixes = DEFAULT_PREFIXES if prefixes is None else prefixes
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in sorted(prefixes.items())) + "\n"


def turtle_blocks(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(subject, value): one block a subject, a predicate and object a line, sorted."""
    prefixes = DEFAULT_PREFIXES if prefixes is None else prefixes
    t = triples.select("subject", "predicate", "object", _compact(F.col("predicate"), prefixes).alias("p"), _compact(F.col("object"), prefixes).alias("o"))
    per = t.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("predicate", "object", "p", "o"))).alias("po"))
    body = F.array_join(F.transform("po", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ")
    return per.select("subject", F.concat(_compact(F.col("subject"), prefixes), F.lit(" "), body, F.lit(" .")).alias("value"))


def write_turtle(graph: KnowledgeGraph, path: str, prefixes: dict[str, str] | None = None) -> None:
    """Text parts in order of subject; the first holds the prefixes."""
    blocks = turtle_blocks(graph.triples, prefixes)
    head = graph.triples.sparkSession.createDataFrame([(0, "", turtle_head(prefixes))], "part int, subject string, value string")
    head.unionByName(blocks.withColumn("part", F.lit(1))).orderBy("part", "subject").select("value").write.text(path)


# Turtle, reading

_TOKEN = re.compile(
    r"""(?P<ws>(?:[\x20\t\r\n]+|\#[^\n\r]*)+)
|(?P<iri><[^\x00-\x20<>"{}|^`]*>)
|(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
|(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
|(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s))
|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
|(?P<typed>\^\^)
|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
|(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)
|(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
|(?P<word>a\b|true\b|false\b)
|(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)


class _Turtle:
    """One document: a recursive reader of the token stream."""

    def __init__(self, text: str, base: str = "", prefixes: dict[str, str] | None = None, name: str = "b"):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ParseError(f"Turtle: {text[at : at + 40]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.i, self.base, self.prefixes, self.blanks, self.name = 0, base, dict(prefixes or {}), 0, name
        self.out: list[tuple[str, str, str]] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.i] if self.i < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind is not None and k != kind) or (value is not None and v != value):
            raise ParseError(f"Turtle: {v!r} where {value or kind!r} should stand")
        self.i += 1
        return v

    def iri(self, token: str) -> str:
        body = terms.unescape(token[1:-1])
        if body is None:
            raise ParseError(f"Turtle: {token!r}")
        full = urljoin(self.base, body) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", body) else body
        return terms.local_name(full)

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.name}{self.blanks}"

    def run(self) -> list[tuple[str, str, str]]:
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if kind == "directive":
                self.take()
                if v.lstrip("@").lower() == "prefix":
                    name = self.take("name")
                    self.prefixes[name[:-1]] = self.raw(self.take("iri"))
                else:
                    self.base = self.raw(self.take("iri"))
                if v.startswith("@"):
                    self.take("mark", ".")
                continue
            if (kind, v) == ("mark", "["):
                s = self.term()
                if self.peek() != ("mark", "."):
                    self.pairs(s)
            else:
                self.pairs(self.term(subject=True))
            self.take("mark", ".")
        return self.out

    def raw(self, token: str) -> str:
        body = terms.unescape(token[1:-1]) or ""
        return urljoin(self.base, body) if self.base and ":" not in body else body

    def pairs(self, s: str) -> None:
        while True:
            p = RDF + "type" if self.peek() == ("word", "a") else None
            p = (self.take() and p) if p else self.term(predicate=True)
            while True:
                self.out.append((s, p, self.term()))
                if self.peek() != ("mark", ","):
                    break
                self.take()
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.take()
            if self.peek() in (("mark", "."), ("mark", "]")):
                return

    def term(self, subject: bool = False, predicate: bool = False) -> str:
        kind, v = self.peek()
        self.i += 1
        if kind == "iri":
            return self.iri(v)
        if kind == "name":
            prefix, _, rest = v.partition(":")
            if prefix not in self.prefixes:
                raise ParseError(f"Turtle: prefix {prefix!r}")
            return terms.local_name(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest))
        if predicate:
            raise ParseError(f"Turtle: {v!r} as a predicate")
        if kind == "blank":
            return v
        if (kind, v) == ("mark", "["):
            s = self.fresh()
            if self.peek() != ("mark", "]"):
                self.pairs(s)
            self.take("mark", "]")
            return s
        if (kind, v) == ("mark", "("):
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.term())
            self.take()
            head = RDF + "nil"
            for x in reversed(items):
                s = self.fresh()
                self.out += [(s, RDF + "first", x), (s, RDF + "rest", head)]
                head = s
            return head
        if subject:
            raise ParseError(f"Turtle: {v!r} as a subject")
        if kind in ("string", "long"):
            text = terms.unescape(v[3:-3] if kind == "long" else v[1:-1])
            if text is None:
                raise ParseError(f"Turtle: {v!r}")
            if self.peek()[0] == "lang":
                return literal(text, self.take()[1:], None)
            if self.peek()[0] == "typed":
                self.take()
                return literal(text, None, self.term(predicate=True))
            return literal(text, None, None)
        if kind == "number":
            own = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return literal(v, None, XSD + own)
        if kind == "word" and v in ("true", "false"):
            return literal(v, None, XSD + "boolean")
        raise ParseError(f"Turtle: {v!r}")


#: Documents and statements of IRIs only, without escapes: most of a usual file.
_PLAIN_IRI = r'<[^\x00-\x20<>"{}|^`\\]*>'
_USUAL = re.compile(rf"\s*{_PLAIN_IRI}\s+{_PLAIN_IRI}\s+{_PLAIN_IRI}(?:\s*;\s*{_PLAIN_IRI}\s+{_PLAIN_IRI})*\s*\.\s*")
_INSIDE = re.compile(r"<([^>]*)>")


def _parsed(text: str, base: str, prefixes: dict[str, str] | None = None, name: str = "b") -> list[tuple[str, str, str]]:
    """The triples of a document; one statement of plain IRIs needs no tokens."""
    if base or not _USUAL.fullmatch(text):
        return _Turtle(text, base, prefixes, name).run()
    s, *rest = [terms.local_name(x) for x in _INSIDE.findall(text)]
    return [(s, p, o) for p, o in zip(rest[::2], rest[1::2], strict=True)]


def _turtle(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows += [(doc, k, *t) for k, t in enumerate(_parsed(text or "", base))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.string()] * 3), strict=True)], ["doc", "k", "subject", "predicate", "object"])

    return run


def parse_turtle(documents: DataFrame, base: str = "") -> DataFrame:
    """(seq, subject, predicate, object) of documents in `value`, one row each, in the order of the rows."""
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), "value").mapInArrow(_turtle(base), "doc long, k long, subject string, predicate string, object string")
    # rows still are in the order of (doc, k), in the partition of their document
    return rows.select(F.monotonically_increasing_id().alias("seq"), "subject", "predicate", "object")


def scan_turtle(line: str, state: int) -> tuple[int | None, list[int]]:
    """States 1 and 2 are inside a long string in double or single quotes; a statement ends at its dot."""
    at, ends = 0, []
    if state:
        close = re.compile(r'(?:(?:"|"")?(?:[^"\\]|\\.|\\$))*"""' if state == 1 else r"(?:(?:'|'')?(?:[^'\\]|\\.|\\$))*'''")
        m = close.match(line)
        if m is None:
            return state, []
        at = m.end()
    while at < len(line):
        m = _TOKEN.match(line, at)
        opens = line.startswith('"""', at) and 1 or line.startswith("'''", at) and 2
        if opens and (m is None or m.lastgroup != "long"):
            return opens, ends
        if m is None:
            return None, ends
        at = m.end()
        if m.group() == "." and m.lastgroup == "mark":
            ends.append(at)
    return 0, ends


_DIRECTIVE = r"(?im)^\s*@?(prefix|base)\s"


#: Lines of IRIs and one mark at most, at the end: they end a statement or not, and open and close no string.
_USUAL_LINE = rf"\A[ \t]*(?:{_PLAIN_IRI}[ \t]*)*[.;,]?\z"


def _turtle_codes(lines: pa.Array) -> tuple[list[int], list[bool]] | None:
    if not pc.all(pc.match_substring_regex(lines, _USUAL_LINE)).as_py():
        return None
    return [0, 1, 2], [pc.any(pc.ends_with(lines, ".")).as_py(), False, False]


def _turtle_bulk(lines: pa.Array, state: int) -> tuple[int, np.ndarray, pa.Array] | None:
    if state or not pc.all(pc.match_substring_regex(lines, _USUAL_LINE)).as_py():
        return None
    ends = np.flatnonzero(pc.ends_with(lines, ".").to_numpy(zero_copy_only=False))
    groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]), pa.int32()), lines)
    return 0, ends, pc.binary_join(groups, "\n")


def _statements(known: list[tuple], base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i = bisect_left(known, seq, key=lambda h: h[0])
                own_base, prefixes = known[i - 1][1:] if i else (base, {})
                # a statement is longer than the number of its triples, so the next one's numbers are above
                rows += [(seq + j, *t) for j, t in enumerate(_parsed(text, own_base, prefixes, f"s{seq}b"))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), *[pa.string()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["at", "subject", "predicate", "object"])

    return run


def read_turtle(spark: SparkSession, path: str, base: str = "") -> KnowledgeGraph:
    """A file is read in byte ranges (see split.py) and parsed by statement, in any number of tasks.

    Directives apply from where they stand to the end of their file; the statements that hold one
    reach the driver, which tells all tasks what is in force where. Nodes without a name are called by
    the place of their statement.
    """
    found, files = split.statements(spark, path, scan_turtle, 3, _turtle_codes, _turtle_bulk)
    known: list[tuple[int, str, dict[str, str]]] = []  # what is in force after each of these statements
    for r in found.where(F.col("text").rlike(_DIRECTIVE)).orderBy("seq").toLocalIterator():
        while files and files[0][0] <= r["seq"]:
            known.append((files.pop(0)[0] - 1, base, {}))
        reader = _Turtle(r["text"], *known[-1][1:])
        reader.run()
        known.append((r["seq"], reader.base, reader.prefixes))
    if known:
        known += [(at - 1, base, {}) for at, _ in files]
    # written before it is numbered: the ranges' sample and the sort read triples, not text
    rows = cut(found.select("seq", "text").mapInArrow(_statements(known, base), "at long, subject string, predicate string, object string"))
    return KnowledgeGraph.of(numbered(rows, ["at"], "seq").select("seq", "subject", "predicate", "object"))


# JSON-LD

CONTEXT = {"rdf": RDF, "rdfs": DEFAULT_PREFIXES["rdfs"], "xsd": XSD, "schema": "http://schema.org/"}


def jsonld_nodes(triples: DataFrame) -> DataFrame:
    """(subject, value): a JSON object a subject. Only http and https objects become references; a
    second object of a predicate makes an array."""
    o = F.when(F.col("object").rlike("^https?://"), F.to_json(F.struct(F.col("object").alias("@id")))).otherwise(_json_string(F.col("object")))
    per = triples.select("seq", "subject", "predicate", o.alias("o")).groupBy("subject", "predicate").agg(F.sort_array(F.collect_list(F.struct("seq", "o"))).alias("os"))
    joined = F.array_join(F.transform("os", lambda x: x["o"]), ",")
    field = F.concat(_json_string(F.col("predicate")), F.lit(":"), F.when(F.size("os") > 1, F.concat(F.lit("["), joined, F.lit("]"))).otherwise(joined))
    rows = per.groupBy("subject").agg(F.sort_array(F.collect_list(field)).alias("fields"))
    return rows.select("subject", F.concat(F.lit('{"@id":'), _json_string(F.col("subject")), F.lit(","), F.array_join("fields", ","), F.lit("}")).alias("value"))


def _json_string(c: Column) -> Column:
    """A JSON string: the value of a one-field object."""
    obj = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))
    return F.substring(obj, F.lit(6), F.length(obj) - 6)


def parse_jsonld(documents: DataFrame) -> DataFrame:
    """(seq, subject, predicate, object) of documents in `value`, in the order of the rows: the
    @graph array, or the one node.

    Fields that start with @ are skipped; objects with @id and strings become triples,
    numbers, booleans and other objects do not; a node without @id raises.
    """
    v = F.parse_json("value")
    nodes = F.variant_get(v, "$['@graph']", "array<variant>")
    one = F.when(F.variant_get(v, "$['@id']", "string").isNotNull(), F.array(v))
    rows = documents.select(F.monotonically_increasing_id().alias("doc"), "value").select("doc", F.posexplode(F.coalesce(nodes, one)).alias("i", "n"))
    node_id = F.variant_get("n", "$['@id']", "string")
    rows = rows.select("doc", "i", F.when(node_id.isNotNull(), node_id).otherwise(F.raise_error(F.lit("node without @id"))).alias("subject"), F.posexplode(F.map_entries(F.variant_get("n", "$", "map<string,variant>"))).alias("j", "f"))
    rows = rows.where("NOT startswith(f.key, '@')").select("doc", "i", "j", "subject", F.col("f.key").alias("predicate"), F.col("f.value").alias("v"))
    kind = F.schema_of_variant("v")
    values = F.when(kind.startswith("ARRAY"), F.variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    rows = rows.select("doc", "i", "j", "subject", "predicate", F.posexplode(values).alias("k", "x"))
    o = F.when(F.schema_of_variant("x") == "STRING", F.variant_get("x", "$", "string")).when(F.schema_of_variant("x").startswith("OBJECT"), F.variant_get("x", "$['@id']", "string"))
    out = rows.select("doc", "i", "j", "k", "subject", "predicate", o.alias("object")).where(F.col("object").isNotNull())
    # rows still are in the order of (doc, i, j, k), in the partition of their document
    return out.select(F.monotonically_increasing_id().alias("seq"), "subject", "predicate", "object")


def read_jsonld(spark: SparkSession, path: str) -> KnowledgeGraph:
    return KnowledgeGraph.of(parse_jsonld(spark.read.text(path, wholetext=True)))


def jsonld_document(graph: KnowledgeGraph) -> DataFrame:
    """One row: the whole document. For large graphs write the rows of jsonld_nodes instead."""
    context = ",".join(f'"{k}":"{v}"' for k, v in CONTEXT.items())
    nodes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("subject", "value"))), lambda x: x["value"]), ",")
    return jsonld_nodes(graph.triples).agg(F.concat(F.lit('{"@context":{' + context + '},"@graph":['), nodes, F.lit("]}")).alias("value"))


# the exchange document


@dataclass(frozen=True)
class GraphDocument:
    """nodes (pos, id, node_type, name, properties), edges (pos, source, target, relation, confidence
    DOUBLE, properties); properties are JSON objects as strings; metadata is a dict."""

    nodes: DataFrame
    edges: DataFrame
    metadata: dict

    @staticmethod
    def from_json(spark: SparkSession, text: str) -> GraphDocument:
        """An edge without a confidence has 0.0."""
        import json

        d = json.loads(text)
        nodes = [(i, n["id"], n.get("node_type", ""), n.get("name", ""), json.dumps(n.get("properties", {}))) for i, n in enumerate(d.get("nodes", []))]
        edges = [(i, e["source"], e["target"], e.get("relation", ""), float(e.get("confidence", 0.0)), json.dumps(e.get("properties", {}))) for i, e in enumerate(d.get("edges", []))]
        return GraphDocument(
            spark.createDataFrame(nodes, "pos long, id string, node_type string, name string, properties string"),
            spark.createDataFrame(edges, "pos long, source string, target string, relation string, confidence double, properties string"),
            d.get("metadata", {}),
        )

    @staticmethod
    def read(spark: SparkSession, path: str) -> GraphDocument:
        """Nodes and edges of a document file, by Spark's JSON functions."""
        shape = "nodes array<struct<id:string,node_type:string,name:string,properties:map<string,string>>>, edges array<struct<source:string,target:string,relation:string,confidence:double,properties:map<string,string>>>"
        doc = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
        n = doc.select(F.posexplode("d.nodes").alias("pos", "n")).select(F.col("pos").cast("long").alias("pos"), "n.id", "n.node_type", "n.name", F.coalesce(F.to_json("n.properties"), F.lit("{}")).alias("properties"))
        e = doc.select(F.posexplode("d.edges").alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), "e.source", "e.target", "e.relation", F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"), F.coalesce(F.to_json("e.properties"), F.lit("{}")).alias("properties"))
        return GraphDocument(n, e, {})

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def is_empty(self) -> bool:
        return self.nodes.isEmpty()

    def to_knowledge_graph(self) -> KnowledgeGraph:
        """Nodes become entities (the last of an id), edges triples; a confidence of 1.0 is not kept."""
        last = self.nodes.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))).where("_r = 1")
        entities = last.select(F.col("pos").alias("first_seen"), "id", F.col("name").alias("label"), F.col("node_type").alias("entity_type"), "properties")
        base = 1 << 40
        t = self.edges.select((F.col("pos") + base).alias("seq"), F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("target").alias("object"), F.when(F.col("confidence") != 1.0, F.col("confidence")).cast("float").alias("confidence"))
        return KnowledgeGraph(KnowledgeGraph.of(t).triples, entities)

    def cypher_lines(self, with_name: bool = False) -> DataFrame:
        """(part, pos, value): a CREATE a node (part 0), a MATCH and CREATE an edge (part 1).

        Scalar properties only. The name is left out unless asked for.
        """
        ident, quote = terms.cypher_identifier, terms.cypher_string
        entry = F.map_entries(F.from_json("properties", "map<string,string>"))
        kinds = F.from_json("properties", "map<string,variant>")

        def show(e: Column) -> Column:
            kind = F.schema_of_variant(F.element_at(kinds, e["key"]))
            value = F.when(kind == "STRING", F.concat(F.lit("'"), quote(e["value"]), F.lit("'"))).when(kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID"), F.lit(None).cast("string")).otherwise(e["value"])
            return F.concat(F.lit(", "), e["key"], F.lit(": "), value)

        props = F.array_join(F.filter(F.transform(F.array_sort(entry), show), lambda x: x.isNotNull()), "")
        if with_name:
            props = F.concat(F.lit(", name: '"), quote(F.col("name")), F.lit("'"), props)
        node = F.concat(F.lit("CREATE (n"), ident(F.col("id")), F.lit(":"), ident(F.col("node_type")), F.lit(" {id: '"), quote(F.col("id")), F.lit("'"), props, F.lit("});"))
        conf = F.when(F.col("confidence") < 1.0, F.format_string(" {confidence: %.3f}", F.col("confidence"))).otherwise("")
        edge = F.concat(F.lit("MATCH (a {id: '"), quote(F.col("source")), F.lit("'}), (b {id: '"), quote(F.col("target")), F.lit("'}) CREATE (a)-[:"), ident(F.col("relation")), conf, F.lit("]->(b);"))
        return self.nodes.select(F.lit(0).alias("part"), "pos", node.alias("value")).unionByName(self.edges.select(F.lit(1).alias("part"), "pos", edge.alias("value")))

    def networkx_json(self) -> DataFrame:
        """One row with node-link JSON: directed, not a multigraph, properties flattened, a confidence
        of 1.0 left out."""
        import json

        def flat(df: DataFrame, head: Column, order: str) -> DataFrame:
            rest = F.regexp_replace("properties", r"^\s*\{\s*|\s*\}\s*$", "")
            body = F.substring(head, F.lit(1), F.length(head) - 1)
            value = F.concat(body, F.when(rest != "", F.concat(F.lit(","), rest)).otherwise(""), F.lit("}"))
            gathered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
            return df.agg(F.array_join(F.transform(gathered, lambda x: x["v"]), ",").alias("v"))

        n = flat(self.nodes, F.to_json(F.struct("id", F.col("node_type").alias("type"), "name")), "pos").select(F.col("v").alias("n"))
        e = flat(self.edges, F.to_json(F.struct("source", "target", "relation", F.when(F.abs(F.col("confidence") - 1.0) >= 2.220446049250313e-16, F.col("confidence")).alias("confidence"))), "pos").select(F.col("v").alias("e"))
        graph = json.dumps(self.metadata)
        return n.crossJoin(e).select(F.concat(F.lit(f'{{"directed":true,"multigraph":false,"graph":{graph},"nodes":['), "n", F.lit('],"links":['), "e", F.lit("]}")).alias("value"))  # one row each

    def jsonld_nodes(self) -> DataFrame:
        """(pos, value): a JSON object a node with its edges inside; edges of undeclared nodes vanish."""
        per = self.edges.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("pos", "relation", "target"))).alias("r"))
        joined = self.nodes.join(per, self.nodes["id"] == per["source"], "left")
        relations = F.transform("r", lambda x: F.struct(x["relation"].alias("@type"), x["target"].alias("target")))
        return joined.select("pos", F.to_json(F.struct(F.col("id").alias("@id"), F.col("node_type").alias("@type"), "name", relations.alias("relations"))).alias("value"))

    def export(self, kind: str) -> DataFrame:
        """`cypher`, `networkx` or `json-ld`."""
        return {"cypher": self.cypher_lines, "networkx": self.networkx_json, "json-ld": self.jsonld_nodes}[kind]()
