"""Line formats: N-Triples and N-Quads, delimited triples, JSON adjacency, dataset files.

Readers scan text in parallel and return tables; a line parser runs in Arrow batches.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..model import ENTITY_SCHEMA, TRIPLE_SCHEMA, KnowledgeGraph
from ..plans.iterate import observed
from . import split

_IRI = r"<(?P<{0}>[^\x00-\x20<>\"{{}}|^`\\]*(?:\\u[0-9A-Fa-f]{{4}}[^\x00-\x20<>\"{{}}|^`\\]*|\\U[0-9A-Fa-f]{{8}}[^\x00-\x20<>\"{{}}|^`\\]*)*)>"
_BLANK = r"_:(?P<{0}>[^\s<>\"]+?)"
_LITERAL = r'"(?P<lex>(?:[^"\\\n\r]|\\.)*)"(?:@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^' + _IRI.format("dt") + ")?"
_STATEMENT = re.compile(
    rf"\s*(?:{_IRI.format('si')}|{_BLANK.format('sb')})\s*{_IRI.format('pi')}\s*(?:{_IRI.format('oi')}|{_BLANK.format('ob')}|{_LITERAL})\s*(?:(?:{_IRI.format('gi')}|{_BLANK.format('gb')})\s*)?\.\s*"
)
_COMMENT = re.compile(r"(?:#.*)?\Z", re.S)


def _iri(body: str) -> str | None:
    text = terms.unescape(body)
    return None if text is None or ":" not in text else terms.local_name(text)


def parse_line(line: str, quads: bool = False) -> tuple[str, list[tuple[str, str, str, str | None]]]:
    """(status, statements): `blank`, `ok` or `bad`."""
    text = line.strip()
    if not text or text.startswith("#"):
        return "blank", []
    found, at = [], 0
    while not _COMMENT.match(text, at):
        m = _STATEMENT.match(text, at)
        if m is None:
            return "bad", []
        at = m.end()
        s = "_:" + m["sb"] if m["sb"] is not None else _iri(m["si"])
        p = _iri(m["pi"])
        if m["lex"] is not None:
            lexical = terms.unescape(m["lex"])
            datatype = _iri(m["dt"]) if m["dt"] is not None else None
            o = None if lexical is None or (m["dt"] is not None and datatype is None) else literal(lexical, m["lang"], datatype)
        else:
            o = "_:" + m["ob"] if m["ob"] is not None else _iri(m["oi"])
        graph = "_:" + m["gb"] if m["gb"] is not None else _iri(m["gi"]) if m["gi"] is not None else None
        if s is None or p is None or o is None or (graph is not None and not quads):
            return "bad", []
        found.append((s, p, o, graph))
    return "ok", found


def literal(lexical: str, lang: str | None, datatype: str | None) -> str:
    """The N-Triples form; languages in lower case, xsd:string left out."""
    body = '"' + lexical.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
    if lang:
        return f"{body}@{lang.lower()}"
    return f"{body}^^<{datatype}>" if datatype and datatype != terms.XSD_STRING else body


#: Statements of three IRIs without escapes, one space between: most of a usual file.
_BODY = r'[^\x00-\x20<>"{}|^`\\:]*:[^\x00-\x20<>"{}|^`\\]*'
_USUAL = rf"\A<(?P<subject>{_BODY})> <(?P<predicate>{_BODY})> <(?P<object>{_BODY})> \.\z"


def _named(column: pa.Array) -> pa.Array:
    """IRIs as ids, each different one read once where any is local."""
    if not pc.any(pc.starts_with(column, terms.LOCAL)).as_py():
        return column
    d = pc.dictionary_encode(column)
    return pa.array([terms.local_name(x) for x in d.dictionary.to_pylist()], pa.string()).take(d.indices)


class ParseError(ValueError):
    """A line that is no statement; names the line."""


def _parser(quads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usual = pc.extract_regex(batch.column("value"), _USUAL)
            hit = usual.is_valid()
            found = usual.filter(hit)
            if len(found):
                none = pa.nulls(len(found), pa.string())
                spo = [_named(found.field(c)) for c in ("subject", "predicate", "object")]
                yield pa.RecordBatch.from_arrays([batch.column("seq").filter(hit), pa.array(np.ones(len(found), bool)), *spo, none, none], ["seq", "ok", "subject", "predicate", "object", "graph", "line"])
            if len(found) == len(batch):
                continue
            batch, rows = batch.filter(pc.invert(hit)), []
            for line, seq in zip(batch.column("value").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                status, found = parse_line(line, quads)
                if status == "bad" or (status == "ok" and not quads and len(found) > 1):
                    rows.append((seq, False, None, None, None, None, line))
                elif found:
                    rows.append((seq, True, *found[-1], None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.bool_(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["seq", "ok", "subject", "predicate", "object", "graph", "line"])

    return run


def scan(spark: SparkSession, path: str, quads: bool = False) -> DataFrame:
    """(seq, ok, subject, predicate, object, graph, line) for each statement or bad line.

    seq grows with the place in the file and the file's place in the scan.
    """
    text = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return text.select("value", "seq").mapInArrow(_parser(quads), "seq long, ok boolean, subject string, predicate string, object string, graph string, line string")


def parse(lines: DataFrame, quads: bool = False) -> DataFrame:
    """The same for a table (seq, value) of lines."""
    return lines.select("value", F.col("seq").cast("long")).mapInArrow(_parser(quads), "seq long, ok boolean, subject string, predicate string, object string, graph string, line string")


def read_ntriples(spark: SparkSession, path: str) -> KnowledgeGraph:
    """Lenient: lines that are no statement are left out."""
    return KnowledgeGraph.of(scan(spark, path).where("ok"))


def read_ntriples_lenient(spark: SparkSession, path: str) -> tuple[KnowledgeGraph, int]:
    """With the number of lines left out; blank and comment lines do not count."""
    rows = scan(spark, path)
    return KnowledgeGraph.of(rows.where("ok")), rows.where("NOT ok").count()


def read_ntriples_strict(spark: SparkSession, path: str) -> KnowledgeGraph:
    """Raises ParseError with the first bad line and its number (from 1)."""
    rows = scan(spark, path)
    bad = rows.where("NOT ok").orderBy("seq").select("seq", "line").first()
    if bad is not None:
        before = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where(F.col("seq") < bad["seq"]).count()
        raise ParseError(f"line {before + 1}: {bad['line']}")
    return KnowledgeGraph.of(rows)


def read_folder(spark: SparkSession, folder: str) -> KnowledgeGraph:
    """All *.nt files directly in the folder, each read leniently, merged as a bag."""
    text = spark.read.option("pathGlobFilter", "*.nt").text(folder).withColumn("seq", F.monotonically_increasing_id())
    return KnowledgeGraph.of(parse(text).where("ok"))


def read_nquads(spark: SparkSession, path: str) -> DataFrame:
    """(seq, subject, predicate, object, graph), strict; graph is null for the default graph."""
    rows = scan(spark, path, quads=True)
    bad = rows.where("NOT ok").orderBy("seq").select("line").first()
    if bad is not None:
        raise ParseError(bad["line"])
    return rows.drop("ok", "line")


def graph_of(quads: DataFrame, name: str | None) -> KnowledgeGraph:
    return KnowledgeGraph.of(quads.where(F.col("graph").eqNullSafe(F.lit(name))))


def merged(quads: DataFrame) -> KnowledgeGraph:
    return KnowledgeGraph.of(quads.drop("graph"))


def ntriples_lines(triples: DataFrame, bare_predicate: bool = True) -> DataFrame:
    """(seq, value): statements as lines. With bare_predicate False, a blank or bracketed predicate
    is written as it is, as single triples are; documents always write an IRI."""
    p = F.concat(F.lit("<"), terms.iri_body(F.col("predicate")), F.lit(">")) if bare_predicate else terms.render_iri_or_blank(F.col("predicate"))
    return triples.select("seq", F.concat(terms.render_iri_or_blank(F.col("subject")), F.lit(" "), p, F.lit(" "), terms.render_object(F.col("object")), F.lit(" .")).alias("value"))


def nquads_lines(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("graph").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), terms.render_iri_or_blank(F.col("graph"))))
    line = F.concat(terms.render_iri_or_blank(F.col("subject")), F.lit(" <"), terms.iri_body(F.col("predicate")), F.lit("> "), terms.render_object(F.col("object")), graph, F.lit(" ."))
    return quads.select("seq", line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files, in order of seq; one part after another is the document."""
    lines.orderBy("seq").select("value").write.text(path)


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        texts = batch.column("text")
        if not pc.any(pc.match_substring_regex(texts, r'["\r\n]')).as_py():
            # commas are all there is; an empty line is no record
            rows = pc.if_else(pc.equal(texts, ""), pa.scalar([], pa.list_(pa.string())), pc.split_pattern(texts, ","))
        else:
            rows = pa.array(_read([t.removeprefix("\n").removesuffix("\n").removesuffix("\r") for t in texts.to_pylist()]), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("seq"), rows], ["seq", "f"])


def _read(texts: list[str]) -> list[list[str]]:
    """The fields of each text: by one reader if it finds a record a text, else by a reader for each."""
    if not any("\r" in t for t in texts):
        try:
            rows = list(csv.reader(texts))
            if len(rows) == len(texts):
                return rows
        except csv.Error:
            pass
    return [next(csv.reader(io.StringIO(t, newline="")), []) for t in texts]


def read_csv(spark: SparkSession, path: str) -> KnowledgeGraph:
    """No header: three or more columns give subject, predicate, object; two get `related_to`; a file
    of one column gives nothing. Quoted fields may hold commas, line breaks and doubled quotes. An empty
    field is an empty string, an empty line is none. Rows of different widths raise. A file is read in
    byte ranges (see split.py), in any number of tasks."""
    found, _ = split.statements(spark, path, split.scan_csv, 2, split.csv_codes, split.csv_bulk)
    rows = found.mapInArrow(_fields, "seq long, f array<string>").where("size(f) > 0")
    n = F.size("f")
    rows, m = observed(rows, first=F.min_by(n, "seq"), low=F.min(n), high=F.max(n))
    width = m["first"] or 0
    if m["low"] != m["high"]:
        bad = rows.where(n != width).orderBy("seq").select("f").first()
        raise ValueError(f"not {width} fields: {bad['f']}")
    if width < 2:
        return KnowledgeGraph.empty(spark)
    f = lambda i: F.get("f", F.lit(i))
    predicate, tail = (f(1), f(2)) if width > 2 else (F.lit("related_to"), f(1))
    return KnowledgeGraph.of(rows.select("seq", f(0).alias("subject"), predicate.alias("predicate"), tail.alias("object")))


def adjacency(json: DataFrame) -> KnowledgeGraph:
    """From documents in `value` holding {head: [tail, ...]}, in the order of the rows; the predicate
    is `related_to`."""
    heads = json.select(F.monotonically_increasing_id().alias("doc"), "value").select("doc", F.posexplode(F.map_entries(F.from_json("value", "map<string,array<string>>"))).alias("i", "e"))
    pairs = heads.select("doc", "i", F.col("e.key").alias("subject"), F.posexplode("e.value").alias("j", "object"))
    # rows still are in the order of (doc, i, j), in the partition of their document
    return KnowledgeGraph.of(pairs.select(F.monotonically_increasing_id().alias("seq"), "subject", F.lit("related_to").alias("predicate"), "object"))


def read_adjacency(spark: SparkSession, path: str) -> KnowledgeGraph:
    return adjacency(spark.read.text(path, wholetext=True))


def read_kge_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """(split, pos, head, relation, tail) of a tab- or space-separated file; a row without exactly
    three fields raises with its text; blank and # lines are left out."""
    v = F.trim("value")
    text = spark.read.text(path).select(v.alias("value"), F.monotonically_increasing_id().alias("pos")).where("value <> '' AND NOT startswith(value, '#')")
    f = F.when(F.col("value").contains("\t"), F.split("value", "\t")).otherwise(F.split("value", r"\s+"))
    rows = text.select("pos", "value", f.alias("f"))
    bad = rows.where("size(f) <> 3").orderBy("pos").first()
    if bad is not None:
        raise ValueError(f"{path}: not three fields: {bad['value']}")
    return rows.select(F.lit(split).alias("split"), "pos", *[F.trim(F.get("f", F.lit(i))).alias(c) for i, c in enumerate(("head", "relation", "tail"))])


def read_kge(spark: SparkSession, folder: str) -> DataFrame:
    """train.txt, valid.txt and test.txt of a folder."""
    parts = [read_kge_split(spark, f"{folder}/{s}.txt", s) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def save(graph: KnowledgeGraph, folder: str, form: str = "parquet") -> None:
    """The graph as two tables; `form` is `parquet` or `json` (an object a line)."""
    graph.triples.write.format(form).save(f"{folder}/triples")
    graph.entities().write.format(form).save(f"{folder}/entities")


def load(spark: SparkSession, folder: str, form: str = "parquet") -> KnowledgeGraph:
    return KnowledgeGraph(*[spark.read.format(form).schema(schema).load(f"{folder}/{name}") for name, schema in (("triples", TRIPLE_SCHEMA), ("entities", ENTITY_SCHEMA))])
