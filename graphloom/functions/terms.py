"""RDF terms as column expressions, with the few steps that need a scan in Arrow batches.

Ids are strings: blank nodes start with `_:`, literals are in N-Triples form, everything
else is an IRI or a local name. Local names get the prefix LOCAL and percent encoding.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

LOCAL = "urn:local:"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:[\s\S]+$"
_SAFE = re.compile(r"[A-Za-z0-9\-._~]")


def is_absolute_iri(c: Column) -> Column:
    return c.rlike(_ABSOLUTE)


def percent_encode(c: Column) -> Column:
    """All bytes but `[A-Za-z0-9-._~]`, as %XX."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_iri(c: Column) -> Column:
    r"""`<>"{}^|` backtick, backslash and everything up to U+0020 as \uXXXX."""
    out = F.replace(c, F.lit("\\"), F.lit("\\u005C"))
    for ch in '<>"{}^|`' + "".join(map(chr, range(0x21))):
        out = F.replace(out, F.lit(ch), F.lit(f"\\u{ord(ch):04X}")) if ch != "\\" else out
    return F.when(c.rlike(r'[<>"{}^|`\\\x00-\x20]'), out).otherwise(c)


def iri_body(c: Column) -> Column:
    """An absolute IRI escaped, a local name with the prefix."""
    return F.when(is_absolute_iri(c), escape_iri(c)).otherwise(F.concat(F.lit(LOCAL), percent_encode(c)))


def escape_literal(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def render_literal(lexical: Column, lang: Column, datatype: Column) -> Column:
    """A language wins over a datatype."""
    body = F.concat(F.lit('"'), escape_literal(lexical), F.lit('"'))
    return F.when(lang.isNotNull(), F.concat(body, F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(body, F.lit("^^<"), escape_iri(datatype), F.lit(">"))).otherwise(body)


_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_ESCAPE = re.compile(r"\\(?:([tbnrf\"'\\])|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.?))", re.S)


def unescape(text: str | None) -> str | None:
    r"""Undo \t \b \n \r \f \" \' \\ \uXXXX \UXXXXXXXX; None for any other escape."""
    if text is None or "\\" not in text:
        return text
    bad = False

    def one(m: re.Match) -> str:
        nonlocal bad
        if m[1]:
            return _ESCAPES[m[1]]
        code = int(m[2] or m[3] or "0", 16) if m[2] or m[3] else None
        if code is None or code > 0x10FFFF or 0xD800 <= code < 0xE000:
            bad = True
            return ""
        return chr(code)

    out = _ESCAPE.sub(one, text)
    return None if bad else out


_SUFFIX = re.compile(r"(?:@(?P<lang>.*)|\^\^<(?P<datatype>.*)>)?\Z", re.S)


def parse_literal(text: str | None) -> tuple[str, str | None, str | None] | None:
    """(lexical, lang, datatype): up to the first unescaped quote with a valid suffix."""
    if not text or text[0] != '"':
        return None
    i, escaped = 1, False
    while i < len(text):
        if escaped:
            escaped = False
        elif text[i] == "\\":
            escaped = True
        elif text[i] == '"' and (m := _SUFFIX.match(text, i + 1)):
            lexical = unescape(text[1:i])
            return None if lexical is None else (lexical, m["lang"] or None, m["datatype"] or None)
        i += 1
    return None


def percent_decode(text: str) -> str | None:
    """None for a bad escape or bytes that are not UTF-8."""
    out, i, raw = bytearray(), 0, text.encode()
    while i < len(raw):
        if raw[i] == 0x25:
            pair = raw[i + 1 : i + 3]
            if not re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                return None
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    try:
        return out.decode()
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=1 << 14)
def local_name(iri: str) -> str:
    """The local name of an IRI with the prefix; any other IRI, or a bad escape, as it is."""
    if not iri.startswith(LOCAL):
        return iri
    name = percent_decode(iri[len(LOCAL):])
    return iri if name is None else name


@pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("lexical", "lang", "datatype")]))
def literal_parts(c: pd.Series) -> pd.DataFrame:
    rows = [parse_literal(x) or (None, None, None) for x in c]
    return pd.DataFrame(rows, columns=["lexical", "lang", "datatype"])


@pandas_udf(T.StringType())
def decode_local_iri(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else local_name(x))


def normalize_literal(c: Column) -> Column:
    """Parsed and rendered again; null if it is no literal."""
    p = literal_parts(c)
    return F.when(p["lexical"].isNotNull(), render_literal(p["lexical"], p["lang"], p["datatype"]))


def render_iri_or_blank(c: Column) -> Column:
    return F.when(c.startswith("_:") | (c.startswith("<") & c.endswith(">")), c).otherwise(F.concat(F.lit("<"), iri_body(c), F.lit(">")))


def render_object(c: Column) -> Column:
    """Blank nodes and bracketed IRIs as they are, literals in normal form, else an IRI; a malformed
    literal is a local name."""
    return F.when(c.startswith('"'), F.coalesce(normalize_literal(c), render_iri_or_blank(c))).otherwise(render_iri_or_blank(c))


def show_triple(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), s, F.lit(", "), p, F.lit(", "), o, F.lit(")"))


def show_entity(id_: Column, label: Column) -> Column:
    return F.when(label.isNotNull(), F.concat(label, F.lit(" ("), id_, F.lit(")"))).otherwise(id_)


def cypher_string(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher_identifier(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
