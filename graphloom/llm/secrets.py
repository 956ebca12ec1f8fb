r"""Secret scanning with linking of multipart credentials.

Base kinds are found on their own: `assign` (a keyword, a separator and a value of 12 or
more characters), `access` (AKIA identifiers of 18 or more) and `hex` (runs of 16 or
more). Weak candidates (`id`: account or client identifiers, `key`: long mixed-case
tokens with digits, `endpoint`: hosts and URLs) are too common to report alone. They are
reported only when complementary parts lie in the same scope (a block of lines, which a
line of white space ends) and at most LINK_DISTANCE characters apart, from the end of one
to the start of the other: an `id` needs a secret part, a `key` an identifier part, an
`endpoint` both. The co-occurrence is an interval join of each scope's parts: the last end
among the parts that start before, and the first start among those that start after, from
two windows over their order, so no pairs are made.

Positions come from splitting the text by the same pattern that extracts the matches:
running lengths of the pieces between and of the matches before give the offsets. All
steps are DataFrame expressions. Texts without any complementary weak parts never reach a
shuffle; equal texts are linked once.

Spans are in code points, end exclusive. Edge cases: a null text is empty and has no
spans; very long texts are searched whole, and rewritten in stretches; repeated rows get
equal rows; an empty table gives an empty result; columns of any name are kept by `redact`
(inside one struct meanwhile), other operators ignore them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, let, read

LINK_DISTANCE = 200
#: Running totals are made in steps of so many values, texts rewritten in stretches of so many characters.
STEP, STRETCH = 256, 1 << 15


def _either(word: str) -> str:
    """A pattern for a word in either case, letters of ASCII only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = rf"""^(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
_ID_WORDS = "|".join(map(_either, ("client_?id", "account_?id", "account", "username", "user", "login", "key_?id")))
ID = rf"""(?:{_ID_WORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+"""
KEY = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9_.:@/-]+"""

#: kind -> (pattern, least length of the value, cheap necessary condition on the lower-cased text)
BASE = ("assign", "access", "hex")
WEAK = ("id", "key", "endpoint")
KINDS = BASE + WEAK
#: What ends a scope is found like a kind of its own.
BREAK = len(KINDS)
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "id": ID, "key": KEY, "endpoint": ENDPOINT, "break": r"\n[\x20\x09\x0D]*\n"}
IDENTIFIERS, SECRETS = ("access", "id"), ("assign", "hex", "key")
ASSIGN_MIN = 12
SPAN = "array<struct<start:int,kind:int,end:int>>"


def before(values: Column, join) -> Column:
    """For each value, what `join` makes of 0 and all values before it. In steps, so that no long
    list is copied for each value."""

    def fold(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def whole(parts: Column) -> Column:
        starts = fold(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), join)), F.lit(0))
        return F.flatten(F.zip_with(parts, starts, fold))

    steps = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int"), F.lit(1))
    return F.when(F.size(values) > 0, let(F.transform(steps, lambda j: F.slice(values, j * STEP + 1, F.lit(STEP))), whole)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, kind: str, keep=None) -> Column:
    """Spans of all leftmost non-overlapping matches for which keep(match) holds."""
    pattern, k = F.lit(PATTERNS[kind]), ([*KINDS, "break"]).index(kind)
    pieces = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind]), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), (F.length(p) + F.length(m)).alias("n")))

    def place(x: Column) -> Column:
        placed = F.zip_with(x, before(F.transform(x, lambda y: y["n"]), lambda a, n: a + n), lambda y, at: F.struct(y["m"].alias("m"), (at + y["gap"]).alias("start"), (at + y["n"]).alias("end")))
        kept = F.filter(placed, lambda y: keep(y["m"])) if keep else placed
        return F.transform(kept, lambda y: F.struct(y["start"].alias("start"), F.lit(k).alias("kind"), y["end"].alias("end")))

    # the split gives one piece more than there are matches
    return let(F.filter(pieces, lambda x: x["m"].isNotNull()), place)


def _none() -> Column:
    return F.array().cast(SPAN)


def _has(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.exists(spans, lambda x: x["kind"].isin([KINDS.index(k) for k in kinds]))


def scan(docs: DataFrame) -> DataFrame:
    """(row, base, weak, digest, breaks): the input row as a struct, the spans of both sorts, and, where
    weak spans could be linked, the text's digest and the ends of scopes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    some = lambda *words: F.greatest(*[low.contains(w) for w in words]) if len(words) > 1 else low.contains(words[0])
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    assign = F.when(some("passw", "secret", "token", "api_key", "apikey"), spans(text, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= ASSIGN_MIN)).otherwise(_none())
    access = F.when(text.contains("AKIA"), spans(text, "access")).otherwise(_none())
    hexes = F.when(text.rlike(HEX), spans(text, "hex")).otherwise(_none())
    ids = F.when(some("client", "account", "user", "login", "key_id", "keyid"), spans(text, "id")).otherwise(_none())
    keys = F.when(text.rlike(KEY), spans(text, "key", mixed)).otherwise(_none())
    ends = F.when(text.contains("://"), spans(text, "endpoint")).otherwise(_none())
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array_sort(F.concat(assign, access, hexes)).alias("base"), F.concat(ids, keys, ends).alias("weak"))
    likely = (F.size("weak") > 0) & _has(F.concat("base", "weak"), IDENTIFIERS) & _has(F.concat("base", "weak"), SECRETS)
    text = F.coalesce("row.text", F.lit(""))
    return out.withColumn("digest", F.when(likely, F.sha2(text, 256))).withColumn("breaks", F.when(F.col("digest").isNotNull() & text.contains("\n"), spans(text, "break")).otherwise(_none()))


def linked(scanned: DataFrame) -> DataFrame:
    """(digest, linked): weak spans with complementary parts in their scope, LINK_DISTANCE away at most."""
    parts = scanned.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.first(F.concat("base", "weak", "breaks")).alias("x"))
    parts = parts.select("digest", F.explode("x").alias("x")).select("digest", "x.start", "x.kind", "x.end")
    scope = F.sum((F.col("kind") == BREAK).cast("int")).over(Window.partitionBy("digest").orderBy("start"))
    parts = parts.withColumn("scope", scope).where(F.col("kind") != BREAK)
    of = lambda kinds, c: F.when(F.col("kind").isin([KINDS.index(k) for k in kinds]), F.col(c))
    earlier, later = (Window.partitionBy("digest", "scope").orderBy(order).rangeBetween(Window.unboundedPreceding, 0) for order in (F.asc("start"), F.desc("start")))
    for name, kinds in (("ids", IDENTIFIERS), ("secrets", SECRETS)):
        parts = parts.withColumns({f"{name}_end": F.max(of(kinds, "end")).over(earlier), f"{name}_start": F.min(of(kinds, "start")).over(later)})
    near = lambda name: F.coalesce(F.col("start") - F.col(f"{name}_end") <= LINK_DISTANCE, F.lit(False)) | F.coalesce(F.col(f"{name}_start") - F.col("end") <= LINK_DISTANCE, F.lit(False))
    k = {name: F.col("kind") == KINDS.index(name) for name in WEAK}
    parts = parts.where((k["id"] & near("secrets")) | (k["key"] & near("ids")) | (k["endpoint"] & near("ids") & near("secrets")))
    return parts.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def found(scanned: DataFrame) -> DataFrame:
    """Add `spans` (base and linked, by start) to a scanned table."""
    likely = scanned.where(F.col("digest").isNotNull()).join(linked(scanned), "digest", "left")
    likely = likely.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("linked", _none())))).drop("linked")
    rest = scanned.where(F.col("digest").isNull()).withColumn("spans", F.col("base"))
    return rest.unionByName(likely)


def rewritten(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span (overlapping spans as one) replaced by `mark`."""

    def kept(reached: Column) -> Column:
        """(lo, hi) of what stays before each mark."""
        both = F.zip_with(spans, reached, lambda x, at: F.struct(at.alias("lo"), x["start"].alias("hi")))
        return F.filter(both, lambda x: x["hi"] >= x["lo"])

    def stretch(x: Column, j: Column, k: Column, end: Column) -> Column:
        lo, hi = j * STRETCH, (j + 1) * STRETCH
        part = lambda a, b: F.substring(x, F.greatest(a, lo) - lo + 1, F.greatest(F.least(b, hi) - F.greatest(a, lo), F.lit(0)))
        here = F.filter(k, lambda y: (y["lo"] < hi) & (y["hi"] >= lo))
        pieces = F.transform(here, lambda y: F.concat(part(y["lo"], y["hi"]), F.when(y["hi"] < hi, F.lit(mark)).otherwise("")))
        return F.concat(F.array_join(pieces, ""), part(end, hi))

    ends = F.array_max(F.transform(spans, lambda x: x["end"]))
    known = F.struct(kept(before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))).alias("kept"), ends.alias("end"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("parts"))
    return let(known, lambda s: F.array_join(F.transform(s["parts"], lambda x, j: stretch(x, j, s["kept"], s["end"])), ""))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span (overlapping spans as one) of each text by `mark`; all rows and columns stay.

    The scan is written once, as the links read it again.
    """
    out = found(cut(scan(docs)))
    text = F.col("row.text")
    clean = F.when(text.isNotNull() & (F.size("spans") > 0), rewritten(text, F.col("spans"), mark)).otherwise(text)
    return out.select(*[(clean if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = found(cut(scan(docs).withColumn("row", F.struct("row.doc_id"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return out.select("row.doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def oracle() -> str:
    q = lambda s: s.replace("'", "''")

    def kind(name: str, keep: str) -> str:
        k = [*KINDS, "break"].index(name)
        return f"""
  SELECT rid, {k} AS kind, s AS start, s + length(m) AS "end" FROM (
    SELECT rid, m[i] AS m, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, regexp_extract_all(text, '{q(PATTERNS[name])}') AS m, regexp_split_to_array(text, '{q(PATTERNS[name])}') AS p FROM d WHERE regexp_matches(text, '{q(PATTERNS[name])}')))
  ) WHERE {keep}"""

    mixed = "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"
    keeps = {"assign": f"length(regexp_extract(m, '{q(ASSIGN_VALUE)}', 1)) >= {ASSIGN_MIN}", "key": mixed}
    i = KINDS.index
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    of = lambda kinds: "kind IN (" + ", ".join(str(i(x)) for x in kinds) + ")"
    over = lambda order: f"OVER (PARTITION BY rid, scope ORDER BY start {order} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    near = lambda kinds: f"""(coalesce(start - max("end") FILTER ({of(kinds)}) {over("ASC")} <= {LINK_DISTANCE}, false) OR coalesce(min(start) FILTER ({of(kinds)}) {over("DESC")} - "end" <= {LINK_DISTANCE}, false))"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(kind(k, keeps.get(k, "true")) for k in [*KINDS, "break"])}),
scoped AS (SELECT *, sum((kind = {BREAK})::INT) OVER (PARTITION BY rid ORDER BY start) AS scope FROM found),
counted AS (SELECT *, {near(IDENTIFIERS)} AS ids, {near(SECRETS)} AS secrets FROM scoped WHERE kind <> {BREAK}),
kept AS (
  SELECT rid, kind, start, {names}[kind + 1] || ':' || start || ':' || "end" AS shown FROM counted
  WHERE kind < {len(BASE)} OR kind = {i("id")} AND secrets OR kind = {i("key")} AND ids OR kind = {i("endpoint")} AND ids AND secrets
), per AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {i(k)}) AS n_{k}" for k in BASE)},
    string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""
