"""Quality filter by weak supervision.

Each document gets plain counts (words, symbols, repeated lines, repeated word windows,
...). Rules turn them into votes +1 (good), -1 (bad) or 0 (abstain). Expectation
maximisation over a latent good/bad label estimates the share of good documents and
two accuracies of each rule, one on good and one on bad documents; the posterior probability of "good" given the votes decides,
in place of a demand that all rules pass. Documents enter the estimate only through
counts of equal vote vectors, of which there are at most 3 ** (number of rules), so the
fit is one aggregated row whatever the size of the input. All of it is DataFrame
expressions.

Edge cases: a null or empty text has no words, fails the base rule and is not kept;
very long texts are handled whole, inside their own row, by sorting their word windows;
repeated rows and ties are separate rows with equal results; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, let, read, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ITERATIONS = 30
#: Bounds of a rule's accuracy on good documents (its votes for good among its votes there), on
#: bad documents (its votes for bad), and of the share of good documents during the fit.
ON_GOOD, ON_BAD = (0.6, 0.999), (0.2, 0.95)
PRIOR = (0.05, 0.98)
START_GOOD, START_BAD, START_PRIOR = 0.95, 0.5, 0.8
#: Weight, in documents, of the starting accuracies during the fit.
PSEUDO = 4

#: name -> (SQL condition of a vote for good, SQL condition of a vote for bad); the SQL is
#: common to Spark and other engines, over the columns of `statistics`.
RULES = {
    "length": ("n_words >= 50 AND n_words <= 100000", "n_words < 20 OR n_words > 500000"),
    "word_length": ("word_chars >= 3 * n_words AND word_chars <= 12 * n_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "symbol_chars": ("100 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    "symbol_runs": ("50 * n_symbol_runs <= n_words", "5 * n_symbol_runs > n_words"),
    "dup_lines": ("10 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    "capitals": ("10 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "exclamation": ("50 * n_exclaim <= n_words", "5 * n_exclaim > n_words"),
}


def repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that are found twice or more."""

    def covered(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def exact(h: Column) -> Column:
            windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))
            same = lambda x, y: (x["h"] == y["h"]) & (x["t"] == y["t"])
            twice = lambda s: F.filter(s, lambda x, k: F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)) | F.coalesce((k > 0) & same(x, F.get(s, k - 1)), F.lit(False)))
            starts = F.sort_array(F.transform(let(windows, twice), lambda x: x["i"]))
            width = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
            return let(starts, width)

        # equal windows have equal hashes: without a repeated hash there is nothing to sort
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0)))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(covered(w))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that base rule and votes use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("w"), lines.alias("lines"))
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaim"),
    )


def with_votes(stats: DataFrame) -> DataFrame:
    votes = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for good, bad in RULES.values()]
    return stats.withColumn("votes", F.array(*votes))


def posterior(votes: Column, prior: Column, on_good: Column, on_bad: Column) -> Column:
    """Probability of "good" given the votes; an abstention says nothing."""
    logit = F.log(prior / (1 - prior))
    for j in range(len(RULES)):
        vote, a, b = F.get(votes, F.lit(j)), F.get(on_good, F.lit(j)), F.get(on_bad, F.lit(j))
        logit = logit + F.when(vote == 1, F.log(a / (1 - b))).when(vote == -1, F.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def fit(voted: DataFrame) -> DataFrame:
    """One row: `prior`, and `on_good` and `on_bad` (arrays in the order of RULES)."""
    m = len(RULES)
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    # sorted, so that the sums below have one order
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    clamp = lambda x, to: F.greatest(F.least(x, F.lit(to[1])), F.lit(to[0]))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def step(s: Column, _: Column) -> Column:
        weighed = F.transform(F.col("patterns"), lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), posterior(x["votes"], s["prior"], s["on_good"], s["on_bad"]).alias("p")))

        def refit(xs: Column) -> Column:
            def accuracy(j: int, vote: int, share, start: float, bounds) -> Column:
                cast = lambda x: F.get(x["v"], F.lit(j))
                right = total(xs, lambda x: F.when(cast(x) == vote, x["n"] * share(x)).otherwise(0.0))
                both = total(xs, lambda x: F.when(cast(x) != 0, x["n"] * share(x)).otherwise(0.0))
                return clamp((right + PSEUDO * start) / (both + PSEUDO), bounds)

            prior = clamp((total(xs, lambda x: x["n"] * x["p"]) + 1) / (total(xs, lambda x: x["n"]) + 2), PRIOR)
            good = F.array(*[accuracy(j, 1, lambda x: x["p"], START_GOOD, ON_GOOD) for j in range(m)])
            bad = F.array(*[accuracy(j, -1, lambda x: 1 - x["p"], START_BAD, ON_BAD) for j in range(m)])
            return F.struct(prior.alias("prior"), good.alias("on_good"), bad.alias("on_bad"))

        return let(weighed, refit)

    start = F.struct(F.lit(START_PRIOR).alias("prior"), F.array(*[F.lit(START_GOOD)] * m).alias("on_good"), F.array(*[F.lit(START_BAD)] * m).alias("on_bad"))
    fitted = gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step).alias("model"))
    return fitted.select("model.*")


def judge(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, the posterior probability of quality, and kept."""
    voted = cut(with_votes(statistics(docs)))
    out = voted.crossJoin(F.broadcast(fit(voted)))  # one row of parameters
    out = out.withColumn("quality", posterior(F.col("votes"), F.col("prior"), F.col("on_good"), F.col("on_bad")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("prior", "on_good", "on_bad")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    names = list(RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{k}" for k, (good, bad) in RULES.items())
    logit = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v_{k} WHEN 1 THEN ln(g_{k} / (1 - b_{k})) WHEN -1 THEN ln((1 - g_{k}) / b_{k}) ELSE 0 END" for k in names)
    clamp = lambda x, to: f"greatest(least({x}, {to[1]}::DOUBLE), {to[0]}::DOUBLE)"
    rate = lambda k, vote, p, start, to: clamp(f"(sum(CASE WHEN v_{k} = {vote} THEN n * {p} ELSE 0 END) + {PSEUDO * start}::DOUBLE) / (sum(CASE WHEN v_{k} <> 0 THEN n * {p} ELSE 0 END) + {PSEUDO})", to)
    acc = ", ".join([*(rate(k, 1, "p", START_GOOD, ON_GOOD) for k in names), *(rate(k, -1, "(1 - p)", START_BAD, ON_BAD) for k in names)])
    start = ", ".join([*(f"{START_GOOD}::DOUBLE AS g_{k}" for k in names), *(f"{START_BAD}::DOUBLE AS b_{k}" for k in names)])
    return rf"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(coalesce(nxt - i, 3), 3))::BIGINT AS c
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), stats AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper, len(regexp_extract_all(text, '[#*$%&|<>]+'))::BIGINT AS n_symbol_runs, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclaim
  FROM worded LEFT JOIN covered USING (rid)
), voted AS (SELECT *, {votes} FROM stats),
patterns AS (SELECT {", ".join(f"v_{k}" for k in names)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
em AS (
  SELECT 0 AS it, {START_PRIOR}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT it + 1, {clamp("(sum(n * p) + 1) / (sum(n) + 2)", PRIOR)}, {acc}
  FROM (SELECT em.it, patterns.*, 1 / (1 + exp(-({logit}))) AS p FROM em, patterns WHERE it < {ITERATIONS})
  GROUP BY it
), judged AS (
  SELECT voted.*, 1 / (1 + exp(-({logit}))) AS quality,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM voted, em WHERE it = {ITERATIONS}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept FROM judged
"""
