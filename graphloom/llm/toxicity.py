"""Toxicity scores from a lexicon with misspellings and context.

A trie holds the lexicon: a short fixed list, and words and word stems that tell toxic
from other labelled texts. A word of a text is looked up by running a Levenshtein
automaton over the trie: the states of the intersection (trie node, edits so far) are
turned into a deterministic automaton on demand, so a word costs one step per letter
and most words die after a few. Whole terms match within one edit (terms of five
letters or more), stems match exactly and take any ending.

A hit is weighed by its context window: reported speech (quotation marks on both sides,
verbs of saying) lowers it, second-person address raises it. A logistic regression turns
a text's totals into a score.

Training uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most about
MAX_LABELLED of them, chosen by a hash of doc_id. Terms are counted by Spark; the lexicon
(at most MAX_TERMS terms) and the regression's inputs (a few numbers for each training
row) are all that reaches the driver. Terms come from two thirds of the training rows
and the regression is fitted on the other third, so that a term's success on the rows
that suggested it is not mistaken for evidence.

Edge cases: a null or empty text scores like one without hits; very long texts are read
whole; repeated rows get equal scores; without labels of both kinds the fixed list alone
decides; an empty table gives an empty result; other columns are ignored (kept by
`filter_toxic`).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, read

MAX_LABELLED = 20_000
MAX_TERMS = 600
MIN_SUPPORT = 4
MIN_LOG_ODDS = 0.7
STEM_LENGTHS = (4, 5, 6, 7)
FUZZY_LENGTH = 5
FUZZY_DISCOUNT = 0.9
#: Characters on each side of a hit that make its context.
WINDOW = 40
# Common English terms of abuse, taken as part of the lexicon whatever the labels say.
TERMS = "idiot moron stupid loser pathetic worthless disgusting scum trash clown imbecile jerk bastard vermin filth creep".split()
FIXED_WEIGHT = 4.0
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‘’"
_SAYING = re.compile(r"\b(?:said|says|quote[sd]?|wrote|called|reported|dit|écrit|sagte|schrieb|dijo|escribió)\b")
_YOU = re.compile(r"\b(?:you|your|you're|u|du|dich|dein|tu|te|vous|votre|usted|eres)\b")
CACHE_WORDS = 400_000


class Automaton:
    """Trie of terms and stems, intersected with a Levenshtein automaton of one edit."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], sure: set[str]):
        """sure: the terms that may match within one edit."""
        self.child: list[dict[str, int]] = [{}]
        self.term, self.stem = [0.0], [0.0]
        self.fuzzy_term: list[bool] = [False]
        self.fuzzy: list[bool] = [False]  # a term that may be misspelt lies at or below
        for words, value in ((terms, self.term), (stems, self.stem)):
            for w in sorted(words):
                node, may = 0, words is terms and w in sure and len(w) >= FUZZY_LENGTH
                self.fuzzy[0] |= may
                for c in w:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.term.append(0.0)
                        self.stem.append(0.0)
                        self.fuzzy.append(False)
                        self.fuzzy_term.append(False)
                    node = self.child[node][c]
                    self.fuzzy[node] |= may
                value[node] = words[w]
                if may:
                    self.fuzzy_term[node] = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The state of a set of (node, edits), with letters of the term left out of the word."""
        full = set(items)
        for node, e in items:
            if e == 0 and self.fuzzy[node]:
                full |= {(c, 1) for c in self.child[node].values() if self.fuzzy[c]}
        full = frozenset((n, e) for n, e in full if not (e == 1 and (n, 0) in full and not self.term[n]))
        if full not in self.states:
            self.states[full] = len(self.sets)
            self.sets.append(full)
            self.next.append({})
        return self.states[full]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            to = self.child[node].get(c)
            if to is not None and (e == 0 or self.fuzzy[to]):
                out.add((to, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out |= {(x, 1) for x in self.child[node].values() if self.fuzzy[x]}  # another letter
        return self._state(out) if out else -1

    def look_up(self, word: str) -> tuple[float, bool]:
        """(weight, misspelt) of a word; weight 0 if the lexicon has nothing like it."""
        state, stem = self.start, 0.0
        for c in word:
            to = self.next[state].get(c)
            if to is None:
                if len(self.sets) > 200_000:  # bounds the memory; states are rebuilt when needed
                    self.states, self.sets, self.next = {}, [], []
                    self.start = self._state({(0, 0)})
                    return self.look_up(word)
                to = self.next[state][c] = self._step(state, c)
            if to < 0:
                return stem, False
            state = to
            for n, e in self.sets[state]:
                if e == 0 and self.stem[n]:
                    stem = self.stem[n]
        exact = max((self.term[n] for n, e in self.sets[state] if e == 0), default=0.0)
        if exact or stem:
            return max(exact, stem), False
        near = max((self.term[n] for n, e in self.sets[state] if e == 1 and self.fuzzy_term[n]), default=0.0)
        return near * FUZZY_DISCOUNT, True


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    sure: set[str] = field(default_factory=set)
    plain: set[str] = field(default_factory=set)  # words of clean texts within an edit of a term


FEATURES = ("largest", "total", "distinct", "per_root", "per_word", "misspelt", "quoted", "addressed", "words")


class Scorer:
    """Features of texts; one for each task."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = Automaton(lexicon.terms, lexicon.stems, lexicon.sure)
        self.plain = lexicon.plain
        self.cache: dict[str, tuple[float, bool] | None] = {}

    def look_up(self, word: str) -> tuple[float, bool] | None:
        if word in self.cache:
            return self.cache[word]
        weight, misspelt = self.automaton.look_up(word)
        out = (weight, misspelt) if weight and not (misspelt and word in self.plain) else None
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = out
        return out

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        words = _WORD.findall(low)
        n = len(words)
        if not any(map(self.look_up, set(words))):
            return [0.0] * 8 + [float(np.log1p(n))]
        weights, seen, misspelt, quoted, addressed = [], set(), 0, 0.0, 0.0
        for m in _WORD.finditer(low):
            got = self.look_up(m.group())
            if got is None:
                continue
            before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
            reported = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES) or bool(_SAYING.search(before))
            weight = got[0] * (0.4 if reported else 1.0)
            quoted += reported
            addressed += bool(_YOU.search(before[-20:]) or _YOU.search(after[:20]))
            weights.append(weight)
            seen.add(m.group())
            misspelt += got[1]
        total = sum(weights)
        k = len(weights)
        return [max(weights), float(np.log1p(total)), float(np.log1p(len(seen))), total / np.sqrt(n + 1), 20 * total / (n + 20), misspelt / k, quoted / k, addressed / k, float(np.log1p(n))]


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last is the constant

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _tokens(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms and stems from labelled rows (text, toxic)."""
    lexicon = Lexicon({t: FIXED_WEIGHT for t in TERMS}, {}, set(TERMS), set())
    words = rows.select("toxic", F.explode(_tokens(F.lower("text"))).alias("w"))
    words = words.groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).persist()
    totals = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    n_bad, n_good = float(totals["bad"] or 0), float(totals["good"] or 0)
    if n_bad and n_good:
        odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
        gain = F.col("bad") * odds
        strong = lambda df: df.where(F.col("bad") >= MIN_SUPPORT).withColumns({"odds": odds, "gain": gain}).where(F.col("odds") >= MIN_LOG_ODDS)
        for r in strong(words.where(F.length("w") >= 3)).orderBy(F.desc("gain"), "w").limit(MAX_TERMS // 2).collect():
            lexicon.terms[r["w"]] = min(r["odds"], 6.0)
            if r["odds"] > 3.0:
                lexicon.sure.add(r["w"])
        stems = words.where(F.length("w") > min(STEM_LENGTHS)).select("bad", "good", F.explode(F.array(*[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEM_LENGTHS])).alias("w")).where("w IS NOT NULL")
        stems = stems.groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        for r in strong(stems).orderBy(F.desc("gain"), "w").limit(MAX_TERMS // 2).collect():
            lexicon.stems[r["w"]] = min(r["odds"], 6.0)
    bare = Lexicon(lexicon.terms, lexicon.stems, lexicon.sure, set())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(bare)
        for batch in batches:
            got = [w for w in batch.column("w").to_pylist() if (scorer.look_up(w) or (0, False))[1]]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], ["w"])

    # words within an edit of a few hundred terms: bounded by terms x letters x alphabet
    lexicon.plain = {r["w"] for r in in_arrow(words.where("good > 0").select("w"), near, "w string").collect()}
    words.unpersist()
    return lexicon


def fit(x: np.ndarray, y: np.ndarray, lexicon: Lexicon) -> Model:
    """Logistic regression by Newton steps with a small ridge."""
    if not len(y) or y.min() == y.max():
        start = np.zeros(len(FEATURES) + 1)
        start[0], start[-1] = 4.0, -2.0
        return Model(lexicon, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), start)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.25)  # a feature that hardly varies must not decide
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(y))])
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1e-2 * len(y) ** 0.5)
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, mean, scale, w)


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    own = labels.where((remainder(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    chosen = own.where(part < int(1_000_000 * min(1.0, MAX_LABELLED / max(n, 1))))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(3))).persist()
    lexicon = learn_lexicon(rows.where("fold < 2"))
    got = in_arrow(rows.where("fold = 2").select("toxic", "text"), _features(lexicon), "toxic int, x array<double>").toPandas()
    rows.unpersist()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, got["toxic"].to_numpy(float), lexicon)


def _score(model: Model, columns: list[str], threshold: float | None):
    """Adds `score` to the columns, or with a threshold drops the rows that reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            score = model.score(x)
            if threshold is not None:
                yield batch.filter(pa.array(score < threshold))
            else:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score)], [*columns, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    out = in_arrow(docs.select("doc_id", "text"), _score(model, ["doc_id"], None), "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below 0.5, all columns."""
    return in_arrow(docs, _score(model, docs.columns, 0.5), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def crc_remainder(doc_id: int) -> int:
    """`remainder` for a Python value."""
    return zlib.crc32(str(doc_id).encode()) % 5
