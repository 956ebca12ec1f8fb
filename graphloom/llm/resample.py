"""op13: importance resampling towards a target distribution, with partition-local word tries.

A task walks its texts over a trie whose edges are words. A node stands for a feature, a run of
words; it holds how often the run was seen and the CRC state of its bytes, so a child's state comes
from its parent's by the bytes that are new. Node counts are added up by bucket within the task,
and Spark sums the buckets. The gains of the buckets, a table of fixed size, then go to the tasks,
which walk the texts again over tries whose nodes carry their gain.

Defined results: a null or empty text, or one without words, has no features and weight 0. A row
without a doc_id has no score and is neither counted nor drawn. Rows of equal doc_id share the
random part; equal rows take neighbouring ranks. Empty tables give no rows; an empty target gives
gains from its zero counts. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import observed
from ..plans.number import numbered
from .common import in_arrow, read

RUNS, BUCKETS, PERCENT, SEED, MIN_WORDS = 1, 10_000, 10, 2024, 20

#: A task adds its counts to the buckets and starts a new trie beyond so many nodes.
MAX_NODES = 200_000

#: Letters a-z and digits stay, A-Z are lowered, other ASCII bytes part words, the rest stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text, A-Z lowered."""
    return text.translate(_FOLD).split()


class Trie:
    """The number of nodes, what a node's `value` starts with, and the root."""

    def __init__(self, value):
        self.size, self.value, self.root = 0, value, Node()
        self.root.trie = self


class Node(dict):
    """A feature by the path of words that leads here; a missing child is made when asked for."""

    __slots__ = ("crc", "trie", "value")

    def __missing__(self, word: bytes) -> Node:
        child, trie = Node(), self.trie
        child.crc = crc32(word) if self is trie.root else crc32(b" " + word, self.crc)
        child.trie, child.value = trie, trie.value(child.crc)
        trie.size += 1
        self[word] = child
        return child

    def descendants(self) -> Iterator[Node]:
        open_ = list(self.values())
        while open_:
            node = open_.pop()
            yield node
            open_ += node.values()


def runs_of(root: Node, words: list[bytes], runs: int) -> Iterator[list[Node]]:
    """The nodes of all runs of 1, 2, ... `runs` words, one list for each length."""
    nodes = list(map(root.__getitem__, words))
    yield nodes
    for k in range(1, runs):
        nodes = [node[w] for node, w in zip(nodes, words[k:], strict=False)]
        yield nodes


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def bucket_totals(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, max_nodes: int = MAX_NODES) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, trie = np.zeros(buckets, np.int64), Trie(lambda crc: 0)

        def merge() -> None:
            at = [(n.crc % buckets, n.value) for n in trie.root.descendants()]
            np.add.at(totals, [b for b, _ in at], [v for _, v in at])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for nodes in runs_of(trie.root, words_of(text), runs):
                    for node in nodes:
                        node.value += 1
                if trie.size > max_nodes:
                    merge()
                    trie = Trie(lambda crc: 0)
        if trie.size:
            merge()
        hit = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(totals[hit])], ["bucket", "n"])

    return in_arrow(_texts(texts), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 * ln of how much likelier a bucket is in the target), each count smoothed by one."""
    s, t = float(sum(own.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((own.get(b, 0) + 1.0) * t))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], runs: int = RUNS, max_nodes: int = MAX_NODES) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's features."""
    buckets = len(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = lambda crc: gain[crc % buckets]
        trie = Trie(value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                n = total = 0
                for nodes in runs_of(trie.root, words, runs):
                    n += len(nodes)
                    total += sum([node.value for node in nodes])
                rows.append((len(words), n, total // n if n else 0))
                if trie.size > max_nodes:
                    trie = Trie(value)
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return in_arrow(_texts(docs, "doc_id"), score, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`.

    `percent` of the documents with `min_words` words or more are drawn, those of highest weight plus
    Gumbel noise, which is drawing without replacement in proportion to the weights' exponentials.
    `rank` counts the drawn ones from 1; ties go to the smaller doc_id; it is null for the others.
    """
    # two tables of fixed size, `buckets` rows at most
    own, wanted = ({r["bucket"]: r["n"] for r in bucket_totals(x, runs, buckets).collect()} for x in (docs, target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gains(own, wanted, buckets), runs).withColumn("score", F.col("weight") + noise)
    out = (F.col("score").isNull() | (F.col("n_words") < min_words)).cast("int")
    scored, m = observed(scored.select("doc_id", "n_features", "weight", "score", out.alias("_out"), (-F.col("score")).alias("_last")), n=F.count_if(F.col("_out") == 0))
    drawn = m["n"] * percent // 100
    placed = numbered(scored, ["_out", "_last", "doc_id"], "_n")
    rank = F.when((F.col("_out") == 0) & (F.col("_n") < drawn), F.col("_n") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same rows from DuckDB; a word's crc32 is folded over its bytes, once for each distinct word."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({low}, '{words}') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({low}, '{words}')) AS w FROM benchmark),
crcs AS (
  SELECT w, xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % {BUCKETS} AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab
),
own AS (SELECT bucket, count(*) AS s FROM dw JOIN crcs USING (w) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM bw JOIN crcs USING (w) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) + {BUCKETS}.0::DOUBLE AS s, (SELECT count(*) FROM bw) + {BUCKETS}.0::DOUBLE AS t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(wanted.t, 0) + 1)::DOUBLE * total.s / ((own.s + 1)::DOUBLE * total.t)))::BIGINT AS g
  FROM own LEFT JOIN wanted USING (bucket), total
),
weighted AS (SELECT r, count(*)::BIGINT AS n, sum(g)::BIGINT AS g FROM dw JOIN crcs USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(CASE WHEN g % n < 0 THEN g // n - 1 ELSE g // n END, 0) AS weight,
    (('0x' || substr(sha256('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM d LEFT JOIN weighted USING (r)
), drawn AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM drawn
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= {MIN_WORDS} AND k <= {PERCENT} * n // 100 THEN k END::BIGINT AS rank
FROM ranked
"""
