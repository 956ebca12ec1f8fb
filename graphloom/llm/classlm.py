"""op11: a Brown class-based bigram model, its classes found by exchange, as a score of texts.

The probability of a word after another is that of its class after the other's class, times that
of the word within its class. Exchange moves words to the class that raises the likelihood of the
training text most, from the counts of each word's left and right neighbours by class.

Texts are blocks of word numbers (`blocks.py`). A round of the exchange is one pass over them, which
counts class pairs and, for each word, the classes beside it; words' counts are packed by range of
words, summed where a range's words meet, and every word of the range picks its class against the
summed class pairs (a table of CLASSES^2 numbers). Half of the words may move in a round, another
half in the next, as neighbours that move at once spoil each other's counts. The best round's
classes are kept.

Classes: 0 is the end of a text, 1 words seen once, together with all unknown words, 2 words seen
less than MIN_COUNT times, whose neighbours say little; the others are found. Transitions are
smoothed by the classes' own frequencies; in class 1, the share of unknown words is Good and
Turing's estimate from the numbers of words seen once and twice.

Defined results: a null or empty text has the end as its only token. A row without a doc_id is
never learned from and counts as held out. Repeated rows count as often as they are there. Without
training rows the base score is 0 for the end alone, and the model is uniform over its classes.
An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import cut, drop, in_arrow, read

CLASSES, MIN_COUNT, ROUNDS = 48, 20, 5
END, ONCE, FEW, REST = 0, 1, 2, 3

#: Words of a range, whose counts by class are one array in a task.
RANGE = 1 << 12
#: Words of a block whose counts by class are one array.
AT_ONCE = 1 << 15
#: One byte a movable word goes to the workers up to so many words; beyond, classes are joined to blocks.
SPREAD_WORDS = 1 << 26
#: Weight of the classes' own frequencies in a transition.
PRIOR = 20.0


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 7


def tokens(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, A-Z lowered, then the end, which is the empty word."""
    return [*text.translate(blocks.LOWER).split(), b""]


@dataclass
class Corpus:
    """seq: a row a block with doc_ids, learn, lens, ids and, by place in the dictionary, n (training
    count) and gid (number of a movable word plus one, 0 for others), packed."""

    seq: DataFrame
    words: DataFrame  # (gid, word, n) of movable words
    n_tokens: int
    n_types: int
    once: int
    twice: int
    movable: int


_SEQ = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("ids", pa.binary()), ("n", pa.binary()), ("gid", pa.binary())])


def gather(docs: DataFrame, min_count: int = MIN_COUNT) -> Corpus:
    learn = F.coalesce(remainder(F.col("doc_id")) != 2, F.lit(False))
    coded = cut(blocks.encode(docs, F.col("text"), tokens, doc_id=F.col("doc_id"), learn=learn))
    agreed = blocks.agree(coded, max(min_count, 1), b"")

    def keep(row: dict, n: np.ndarray, gid: np.ndarray) -> tuple:
        return (*(row[c] for c in ("block", "doc_ids", "learn", "lens", "ids")), blocks.pack(n, 8), blocks.pack(gid + 1))

    seq = cut(agreed.placed(coded, keep, _SEQ, "block long, doc_ids array<long>, learn array<boolean>, lens array<int>, ids binary, n binary, gid binary"))
    words = cut(agreed.words().select("gid", "word", "n"))
    t = agreed.totals().first()
    drop(coded)
    drop(agreed.table)
    return Corpus(seq, words, *(t[1:5] if t else (0, 0, 0, 0)), agreed.numbered)


@dataclass
class Block:
    """One block with its training counts, numbers of movable words (-1: none) and classes, by place."""

    ids: np.ndarray
    lens: np.ndarray
    learn: np.ndarray
    n: np.ndarray
    gid: np.ndarray
    cls: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], classes) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        col = {name: batch.column(name) for name in batch.schema.names}
        for i in range(batch.num_rows):
            ids, n = blocks.unpack(col["ids"][i].as_buffer()), blocks.unpack(col["n"][i].as_buffer(), 8)
            gid = blocks.unpack(col["gid"][i].as_buffer()).astype(np.int64) - 1
            cls = np.where(n <= 1, ONCE, FEW).astype(np.uint8)
            lens = col["lens"][i].values.to_numpy()
            if len(lens):
                cls[ids[lens[0] - 1]] = END
            if classes is not None:
                cls[gid >= 0] = classes.value[gid[gid >= 0]]
            elif col["local"][i].is_valid:
                cls[col["local"][i].values.to_numpy()] = col["class"][i].values.to_numpy()
            yield batch, i, Block(ids, lens, np.array(col["learn"][i].values.to_pylist(), bool), n, gid, cls)


def _with_classes(corpus: Corpus, classes: DataFrame, *columns: str):
    """(the blocks with what a pass needs, the classes on the workers or None)."""
    columns = ("ids", "lens", "learn", "n", "gid", *columns)
    if corpus.movable <= SPREAD_WORDS:
        rows = classes.toPandas()
        table = np.zeros(corpus.movable, np.uint8)
        table[rows["gid"].to_numpy(np.int64)] = rows["class"].to_numpy(np.uint8)
        return corpus.seq.select(*columns), corpus.seq.sparkSession.sparkContext.broadcast(table)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, gid in zip(batch.column("block").to_pylist(), batch.column("gid"), strict=True):
                gid = blocks.unpack(gid.as_buffer())
                at = np.flatnonzero(gid)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block, np.int64)), pa.array(at, pa.int32()), pa.array(gid[at] - 1, pa.int64())], ["block", "local", "gid"])

    told = in_arrow(corpus.seq.select("block", "gid"), ask, "block long, local int, gid long").join(classes, "gid")
    per = told.groupBy("block").agg(F.collect_list(F.struct("local", "class")).alias("x")).select("block", F.col("x.local").alias("local"), F.col("x.class").alias("class"))
    return corpus.seq.join(per, "block", "left").select(*columns, "local", "class"), None


PACKED = "part long, gids binary, cls binary, sizes binary, cells binary, n binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(columns)], ["part", "gids", "cls", "sizes", "cells", "n"])


def _beside(b: Block, k: int) -> tuple[list[tuple], np.ndarray]:
    """(packed rows of the movable words' neighbour counts, the class pairs) of the training texts."""
    ids = b.ids[np.repeat(b.learn, b.lens)]
    now = b.cls[ids].astype(np.int64)
    before = np.concatenate([[END], now[:-1]]) if len(now) else now
    pairs = np.bincount(before * k + now, minlength=k * k)
    local = np.flatnonzero((b.gid >= 0) & (b.n > 0))
    order = local[np.argsort(b.gid[local])]
    place = np.full(len(b.gid), -1, np.int64)
    place[order] = np.arange(len(order))
    at = place[ids]
    gids, cls = b.gid[order], b.cls[order]
    hit = at >= 0
    mid = np.flatnonzero(hit)  # the last token of all is an end
    word, left, right = at[mid], before[mid], now[mid + 1]
    rows = []
    for low in range(0, len(order), AT_ONCE):
        part = (word >= low) & (word < low + AT_ONCE)
        base = (word[part] - low) * (2 * k)
        high = min(low + AT_ONCE, len(order))
        counts = np.bincount(np.concatenate([base + left[part], base + k + right[part]]), minlength=(high - low) * 2 * k)
        key = np.flatnonzero(counts)
        of = key // (2 * k) + low
        ends = np.searchsorted(gids[of] // RANGE, np.arange(gids[low] // RANGE, gids[high - 1] // RANGE + 2)) if len(of) else []
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            if a == z:
                continue
            own, sizes = np.unique(of[a:z], return_counts=True)
            rows.append((int(gids[own[0]] // RANGE), blocks.pack(gids[own] % RANGE), cls[own].tobytes(), blocks.pack(sizes), (key[a:z] % (2 * k)).astype(np.uint8).tobytes(), blocks.pack(counts[key[a:z]])))
    return rows, pairs


def _count(corpus: Corpus, classes: DataFrame, k: int, words: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """((part, cls, n) by range of words, the written table they are in, class pairs as a k x k array)."""
    seq, table = _with_classes(corpus, classes)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for _, _, b in _blocks(batches, table):
            rows, pairs = _beside(b, k)
            total += pairs
            if words:
                yield _packed(rows)
        yield _packed([(-1, b"", b"", b"", b"", total.tobytes())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        cls: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, g, c, s, x, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if part < 0:
                    into = sums.setdefault(part, np.zeros(k * k, np.int64))
                    into += np.frombuffer(n, np.int64)
                    continue
                into = sums.setdefault(part, np.zeros(RANGE * 2 * k, np.int64))
                gids = blocks.unpack(g)
                cls.setdefault(part, np.zeros(RANGE, np.uint8))[gids] = np.frombuffer(c, np.uint8)
                into[np.repeat(gids, blocks.unpack(s)) * (2 * k) + np.frombuffer(x, np.uint8)] += blocks.unpack(n)  # distinct in a row
        for part, n in sums.items():
            yield _packed([(part, b"", cls[part].tobytes() if part >= 0 else b"", b"", b"", n.tobytes())])

    rows = in_arrow(seq, mapped, PACKED).withColumn("_salt", F.when(F.col("part") < 0, F.spark_partition_id() % 64).otherwise(0))
    rows = cut(in_arrow(rows.repartition("part", "_salt").drop("_salt"), summed, PACKED).select("part", "cls", "n"))
    pairs = np.zeros(k * k, np.int64)
    for r in rows.where("part < 0").toLocalIterator():  # 64 at most
        pairs += np.frombuffer(r["n"], np.int64)
    return rows.where("part >= 0"), rows, pairs.reshape(k, k)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(pairs: np.ndarray) -> float:
    """What of the training text's log likelihood rests on the classes."""
    return float(_phi(pairs.astype(float)).sum() - _phi(pairs.sum(0).astype(float)).sum() - _phi(pairs.sum(1).astype(float)).sum())


def best_classes(left: np.ndarray, right: np.ndarray, cls: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class from REST on that raises the likelihood most for each word by itself; ties to its own
    class, then to the least. left and right are (words, classes)."""
    p = pairs.astype(float)
    into, out = p.sum(0), p.sum(1)
    kept = np.arange(REST, len(p))
    result = cls.copy()
    phi, phi_in, phi_out = _phi(p), _phi(into), _phi(out)
    for low in range(0, len(cls), 128):
        l, r, own = left[low : low + 128].astype(float), right[low : low + 128].astype(float), cls[low : low + 128].astype(int)
        n_l, n_r = l.sum(1), r.sum(1)
        gain = (_phi(p.T[None, kept] + l[:, None, :]) - phi.T[None, kept]).sum(2) + (_phi(p[None, kept] + r[:, None, :]) - phi[None, kept]).sum(2)
        gain -= _phi(into[kept] + n_l[:, None]) - phi_in[kept] + _phi(out[kept] + n_r[:, None]) - phi_out[kept]
        # in its own class, the word is taken out first
        stay = (phi.T[own] - _phi(p.T[own] - l)).sum(1) + (phi[own] - _phi(p[own] - r)).sum(1)
        stay -= phi_in[own] - _phi(into[own] - n_l) + phi_out[own] - _phi(out[own] - n_r)
        gain[np.arange(len(own)), own - REST] = stay
        best = gain.argmax(1)
        move = gain[np.arange(len(own)), best] > stay + 1e-9
        result[low : low + 128] = np.where(move & (n_l > 0), best + REST, own)
    return result


def exchange(corpus: Corpus, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """((gid, class), class pairs, likelihoods by round) of the best round."""
    heads = corpus.words.orderBy(F.desc("n"), "word").limit(k - REST - 1).select("gid").collect()
    first = F.create_map(*[F.lit(x) for i, r in enumerate(heads) for x in (r["gid"], REST + 1 + i)]) if heads else None
    at = F.lit(REST) if first is None else F.coalesce(F.element_at(first, F.col("gid")), F.lit(REST))
    classes = cut(corpus.words.select("gid", at.cast("int").alias("class")))
    best, seen = None, []
    for i in range(rounds + 1):
        counts, table, pairs = _count(corpus, classes, k, i < rounds)
        seen.append(likelihood(pairs))
        if best is None or seen[-1] > best[2]:
            best = (classes, pairs, seen[-1])
        if i == rounds or not corpus.movable:
            break

        def decide(batches: Iterator[pa.RecordBatch], pairs=pairs, i=i) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, own, n in zip(batch.column("part").to_pylist(), batch.column("cls").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    own = np.frombuffer(own, np.uint8)
                    there = np.flatnonzero(own)  # a range may end early
                    n = np.frombuffer(n, np.int64).reshape(RANGE, 2 * k)[there]
                    new, gid = best_classes(n[:, :k], n[:, k:], own[there], pairs), part * RANGE + there
                    if i:
                        new = np.where((gid + i) % 2 == 0, new, own[there])
                    yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(new, pa.int32())], ["gid", "class"])

        classes = cut(in_arrow(counts, decide, "gid long, class int"))
        drop(table)
    return best[0], best[1], seen


@dataclass
class Model:
    """log10 tables: transition (from, to); word shares are n / class size, `unknown` of class ONCE is
    left to unknown words."""

    transition: np.ndarray
    sizes: np.ndarray
    unknown: float

    @staticmethod
    def of(pairs: np.ndarray, once: int, twice: int) -> Model:
        p = pairs.astype(float)
        prior = (p.sum(0) + 1) / (p.sum() + len(p))
        transition = (p + PRIOR * prior) / (p.sum(1, keepdims=True) + PRIOR)
        return Model(np.log10(transition), p.sum(0), once / (once + 2 * twice) if once and once + 2 * twice > once * 1e-9 and twice else (0.5 if once else 1.0))

    def emission(self, n: np.ndarray, cls: np.ndarray) -> np.ndarray:
        share = n / np.maximum(self.sizes[cls], 1.0)
        share = np.where(cls == ONCE, share * (1 - self.unknown), share)
        return np.log10(np.where(n > 0, share, np.where(cls == END, 1.0, self.unknown)))


def score(docs: DataFrame, classes: int = CLASSES, min_count: int = MIN_COUNT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row;
    a text's perplexity is 10 ** (-score / n_tokens)."""
    corpus = gather(docs, min_count)
    found, pairs, _ = exchange(corpus, classes, rounds)
    model, total = Model.of(pairs, corpus.once, corpus.twice), corpus.n_tokens
    slots = total + corpus.n_types + 1
    seq, table = _with_classes(corpus, found, "doc_ids")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, b in _blocks(batches, table):
            starts = np.cumsum(b.lens) - b.lens  # every text has a token
            now = b.cls[b.ids]
            before = np.concatenate([[END], now[:-1]])
            logs = model.transition[before, now] + model.emission(b.n, b.cls)[b.ids]
            base = np.log10((b.n + 1) / slots)[b.ids]
            sums = lambda x, starts=starts: np.add.reduceat(x, starts)
            known = sums((b.n > 0)[b.ids].astype(np.int64))
            columns = [batch.column("doc_ids")[i].values, pa.array(~b.learn), pa.array(b.lens, pa.int64()), pa.array(known), pa.array(np.full(len(starts), total, np.int64)), pa.array(sums(base)), pa.array(sums(logs))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return in_arrow(seq, rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
