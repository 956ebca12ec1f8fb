"""op12: phrases whose words belong together, counted by a minimal perfect hash over safe candidates.

Words are counted by block dictionaries. Words seen LEAST times or more get numbers; everything else
breaks the text, as the ends of pieces do. Every longer level works on the numbers of the level
below: a phrase of k words is a pair of neighbouring phrases of k - 1 words, both frequent, so no
phrase that can be frequent is left out. For one level

1. mappers count pairs by hashed slot; pairs in a slot seen less than LEAST times go (no frequent
   pair can be there), whatever the number of slots,
2. the distinct pairs left are the candidates; they get a minimal perfect hash with the keys kept,
   in shards of SHARD keys at most,
3. mappers look up each pair's slot, which the kept key confirms, and count slots into numpy arrays;
   the arrays are summed as a tree, SPREAD of them at a time,
4. slots seen LEAST times or more are the level's phrases, their slots its numbers.

The counts of both parts of every cut of a phrase are then read by slot, from the tables of the
levels below.

Defined results: a null or empty text has no words; a null lang is `und`, together with rows that
say so; repeated rows count as often as they are there; an empty table gives no rows. A lang's rank
is by score, then a, then the phrase's UTF-8 bytes. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import observed
from . import blocks
from .common import cut, drop, in_arrow, read
from .mph import PerfectHash, mix

LEAST, LONGEST, TOP = 100, 5, 2000

#: Keys of a perfect hash at most: 16 MB of kept keys and as much of counts in a task.
SHARD = 1 << 21
#: Hashed slots of one pass at most (a bit each reaches the mappers: 32 MB), and pairs for one slot
#: before a pass more is made.
SLOT_BITS, LOAD = 28, 32
#: Slots of a reducer's array, and arrays summed at once.
SLICE_BITS, SPREAD = 16, 16
#: Slices of hashed keys, in which the tasks' candidates meet.
KEY_SLICE_BITS = 10
#: Pairs that a mapper brings together before it counts them.
HELD = 1 << 19

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_BREAK = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text's pieces, A-Z lowered, with a line feed wherever a piece ends."""
    return [w for w in (text.translate(_FOLD) + _BREAK).replace(_BREAK, b" \n ").split(b" ") if w]


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of neighbouring numbers."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, (ids[at].astype(np.uint64) << np.uint64(32)) | ids[at + 1].astype(np.uint64)


def _squeezed(ids: np.ndarray) -> bytes:
    """Runs of -1 become one."""
    keep = ids >= 0
    keep[1:] |= ids[:-1] >= 0
    return blocks.pack(ids[keep])


class Slots:
    """Where pairs are hashed to: `part` of `parts` passes, with 2^bits slots each."""

    def __init__(self, pairs: int, part: int = 0):
        self.bits = int(min(SLOT_BITS, max(SLICE_BITS, np.ceil(np.log2(max(pairs, 1) / 16)))))
        self.parts = max(1, -(-pairs // int(LOAD * 2**self.bits)))
        self.part = part

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are of this pass, their slots)."""
        h = mix(keys)
        own = h % np.uint64(self.parts) == self.part if self.parts > 1 else np.ones(len(keys), bool)
        return own, (h[own] >> np.uint64(64 - self.bits)).astype(np.int64)


def _keys_of(batches: Iterator[pa.RecordBatch], column: str = "ids") -> Iterator[np.ndarray]:
    """The keys of many blocks at once."""
    held, n = [], 0
    for batch in batches:
        for ids in batch.column(column):
            _, keys = _pairs(blocks.unpack(ids.as_buffer()))
            held.append(keys)
            n += len(keys)
            if n >= HELD:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _partial(slots: np.ndarray, n: np.ndarray, leaf: int) -> pa.RecordBatch:
    """Counts of rising slots, packed by slice."""
    part = slots >> SLICE_BITS
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    rows = [(int(part[a]), leaf, (slots[a:b] & ((1 << SLICE_BITS) - 1)).astype(np.uint16).tobytes(), n[a:b].astype(np.int64).tobytes()) for a, b in zip(starts, [*starts[1:], len(part)][: len(starts)], strict=True)]
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "leaf", "slots", "n"])


PARTIAL = "slice int, leaf int, slots binary, n binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for part, leaf, slots, n in zip(batch.column("slice").to_pylist(), batch.column("leaf").to_pylist(), batch.column("slots"), batch.column("n"), strict=True):
            into = sums.setdefault((part, leaf), np.zeros(1 << SLICE_BITS, np.int64))
            into[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int64)  # a row's slots are distinct
    return sums


def tree_sum(partials: DataFrame, tasks: int) -> DataFrame:
    """PARTIAL rows, SPREAD leaves added at a time until few are left for each slice."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, leaf), n in sorted(_sums(batches).items(), key=lambda x: x[0]):
            hit = np.flatnonzero(n)
            yield _partial(hit + (part << SLICE_BITS), n[hit], leaf)

    while tasks > SPREAD:
        tasks = -(-tasks // SPREAD)
        up = partials.withColumn("leaf", (F.col("leaf") / SPREAD).cast("int"))
        partials = in_arrow(up.repartition("slice", "leaf"), add, PARTIAL)
    return partials.withColumn("leaf", F.lit(0)).repartition("slice")


def _busy_slots(seq: DataFrame, slots: Slots, least: int) -> np.ndarray:
    """A bit for each slot whose pairs were seen `least` times or more together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId()
        for keys in _keys_of(batches):
            yield _partial(*np.unique(slots.of(keys)[1], return_counts=True), leaf)

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(part, np.packbits(n >= least, bitorder="little").tobytes()) for (part, _), n in _sums(batches).items() if (n >= least).any()]
        columns = zip(*rows, strict=True) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary()), strict=True)], ["slice", "bits"])

    sums = tree_sum(in_arrow(seq, count, PARTIAL), seq.rdd.getNumPartitions())
    out = np.zeros(1 << (slots.bits - 3), np.uint8)
    step = 1 << (SLICE_BITS - 3)
    for r in in_arrow(sums, busy, "slice int, bits binary").toLocalIterator():  # 2^(bits - 3) bytes in all
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return out


def _in_busy(keys: np.ndarray, slots: Slots, bits: np.ndarray) -> np.ndarray:
    own, at = slots.of(keys)
    own[own] = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return own


def _candidates(seq: DataFrame, pairs: int, least: int) -> tuple[DataFrame, list[tuple[Slots, object]]]:
    """((key, shard-free) distinct pairs that may be frequent, the slots' bits on the workers)."""
    out, filters = None, []
    for part in range(Slots(pairs).parts):
        slots = Slots(pairs, part)
        bits = seq.sparkSession.sparkContext.broadcast(_busy_slots(seq, slots, least))
        filters.append((slots, bits))

        def distinct(batches: Iterator[pa.RecordBatch], slots=slots, bits=bits) -> Iterator[pa.RecordBatch]:
            own = np.zeros(0, np.uint64)
            for keys in _keys_of(batches):
                own = np.unique(np.concatenate([own, np.unique(keys[_in_busy(keys, slots, bits.value)])]))
                if len(own) >= HELD:
                    yield by_slice(own)
                    own = own[:0]
            yield by_slice(own)

        def by_slice(keys: np.ndarray) -> pa.RecordBatch:
            part = mix(keys, 1) >> np.uint64(64 - KEY_SLICE_BITS)
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0]) if len(keys) else np.zeros(0, int)
            packed = [x.tobytes() for x in np.split(keys[order], starts[1:])] if len(keys) else []
            return pa.RecordBatch.from_arrays([pa.array(part[order][starts].astype(np.int32)), pa.array(packed, pa.binary())], ["slice", "keys"])

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, keys in zip(batch.column("slice").to_pylist(), batch.column("keys"), strict=True):
                    held[part] = np.union1d(held.get(part, np.zeros(0, np.uint64)), np.frombuffer(keys.as_buffer(), np.uint64))
            for keys in held.values():
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

        new = in_arrow(in_arrow(seq, distinct, "slice int, keys binary").repartition("slice"), once, "key long")
        out = new if out is None else out.union(new)
    return cut(out), filters


def _shard(keys: DataFrame, shards: int, k: int):
    """A perfect hash over the keys of shard k, on the workers; SHARD keys or so, 16 MB."""
    own = keys.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == k)
    return keys.sparkSession.sparkContext.broadcast(PerfectHash(np.sort(own.toPandas()["key"].to_numpy(np.int64)).view(np.uint64)))


def _level(seq: DataFrame, pairs: int, least: int, last: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """((slot, left, right, a) of the frequent pairs, the next level's sequences, their pairs)."""
    keys, filters = _candidates(seq, pairs, least)
    n = keys.count()
    shards = max(1, -(-n // SHARD))
    found, base = None, 0
    now = seq.withColumn("next", F.lit(None).cast("binary"))
    for k in range(shards):
        table = _shard(keys, shards, k)

        def look_up(pair_keys: np.ndarray, table=table) -> np.ndarray:
            out = np.full(len(pair_keys), -1, np.int64)
            open_ = np.zeros(len(pair_keys), bool)
            for slots, bits in filters:
                open_ |= _in_busy(pair_keys, slots, bits.value)
            out[open_] = table.value.slots(pair_keys[open_])
            return out

        def count(batches: Iterator[pa.RecordBatch], table=table, look_up=look_up) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(table.value), np.int64)
            for pair_keys in _keys_of(batches):
                at = look_up(pair_keys)
                sums += np.bincount(at[at >= 0], minlength=len(sums))
            hit = np.flatnonzero(sums)
            yield _partial(hit, sums[hit], TaskContext.get().partitionId())

        def frequent(batches: Iterator[pa.RecordBatch], table=table, base=base) -> Iterator[pa.RecordBatch]:
            for (part, _), sums in _sums(batches).items():
                at = np.flatnonzero(sums >= least)
                slot = at + (part << SLICE_BITS)
                own = table.value.keys[slot]
                columns = [slot + base, (own >> np.uint64(32)).astype(np.int64), (own & np.uint64(0xFFFFFFFF)).astype(np.int64), sums[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "left", "right", "a"])

        sums = tree_sum(in_arrow(seq, count, PARTIAL), seq.rdd.getNumPartitions())
        rows = cut(in_arrow(sums, frequent, "slot long, left long, right long, a long"))
        found = rows if found is None else found.union(rows)
        if not last:
            own = np.zeros(len(table.value), bool)
            own[rows.select("slot").toPandas()["slot"].to_numpy(np.int64) - base] = True  # a shard's slots at most
            kept = seq.sparkSession.sparkContext.broadcast(own)

            def rename(batches: Iterator[pa.RecordBatch], look_up=look_up, kept=kept, base=base, end=k + 1 == shards) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for ids, old in zip(batch.column("ids"), batch.column("next"), strict=True):
                        own = blocks.unpack(ids.as_buffer())
                        new = blocks.unpack(old.as_buffer()) if old.is_valid else np.full(len(own), -1, np.int32)
                        at, pair_keys = _pairs(own)
                        slot = look_up(pair_keys)
                        ok = slot >= 0
                        ok[ok] = kept.value[slot[ok]]
                        new[at[ok]] = slot[ok] + base
                        # after the last shard only the new numbers go on, with their number of pairs
                        row = (None, _squeezed(new), len(_pairs(new)[0])) if end else (ids.as_py(), blocks.pack(new), 0)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["ids", "next", "pairs"])

            now, m = observed(in_arrow(now.select("ids", "next"), rename, "ids binary, next binary, pairs long"), n=F.coalesce(F.sum("pairs"), F.lit(0)))
        base += len(table.value)
        if base >= 1 << 31:
            raise ValueError("a level has more than 2^31 candidates")
    drop(keys)
    if last:
        return found, None, 0
    after = now.select(F.col("next").alias("ids"))
    after._cut_path = now._cut_path
    return found, after, m["n"]


_SEQUENCES = pa.schema([("ids", pa.binary()), ("pairs", pa.int64())])


def _first_level(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(all words counted (lang, n), frequent words (slot, lang, word, a), sequences (ids), their pairs)."""
    coded = cut(blocks.encode(docs, F.col("text"), tokens, group=F.coalesce("lang", F.lit("und"))))
    agreed = blocks.agree(coded, least, _BREAK, tell_counts=False)
    if agreed.numbered >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")

    def rename(row: dict, n: np.ndarray, gid: np.ndarray) -> tuple:
        ids = gid[blocks.unpack(row["ids"])]
        return _squeezed(ids), len(_pairs(ids)[0])

    seq, m = observed(agreed.placed(coded.select("block", "ids", "n_words"), rename, _SEQUENCES, "ids binary, pairs long"), n=F.coalesce(F.sum("pairs"), F.lit(0)))
    total = cut(agreed.totals().select(F.col("group").alias("lang"), (F.col("tokens") - F.col("skipped")).alias("n")))
    words = cut(agreed.words().select(F.col("gid").alias("slot"), F.col("group").alias("lang"), "word", F.col("n").alias("a")))
    drop(coded)
    drop(agreed.table)
    return total, words, seq, m["n"]


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, phrase, size, a, l, r, n, score, inside)) of all phrases of 2 to `longest`
    words seen `least` times; `inside` tells of a longer phrase around it that is as frequent."""
    total, words, seq, pairs = _first_level(docs, least)
    level = words.select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("end"), "a", F.array("a").alias("pre"), F.array("a").alias("suf"))
    levels = []
    for k in range(2, longest + 1):
        found, after, pairs = _level(seq.select("ids"), pairs, least, k == longest)
        drop(seq)
        left = level.select(F.col("slot").alias("left"), "lang", F.col("phrase").alias("head"), F.col("pre").alias("head_pre"))
        right = level.select(F.col("slot").alias("right"), "end", F.col("suf").alias("tail_suf"))
        both = found.join(left, "left").join(right, "right")
        level = cut(both.select("slot", "left", "right", "lang", F.concat_ws(" ", "head", "end").alias("phrase"), "end", "a", F.concat("head_pre", F.array("a")).alias("pre"), F.concat("tail_suf", F.array("a")).alias("suf")))
        levels.append(level)
        seq = after
    out = None
    for i, level in enumerate(levels):
        k, rows = i + 2, level
        if i + 1 < len(levels):
            for side in ("left", "right"):
                above = levels[i + 1].groupBy(F.col(side).alias("slot")).agg(F.max("a").alias(f"by_{side}"))
                rows = rows.join(above, "slot", "left")
            inside = F.coalesce(F.greatest("by_left", "by_right") >= F.col("a"), F.lit(False))
        else:
            inside = F.lit(False)
        rows = rows.join(total, "lang")
        wide = lambda c: c.cast("decimal(19,0)")
        cuts = []
        for j in range(1, k):
            l, r = F.col("pre")[j - 1], F.col("suf")[k - j - 1]
            score = F.call_function("div", wide(F.col("a") * 1000) * wide(F.col("n")), wide(l) * wide(r))
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        part = rows.withColumn("c", best).select("lang", "phrase", F.lit(k).alias("size"), "a", "c.l", "c.r", "n", "c.score", inside.alias("inside"))
        out = part if out is None else out.union(part)
    return total, out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's `top` phrases that are not inside an
    equally frequent longer one."""
    rows = phrases(docs, least, longest)[1].where(~F.col("inside")).drop("inside", "size")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # first within salts, so a lang is not one task; then within `top` rows of each salt
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = rows.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same rows from DuckDB: all runs of words are counted as strings."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    runs = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, ws[i:i + {k - 1}] AS w FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces)" for k in range(1, longest + 1))
    return f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), f AS (SELECT lang, k, phrase, any_value(w) AS w, count(*) AS a FROM ({runs}) GROUP BY lang, k, phrase HAVING count(*) >= {least}),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.w, c.a, t.n, x.a AS l, y.a AS r, j, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c JOIN total t ON t.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.w[j + 1:c.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, k, a, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM f WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {top}
"""
