"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and runs of white space become one space. An item is cut into
overlapping segments of SEGMENT characters (a shorter item is one segment); a text is
contaminated where some stretch of it is within a segment's edit budget: MAX_EDITS for each SEGMENT
characters, but few enough that the bound below demands a third of the q-grams (6 edits at 100
characters). Two such
stretches share at least len + 1 - q * (edits + 1) q-grams, all near one diagonal, so
shared q-grams are counted in overlapping bands of diagonals, bands that reach the bound
are kept, and those are verified by a banded alignment with free ends in the text.

The benchmark may have any size: its items are cut into parts of at most PART_CHARS and a segment's
characters, whose q-grams are a table. What goes to the tasks that scan the documents is a Bloom
filter of these q-grams, 2^27 bits (16 MB) at most. One scan leaves the places of the documents
where q-grams of the filter are as dense as the bound demands, with a margin; the documents
themselves are not shuffled. Each different place then meets the parts with which it really has enough
q-grams (a join by q-gram), and the pairs are counted by band and aligned, in ranges of (part, place),
so that a part which many documents hold is many tasks. A fuller filter leaves more places, and
changes no result.

Edge cases: a null or empty text or item matches nothing; items too short for the bound
get fewer edits (down to 0), items shorter than q match nothing; very long texts are
scanned whole; repeated rows are matched each; items with a null item_id are
looked for and reported under a null item_id; empty tables give empty results; other
columns are ignored (kept by `decontaminate`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import observed
from .common import cut, in_arrow, read
from .shingles import mix

Q = 9
#: A stretch of SEGMENT characters is at most STRIDE // 2 places from a segment, within its 6 edits.
SEGMENT, STRIDE = 100, 7
MAX_EDITS = 8
#: A multiple of STRIDE and of SEGMENT // 2, so that the segments of the parts are those of the item.
PART_CHARS = 1750
#: Bits of the filter for each q-gram of the benchmark, and its least and greatest size in powers of 2.
BITS_A_GRAM, LEAST_BITS, MOST_BITS = 64, 22, 27
_PROBES = (0, 18, 35)
#: A stretch and its segment lie within so many places.
REACH = SEGMENT + 2 * MAX_EDITS
#: Texts are scanned in slices of about so many characters.
SLICE_CHARS = 1 << 19
#: Places are full of hits, each in up to 15 segments: fewer characters of them at once.
PLACE_CHARS = 1 << 14
_U = np.uint64
_BITS = 22
_F = [int(x) | 1 for x in mix(np.arange(1, 5, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))]


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(cp: np.ndarray) -> np.ndarray:
    """Hashes of all 9-grams, by doubling: 2, 4, 8, then one more."""
    n = len(cp) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = cp.astype(np.uint64) + _U(1)
    h2 = x[:-1] * _U(_F[0]) + x[1:]
    h4 = h2[:-2] * _U(_F[1]) + h2[2:]
    h8 = h4[:-4] * _U(_F[2]) + h4[4:]
    return mix(h8[:n] * _U(_F[3]) + x[8 : 8 + n])


@dataclass
class Index:
    """Segments of items and their q-grams."""

    item: list[int | None]
    segment: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    seg_of: np.ndarray
    pos_of: np.ndarray
    bitmap: np.ndarray


def build_index(items: list[tuple[int, str]], ready: bool = False) -> Index | None:
    """The index of a few items; `ready` texts are normalised already."""
    owner, segments = [], []
    for item_id, text in items:
        cp = code_points(text if ready else normalise(text))
        if len(cp) < Q:
            continue
        starts = [0] if len(cp) <= SEGMENT else sorted({*range(0, len(cp) - SEGMENT + 1, STRIDE), *range(0, len(cp) - SEGMENT + 1, SEGMENT // 2), len(cp) - SEGMENT})
        for s in starts:
            owner.append(item_id)
            segments.append(cp[s : s + SEGMENT])
    if not segments:
        return None
    length = np.array([len(s) for s in segments])
    # at most MAX_EDITS per SEGMENT, and few enough that the bound demands a third of the q-grams
    edits = np.maximum(np.minimum(MAX_EDITS * length // SEGMENT, (2 * (length + 1 - Q)) // (3 * Q)), 0)
    need = np.maximum(length + 1 - Q * (edits + 1), 1)
    h = [grams(s) for s in segments]
    keys = np.concatenate(h)
    seg = np.repeat(np.arange(len(h)), [len(x) for x in h])
    pos = np.concatenate([np.arange(len(x)) for x in h])
    order = np.argsort(keys, kind="stable")
    keys, seg, pos = keys[order], seg[order], pos[order]
    unique, first = np.unique(keys, return_index=True)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(unique >> _U(64 - _BITS)).astype(np.int64)] = True
    return Index(owner, segments, edits, need, unique, np.append(first, len(keys)), seg, pos, bitmap)


def align(segments: list[np.ndarray], text: np.ndarray, low: np.ndarray, high: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Least edits between each segment and a stretch of `text` on the diagonals low..high
    (text position less segment position), widened by `edits` on both sides."""
    n, rows = len(segments), max(map(len, segments))
    width = int((high - low + 2 * edits).max()) + 1
    length = np.array([len(s) for s in segments])
    pattern = np.zeros((n, rows), np.uint32)
    for i, s in enumerate(segments):
        pattern[i, : len(s)] = s
    base = (low - edits)[:, None] + np.arange(width)[None, :]
    big = 1 << 20
    inside = lambda j: (j >= -1) & (j < len(text))
    step = np.arange(width)
    # d[k]: cost after i segment characters, with text position base + i - 1 + k as the last one used
    j = base - 1
    d = np.where(inside(j), 0, big)
    best = np.where(length == 0, 0, big)
    for i in range(rows):
        j = base + i
        ok = inside(j) & (j >= 0)
        same = text[np.clip(j, 0, len(text) - 1)] == pattern[:, i : i + 1]
        new = np.where(ok, d + ~same, big)  # diagonal: the segment's character against the text's
        up = np.full_like(d, big)
        up[:, :-1] = d[:, 1:] + 1  # the segment's character against nothing
        new = np.where(inside(j), np.minimum(new, up), big)
        new = np.minimum.accumulate(new - step, axis=1) + step  # a text character against nothing
        new = np.where(inside(j), new, big)
        d = new
        best = np.where(length == i + 1, d.min(axis=1), best)
    return best


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with Q zeros after each (no q-gram of a text has a zero), and where each begins."""
    cps = [code_points(t) for t in texts]
    gap = np.zeros(Q, np.uint32)
    cp = np.concatenate([x for c in cps for x in (c, gap)]) if cps else gap
    return cp, np.cumsum([0, *[len(c) + Q for c in cps]])[: len(cps)]


def dense(hit: np.ndarray, least: int) -> np.ndarray:
    """Which of the ascending places are among `least` neighbours within REACH: a stretch has as many."""
    if len(hit) < least:
        return np.zeros(len(hit), bool)
    step = np.zeros(len(hit) + 1, np.int64)
    full = np.flatnonzero(hit[least - 1 :] - hit[: len(hit) - least + 1] <= REACH)
    np.add.at(step, full, 1)
    np.add.at(step, full + least, -1)
    return np.cumsum(step[:-1]) > 0


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(row, item, edits, start) of every verified segment, for normalised texts."""
    cp, begins = joined(texts)
    h = grams(cp)
    hit = np.flatnonzero(index.bitmap[(h >> _U(64 - _BITS)).astype(np.int64)])
    if not len(hit):
        return []
    at = np.searchsorted(index.keys, h[hit])
    known = index.keys[np.minimum(at, len(index.keys) - 1)] == h[hit]
    hit, at = hit[known], at[known]
    keep = dense(hit, int(index.need.min()))
    hit, at = hit[keep], at[keep]
    if not len(hit):
        return []
    n = index.first[at + 1] - index.first[at]
    which = np.repeat(np.arange(len(hit)), n)
    post = np.repeat(index.first[at], n) + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    seg, row = index.seg_of[post], np.searchsorted(begins, hit[which], side="right") - 1
    diag = hit[which] - begins[row] - index.pos_of[post]  # of the row alone, whatever lies before it
    step = index.edits[seg] + 1
    found = []
    seg2, row2, diag2 = np.tile(seg, 2), np.tile(row, 2), np.tile(diag, 2)
    band = np.concatenate([diag // step, diag // step + 1])  # each diagonal lies in two bands
    order = np.lexsort((band, seg2, row2))
    seg2, row2, diag2, band = seg2[order], row2[order], diag2[order], band[order]
    new = np.ones(len(band), bool)
    new[1:] = (band[1:] != band[:-1]) | (seg2[1:] != seg2[:-1]) | (row2[1:] != row2[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(band)))
    good = start[count >= index.need[seg2[start]]]
    if not len(good):
        return []
    step = index.edits[seg2[good]] + 1
    low, high = (band[good] - 1) * step, (band[good] + 1) * step - 1
    for i in range(0, len(good), 512):  # bounds the alignment's memory
        part = slice(i, i + 512)
        s, r = seg2[good][part], row2[good][part]
        cost = align([index.segment[k] for k in s], cp, low[part] + begins[r], high[part] + begins[r], index.edits[s])
        for k in np.flatnonzero(cost <= index.edits[s]):
            found.append((int(r[k]), index.item[s[k]], int(cost[k]), max(0, int(low[part][k]))))
    return found


def _slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


@dataclass
class Filter:
    """A Bloom filter of the benchmark's q-grams, and the fewest that any segment demands."""

    words: np.ndarray
    least: int

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be q-grams of the benchmark."""
        at, mask = np.arange(len(h)), _U(64 * len(self.words) - 1)
        for shift in _PROBES:
            slot = (h[at] >> _U(shift)) & mask
            at = at[(self.words[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) == 1]
        return at


@dataclass
class Benchmark:
    """The benchmark as tables: owners (part, item_id), texts (part, text), q-grams (hash, part, need)."""

    owners: DataFrame
    texts: DataFrame
    grams: DataFrame
    filter: Filter | None


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = [], []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text, start = normalise(text), 0
            while start == 0 or len(text) - start > SEGMENT:
                ids.append(item_id)
                texts.append(text[start : start + PART_CHARS + SEGMENT])
                start += PART_CHARS
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["item_id", "text"])


def _grams_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, parts, needs = [np.zeros(0, np.uint64)], [], []
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (index := build_index([(0, text)], ready=True)) is not None:
                hashes.append(index.keys)
                parts += [part] * len(index.keys)
                needs += [int(index.need.min())] * len(index.keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(parts, pa.string()), pa.array(needs, pa.int32())], ["hash", "part", "need"])


def prepare(benchmark: DataFrame) -> Benchmark:
    """The benchmark's tables, written once, and its filter."""
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    parts = cut(in_arrow(items, _parts, "item_id long, text string").withColumn("part", F.md5("text")))
    texts = parts.groupBy("part").agg(F.first("text").alias("text"))
    grams, m = observed(in_arrow(texts.select("part", "text"), _grams_of_parts, "hash long, part string, need int"), n=F.count(F.lit(1)), least=F.min("need"))
    held = None
    if m["n"]:
        bits = min(max((m["n"] * BITS_A_GRAM - 1).bit_length(), LEAST_BITS), MOST_BITS)
        slots = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in _PROBES])).alias("slot")
        bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
        words = grams.select(slots).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2^21 rows at most
        held = Filter(np.zeros(1 << (bits - 6), np.uint64), m["least"])
        held.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Benchmark(parts.select("part", "item_id").distinct(), texts, grams, held)


def _places(held: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The dense places of each text, REACH characters wider on both sides; `low` and `high` bound the dense
    part. A match has all its common q-grams in one place, as neighbours of them are within REACH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalise(t) for t in batch.column("text").to_pylist()]
            row, at, low, high, place = [], [], [], [], []
            for i, j in _slices(texts):
                cp, begins = joined(texts[i:j])
                hit = held.holds(grams(cp))
                hit = hit[dense(hit, held.least)]
                if not len(hit):
                    continue
                of = np.searchsorted(begins, hit, side="right") - 1
                gap = np.flatnonzero((np.diff(hit) > REACH) | (np.diff(of) > 0))
                first, last = np.append(0, gap + 1), np.append(gap, len(hit) - 1)
                for r, x, y in zip(of[first].tolist(), (hit[first] - begins[of[first]]).tolist(), (hit[last] - begins[of[last]]).tolist(), strict=True):
                    start = max(0, x - REACH)
                    row.append(i + r)
                    at.append(start)
                    low.append(x - start)
                    high.append(y + Q - start)
                    place.append(texts[i + r][start : y + Q + REACH])
            kept = batch.drop_columns(["text"]).take(pa.array(row, pa.int32()))
            columns = [pa.array(at, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(place, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, "at", "low", "high", "place"])

    return run


def _grams_of_places(held: Filter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for text in batch.column(1).to_pylist():
                h = grams(code_points(text))
                h, n = np.unique(h[held.holds(h)], return_counts=True)
                hashes.append(h)
                counts.append(n)
            core = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), [len(h) for h in hashes[1:]])))
            yield pa.RecordBatch.from_arrays([core, pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts))], ["core", "hash", "n"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least edits and first place of each pair of a place and a part; pairs come by part."""
    last, index = None, None
    for batch in batches:
        part, part_text, place = (batch.column(c).to_pylist() for c in ("part", "part_text", "text"))
        best: dict[int, list[int]] = {}
        i = 0
        while i < len(part):
            j = i
            while j < len(part) and part[j] == part[i]:
                j += 1
            if part[i] != last:
                last, index = part[i], build_index([(0, part_text[i])], ready=True)
            for a, b in _slices(place[i:j], PLACE_CHARS):
                for row, _, edits, start in search(index, place[i + a : i + b]):
                    x = best.setdefault(i + a + row, [edits, start])
                    x[0], x[1] = min(x[0], edits), min(x[1], start)
            i = j
        rows = pa.array(list(best), pa.int32())
        found = [pa.array([x[k] for x in best.values()], t) for k, t in ((0, pa.int32()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("digest").take(rows), batch.column("part").take(rows), *found], ["digest", "part", "edits", "start"])


def _contaminated(rows: DataFrame, known: Benchmark) -> tuple[DataFrame, DataFrame]:
    """(places, found) for `rows` of any columns with a text: places have the other columns, `at` and a digest;
    found has (digest, part, edits, start), start counted from the place's own."""
    others = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "at long, low int, high int, place string"])
    core = F.substring("place", F.col("low") + 1, F.col("high") - F.col("low"))
    places = in_arrow(rows, _places(known.filter), schema)
    places = cut(places.select(*[f.name for f in others], "at", F.md5("place").alias("digest"), F.md5(core).alias("core"), core.alias("core_text"), "place"))
    cores = places.groupBy("core").agg(F.first("core_text").alias("text"))
    grams_ = in_arrow(cores, _grams_of_places(known.filter), "core string, hash long, n long")
    met = grams_.join(known.grams, "hash").groupBy("core", "part").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need")
    distinct = places.groupBy("digest", "core").agg(F.first("place").alias("text"))
    pairs = met.select("core", "part").join(distinct, "core").join(known.texts.withColumnRenamed("text", "part_text"), "part")
    pairs = pairs.select("digest", "text", "part", "part_text").repartitionByRange("part", "digest").sortWithinPartitions("part")
    return places, cut(in_arrow(pairs, _verify, "digest string, part string, edits int, start long"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start): items of which a stretch is in the document; edits is the
    least over the item's segments, start the first place, in characters of the normalised text."""
    known = prepare(benchmark)
    if known.filter is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, start long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    places, found = _contaminated(rows, known)
    out = places.select("row", "doc_id", "at", "digest").join(found, "digest").join(known.owners, "part")
    out = out.groupBy("row", "doc_id", "item_id").agg(F.min("edits").alias("edits"), F.min(F.col("at") + F.col("start")).alias("start"))
    return out.select("doc_id", "item_id", "edits", "start")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no stretch of any item; rows are judged by their text."""
    known = prepare(benchmark)
    if known.filter is None:
        return docs
    places, found = _contaminated(docs.select(F.md5("text").alias("key"), "text"), known)
    bad = cut(places.join(found, "digest", "left_semi").select("key").distinct())
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5("text").alias("key")).join(bad, "key", "left_anti").select("row.*")


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
