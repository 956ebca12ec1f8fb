"""Removal of repeated byte strings of WIDTH bytes or more, found by suffix order.

Every byte covered by a WIDTH-byte string that also starts somewhere else (same text or
another) goes. The corpus is never sorted as a whole: each WIDTH-byte string holds at
least one anchor, the q-gram with the least hash in the string, and equal strings have
equal anchors at equal places. So only texts around anchors that occur twice need a
comparison, and equal surroundings are compared once:

1. each text emits its anchors: hash, place, and a hash of the surroundings (every byte of
   every string that could have this anchor);
2. anchors found once are dropped; where equal surroundings are found at two places, they
   are repeated in full;
3. of each different surroundings one copy is read again. Its strings fall into LEVELS by how
   far they start before the anchor; the strings of a level have MIDDLE bytes in common, which
   are replaced by one mark, so a level is DEPTH bytes, the mark, DEPTH bytes;
4. levels of one anchor with equal middles meet in a task. A level that meets no other is
   done; different ones are ordered by suffixes (Lyndon grouping, suffixes.py), and
   neighbours that agree on DEPTH + 1 symbols are repeated strings;
5. where more than GROUP_MAX different levels would meet, they are not ordered in one task:
   the strings of those levels are hashed (128 bits) and counted by Spark, all of them;
6. the ranges found go back to the texts, are merged and cut out.

Texts are known by their 128-bit digests; hashes of anchors and surroundings have 64 bits
each, and both must agree. Copies of a text are one text with a count. Copies, and places
with the same surroundings, are one row of each Arrow batch before they are shuffled.

Edge cases: a null text is empty; texts shorter than WIDTH lose nothing; very long texts
are handled whole; a text found twice or more is its own repetition, so all of it goes if
it has WIDTH bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, in_arrow, read
from .shingles import _TABLE, byte_column, mix, slices
from .suffixes import _ranges, suffix_order, suffix_orders

WIDTH = 200
Q = 64
BEFORE = WIDTH - Q
LEVELS, DEPTH = 4, BEFORE // 4
MIDDLE = WIDTH - DEPTH
MARK = b"\xff"  # in no UTF-8 text
GROUP_MAX = 4096
#: Levels are ordered together in buffers of about so many bytes.
BUFFER_BYTES = 1 << 19
#: Fewer sets of about the same size than this are ordered one by one.
TOGETHER = 100
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


class _Powers:
    """Powers of the hash's factor and of its inverse, extended as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, x in (("up", _STEP), ("down", _BACK)):
                p = np.full(n, _U(x))
                p[0] = _U(1)
                setattr(self, name, np.cumprod(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Rolling:
    """Hashes of any range of `data`, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        up, self.down = _POWERS.get(len(data) + 1)
        table = mix(_TABLE + _U(salt)) if salt else _TABLE
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by running minima of blocks of w from both sides."""
    n = len(x)
    pad = -n % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place in the text, hash, hash of the surroundings) of all anchors."""
    w = width - q + 1  # q-grams in a string
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = Rolling(data)
    h = roll.of(np.arange(n - q + 1), np.arange(q, n + 1))
    least = sliding_min(h, w)  # for strings starting at 0..n - width
    lengths = np.diff(offsets)
    text_end = np.repeat(offsets[1:], lengths)
    inside = np.arange(n - width + 1) + width <= text_end[: n - width + 1]
    # a q-gram is an anchor if a string around it has its hash as the least one: the largest
    # of the minima of the strings around it (0 for strings across texts) is its hash
    least = np.where(inside, least, _U(0))
    full = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    most = ~sliding_min(~full, w)  # for q-grams at 0..n - q
    at = np.flatnonzero((most == h) & (most > 0))
    text = np.searchsorted(offsets, at, side="right") - 1
    start, end = np.maximum(at - (width - q), offsets[text]), np.minimum(at + width, offsets[text + 1])
    around = mix(roll.of(start, end) + (at - start).astype(np.uint64))
    return text, at - offsets[text], h[at], around


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a batch's different texts. Of places of the batch with the same surroundings, all
    repeated, one goes on to be met by others (`twice`); the others are `known` and go nowhere."""
    for batch in batches:
        names = batch.column("tid").to_pylist()
        rows = pa.array(sorted({t: k for k, t in reversed(list(enumerate(names)))}.values()), pa.int32())
        data, offsets = byte_column(batch.column("text").take(rows))
        tid = batch.column("tid").take(rows)
        found = [anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        text = np.concatenate([x[0] + i for x, (i, _) in zip(found, slices(offsets), strict=True)] or [np.zeros(0, np.int64)])
        at, h, around = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.uint64)]) for k in (1, 2, 3))
        order = np.lexsort((around, h))
        same = (h[order][1:] == h[order][:-1]) & (around[order][1:] == around[order][:-1])
        known, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
        known[order[1:][same]] = True
        twice[order[:-1][same]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), tid.take(pa.array(text)), pa.array(at.astype(np.int32)), pa.array(around.view(np.int64)), pa.array(twice & ~known), pa.array(known)], ["h", "tid", "at", "around", "twice", "known"]
        )


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, around, k, middle, level) for the wanted places of each text: the hash of the middle,
    and the bytes before it, the mark, and the bytes after it."""
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        wanted = batch.column("wanted")
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            local = offsets[i : j + 1] - offsets[i]
            own = wanted.slice(i, j - i)
            flat = own.flatten()
            owner = np.repeat(np.arange(j - i), np.diff(own.offsets.to_numpy()))
            h, around = flat.field("h"), flat.field("around")
            at = flat.field("at").to_numpy().astype(np.int64) + local[owner]
            low, high = local[owner], local[owner + 1]
            roll, raw = Rolling(part), part.tobytes()
            for k in range(LEVELS):
                s, e = at - k * DEPTH, at + MIDDLE - k * DEPTH
                fits = np.flatnonzero((s >= low) & (e <= high))
                s, e = s[fits], e[fits]
                s0, e1 = np.maximum(s - DEPTH, low[fits]), np.minimum(e + DEPTH, high[fits])
                level = [raw[a:b] + MARK + raw[c:d] for a, b, c, d in zip(s0.tolist(), s.tolist(), e.tolist(), e1.tolist(), strict=True)]
                take = pa.array(fits)
                yield pa.RecordBatch.from_arrays(
                    [h.take(take), around.take(take), pa.array(np.full(len(fits), k, np.int32)), pa.array(roll.of(s, e).view(np.int64)), pa.array(level, pa.binary())],
                    ["h", "around", "k", "middle", "level"],
                )


def _orders(data: np.ndarray, bounds: np.ndarray, first: np.ndarray, together: int) -> np.ndarray:
    """The suffix order of each set of strings, in turn. Sets start at the strings `first`; those of
    about the same size are ordered together, a few large ones by themselves."""
    low, high = bounds[first], bounds[np.append(first[1:], len(bounds) - 1)]
    out = np.empty(len(data), np.int64)
    size = high - low
    by = np.argsort(size, kind="stable")
    i = 0
    while i < len(by):
        j = int(np.searchsorted(size[by], 2 * size[by[i]], side="right"))
        some = by[i:j]
        i = j
        if len(some) < together:
            for t in some.tolist():
                a, b = np.searchsorted(bounds, [low[t], high[t]])
                out[low[t] : high[t]] = low[t] + np.array(suffix_order(data[low[t] : high[t]].tobytes(), (bounds[a : b + 1] - low[t]).tolist()))
            continue
        at, of = _ranges(low[some], high[some])
        starts = np.flatnonzero(np.isin(at, bounds[:-1]))
        out[at] = at[suffix_orders(data[at], starts, np.searchsorted(of, np.arange(len(some))))]
    return out


def repeated_starts(levels: list[bytes], group: list[int], together: int = TOGETHER, width: int = DEPTH + 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last): runs of starts of `width`-symbol substrings around the mark that are
    found in another string of its group, by suffix order. Strings of a group stand together."""
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in levels])])
    data = np.frombuffer(b"".join(levels), np.uint8)
    owner = np.repeat(np.arange(len(levels)), np.diff(bounds))
    g = np.array(group)
    order = _orders(data, bounds, np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), together)
    mark = np.array([p.index(MARK) for p in levels])
    own = owner[order]
    near = (bounds[own + 1] - order >= width) & (order - bounds[own] <= mark[own])
    order, own = order[near], g[own[near]]
    string = data[order[:, None] + np.arange(width)]
    same = np.flatnonzero((string[1:] == string[:-1]).all(axis=1) & (own[1:] == own[:-1]))
    at = np.unique(order[np.concatenate([same, same + 1])])
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)]))
    last = np.append(new[1:], len(at)) - 1
    of = owner[at[new]]
    return of, at[new] - bounds[of], at[last] - bounds[of]


_FOUND = "h long, around long, first int, last int, k int, middle long, level binary"
_FOUND_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
_FOUND_NAMES = ["h", "around", "first", "last", "k", "middle", "level"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_FOUND_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND_TYPES, strict=True)], _FOUND_NAMES)


def _range(k: int, level: bytes, start: int) -> int:
    """Where the string starts, from the anchor, whose level has the substring at `start`."""
    return -(k * DEPTH + level.index(MARK) - start)


def _met(batch: pa.RecordBatch) -> list[pa.Array]:
    """The batch's columns without the rows that are alone with their key; the first and the last key
    may go on in other batches."""
    key = [batch.column(c).to_numpy() for c in ("h", "k", "middle")]
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in key]), [True]])
    alone = new[:-1] & new[1:]
    alone[:1] = alone[-1:] = False
    keep = pa.array(np.flatnonzero(~alone))
    return [batch.column(c).take(keep) for c in ("h", "around", "k", "middle", "level")]


def _compare(batches: Iterator[pa.RecordBatch], group_max: int, together: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h, k, middle, level. Yields ranges of starts (first..last, from the
    anchor), and, with `level` set, the rows of groups too large for one task."""
    levels: list[bytes] = []  # different levels that wait for their order
    group: list[int] = []
    members: list[list[int]] = []  # the surroundings of each
    keys: list[tuple[int, int]] = []
    size = 0
    now: tuple | None = None
    held: list[tuple[bytes, list[int]]] = []
    large = False
    rows: list[tuple] = []

    def whole(key: tuple, level: bytes, arounds: list[int]) -> None:
        h, k, _ = key
        a = level.index(MARK)
        last = len(level) - DEPTH - 1  # the last start of a full substring
        if last >= 0 and a >= 0:
            lo, hi = _range(k, level, 0), _range(k, level, min(a, last))
            rows.extend((h, x, lo, hi, None, None, None) for x in arounds)

    def close() -> None:
        """The group `now` is complete."""
        nonlocal size
        for level, arounds in held:
            if len(arounds) > 1:
                whole(now, level, arounds)
        if len(held) > 1:
            for level, arounds in held:
                if len(arounds) == 1:
                    levels.append(level)
                    members.append(arounds)
                else:  # its strings are known to be repeated; it is there for the others
                    levels.append(level)
                    members.append([])
                group.append(len(keys))
                size += len(level)
            keys.append(now[:2])
        held.clear()

    def flush() -> None:
        nonlocal size
        for i, a, b in zip(*(x.tolist() for x in repeated_starts(levels, group, together)), strict=True):
            h, k = keys[group[i]]
            rows.extend((h, x, _range(k, levels[i], a), _range(k, levels[i], b), None, None, None) for x in members[i])
        for x in (levels, group, members, keys):
            x.clear()
        size = 0

    def spill() -> None:
        h, k, middle = now
        rows.extend((h, x, None, None, k, middle, level) for level, arounds in held for x in arounds)
        held.clear()

    for batch in batches:
        for h, around, k, middle, level in zip(*(x.to_pylist() for x in _met(batch)), strict=True):
            key = (h, k, middle)
            if key != now:
                if now is not None and not large:
                    close()
                now, large = key, False
                if size >= BUFFER_BYTES:
                    flush()
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if large:
                rows.append((h, around, None, None, k, middle, level))
                continue
            if held and held[-1][0] == level and len(held[-1][1]) < group_max:
                held[-1][1].append(around)
            else:
                held.append((level, [around]))
            if len(held) > group_max:
                spill()
                large = True
    if now is not None and not large:
        close()
    if levels:
        flush()
    yield _batch(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all substrings around the mark, for levels of large groups."""
    for batch in batches:
        for h, around, k, middle, level in zip(*(batch.column(c).to_pylist() for c in ("h", "around", "k", "middle", "level")), strict=True):
            data = np.frombuffer(level, np.uint8)
            start = np.arange(max(0, min(level.index(MARK), len(level) - DEPTH - 1) + 1))
            one, two = Rolling(data).of(start, start + DEPTH + 1), Rolling(data, 77).of(start, start + DEPTH + 1)
            n = len(start)
            first = np.array([_range(k, level, x) for x in start.tolist()], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(n, h, np.int64)), pa.array(np.full(n, around, np.int64)), pa.array(np.full(n, middle, np.int64)), pa.array(first, pa.int32())],
                ["one", "two", "h", "around", "middle", "first"],
            )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        raw = data.tobytes()
        ranges, copies = batch.column("ranges").to_pylist(), batch.column("copies").to_pylist()
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for k, given in enumerate(ranges):
            text = raw[offsets[k] : offsets[k + 1]]
            if (copies[k] or 0) > 1 and len(text) >= WIDTH:
                spans = [(0, len(text))]
            else:
                spans = []
                for x in sorted((max(0, x["start"]), min(len(text), x["end"])) for x in given or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], x[1]))
                    else:
                        spans.append(x)
            kept, at = hashlib.sha256(), 0
            for s, e in spans:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            n_bytes.append(len(text))
            n_removed.append(sum(e - s for s, e in spans))
            n_spans.append(len(spans))
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with tid, (tid, ranges, copies)): byte ranges to remove for each text, by its id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("tid"))
    long = rows.where(F.octet_length("text") >= WIDTH)
    copies = cut(long.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one")))
    found = cut(in_arrow(long.select("text", "tid"), _emit, "h long, tid binary, at int, around long, twice boolean, known boolean"))
    # one shuffle by anchor: what follows groups by it and by finer keys
    by_anchor = found.where("NOT known").repartition("h").groupBy("h", "around", "tid", "at").agg(F.max("twice").alias("twice"))
    each = by_anchor.groupBy("h", "around").agg(((F.count(F.lit(1)) > 1) | F.max("twice")).alias("full"), F.min(F.struct("tid", "at")).alias("rep"))
    whole = each.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.max("full").alias("any")).where("contexts > 1 OR any").select("h", "contexts")
    again = by_anchor.join(each.join(whole, "h"), ["h", "around"])
    # `twice` is in both sides of the join, so that they are one shuffle
    again = cut(again.select("h", "around", "tid", "at", (F.col("full") | F.col("twice")).alias("full"), (F.col("contexts") > 1).alias("mixed"), (F.struct("tid", "at") == F.col("rep")).alias("is_rep")))
    known = cut(found.where("known").select("tid", "at"))
    drop(found)
    # surroundings found at two places or more are repeated in full
    full = again.where("full").select("tid", "at").unionByName(known)
    full = full.select("tid", (F.col("at") - BEFORE).alias("start"), (F.col("at") + WIDTH).alias("end"))
    # one place of each different surroundings
    wanted = again.where("mixed AND is_rep").groupBy("tid").agg(F.collect_list(F.struct("h", "around", "at")).alias("wanted"))
    wanted = wanted.join(copies.select("tid", F.col("one").alias("doc_id")), "tid")
    chosen = long.join(wanted, "tid").where(long["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "wanted")
    levels = in_arrow(chosen, _levels, "h long, around long, k int, middle long, level binary")
    # rows of one id and text give the same levels twice
    levels = levels.repartition("h", "k", "middle").dropDuplicates(["h", "k", "middle", "level", "around"])
    compared = cut(in_arrow(levels.sortWithinPartitions("h", "k", "middle", "level"), partial(_compare, group_max=GROUP_MAX, together=TOGETHER), _FOUND))
    ranges = compared.where("level IS NULL").select("h", "around", "first", "last")
    large = compared.where("level IS NOT NULL")
    if not large.isEmpty():
        strings = in_arrow(large.select("h", "around", "k", "middle", "level"), _strings, "one long, two long, h long, around long, middle long, first int")
        key = ["one", "two", "h", "middle", "first"]
        twice = strings.groupBy(*key).agg(F.min("around").alias("lo"), F.max("around").alias("hi")).where("lo <> hi").select(*key)
        ranges = ranges.unionByName(strings.join(twice, key).select("h", "around", "first", F.col("first").alias("last")))
    ranges = again.where("mixed AND NOT full").join(ranges, ["h", "around"]).select("tid", (F.col("at") + F.col("first")).alias("start"), (F.col("at") + F.col("last") + WIDTH).alias("end"))
    ranges = full.unionByName(ranges)
    ranges = ranges.groupBy("tid", "start").agg(F.max("end").alias("end")).groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return rows, ranges.join(copies.where("copies > 1").select("tid", "copies"), "tid", "full")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    rows, ranges = repeated_ranges(docs)
    return in_arrow(rows.join(ranges, "tid", "left").select("doc_id", "text", "ranges", "copies"), _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
