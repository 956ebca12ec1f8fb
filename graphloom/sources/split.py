"""Statements of large text files that are read in byte ranges.

Spark splits a text file at line breaks, but a quoted CSV field or a long Turtle string may hold
line breaks, so whether a range starts inside one rests on everything before it. One pass over the
lines gives, for each range, what state it ends in from each state it may start in. The driver
composes these small maps along each file (a row a range), so every range knows its start. A second
pass cuts the ranges into statements; only what lies over a range's ends is brought together with
its other pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import cut, small_batches

#: `scan(line, state)` gives the state after the line and the offsets in it where statements end; a
#: None state means that the line cannot be read from there.
Scan = Callable[[str, int], tuple[int | None, list[int]]]
#: For the lines of a batch at once: the state after them from each state, and whether a statement ends
#: on the way; None if that takes `scan`.
Codes = Callable[[pa.Array], tuple[list[int], list[bool]] | None]
#: `bulk(lines, state)` gives the state after a batch, the lines that end a statement (one each, at the line's
#: end) and the statements' texts within the batch; None if that takes `scan`.
Bulk = Callable[[pa.Array, int], tuple[int, np.ndarray, pa.Array] | None]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines of all files, in order within a range, which starts at byte `start`."""
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), "value")


def _maps(scan: Scan, codes: Codes | None, states: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, ended = None, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]], pa.int64()), pa.array([now], pa.list_(pa.int32())), pa.array([ended], pa.list_(pa.bool_()))], ["file", "start", "ends", "ended"])

        for batch in batches:
            ahead = _one_range(batch) if codes is not None else None
            after = codes(batch.column("value")) if ahead is not None else None
            if after is not None:
                if ahead != held:
                    if held is not None:
                        yield row()
                    held, now, ended = ahead, list(range(states)), [False] * states
                ended = [e or (s is not None and after[1][s]) for s, e in zip(now, ended, strict=True)]
                now = [None if s is None else after[0][s] for s in now]
                continue
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != held:
                    if held is not None:
                        yield row()
                    held, now, ended = (file, start), list(range(states)), [False] * states
                after = {s: scan(value, s) for s in set(now) if s is not None}
                ended = [e or (s is not None and bool(after[s][1])) for s, e in zip(now, ended, strict=True)]
                now = [None if s is None else after[s][0] for s in now]
        if held is not None:
            yield row()

    return run


#: Bits of a statement's place within its range; a range's number stands above them.
PLACE = 34
#: The place of a statement over a range's end: after all that end in the range.
LAST = 1 << 33


def _cuts(scan: Scan, bulk: Bulk | None, first: dict[tuple[str, int], tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # `at` is the place, in characters or bytes, where the piece in hand begins
        held, state, own, owner, k, at, piece, out = None, 0, 0, -1, 0, 0, [], []

        def add(text: str, whole: bool) -> None:
            """A statement, or the start or the end of one that lies over a range's end."""
            if k == 0 and owner >= 0:
                out.append((owner << PLACE | LAST, own, text))
            else:
                out.append((own << PLACE | at, -1, text) if whole else (own << PLACE | LAST, 0, text))

        def turn(file: str, start: int) -> None:
            nonlocal held, state, own, owner, k, at, piece
            if piece:
                add("".join(piece), False)
            held, k, at, piece = (file, start), 0, 0, []
            state, own, owner = first[held]

        for batch in batches:
            ahead = _one_range(batch) if bulk is not None else None
            if ahead is not None:
                if ahead != held:
                    turn(*ahead)
                cuts = bulk(batch.column("value"), state)
                if cuts is not None:
                    state, ends, texts = cuts
                    if not len(ends):
                        piece += [x for line in batch.column("value").to_pylist() for x in (line, "\n")]
                        yield _pieces(out)
                        out = []
                        continue
                    # the first may begin before the batch; all others lie inside it
                    base = at + sum(map(len, piece))
                    starts = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("value")).to_numpy().astype(np.int64) + 1)])
                    add("".join([*piece, texts[0].as_py()]), True)
                    k += len(ends)
                    yield _pieces(out)
                    out = []
                    if len(texts) > 1:
                        begins = pa.array((own << PLACE) + base + starts[ends[:-1] + 1], pa.int64())
                        yield pa.RecordBatch.from_arrays([begins, pa.array(np.full(len(begins), -1, np.int64)), texts[1:]], ["seq", "piece", "text"])
                    at = base + int(starts[ends[-1] + 1])
                    piece = ["", "\n"] + [x for line in batch.column("value")[int(ends[-1]) + 1 :].to_pylist() for x in (line, "\n")]
                    continue
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != held:
                    turn(file, start)
                state, ends = scan(value, state)
                if state is None:
                    raise ValueError(f"{file}: {value[:80]!r}")
                begin = 0
                for end in ends:
                    add("".join([*piece, value[begin:end]]), True)
                    at += sum(map(len, piece)) + end - begin + 1
                    piece, begin, k = [], end, k + 1
                piece += [value[begin:], "\n"]
            yield _pieces(out)
            out = []
        if piece:
            add("".join(piece), False)
        yield _pieces(out)

    return run


def _one_range(batch: pa.RecordBatch) -> tuple[str, int] | None:
    """The range of all lines of a batch; None if there is more than one. A range's lines are together."""
    if not len(batch):
        return None
    ends = [(batch.column("file")[i].as_py(), batch.column("start")[i].as_py()) for i in (0, len(batch) - 1)]
    return ends[0] if ends[0] == ends[1] else None


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["seq", "piece", "text"])


def statements(spark: SparkSession, path: str, scan: Scan, states: int, codes: Codes | None = None, bulk: Bulk | None = None) -> tuple[DataFrame, list[tuple[int, str]]]:
    """((seq, text), files): the statements of all files in order of seq, and the first seq of each file.

    seq is distinct and follows the text, at least a statement's length apart from the next in a
    range: the range's number over all files, then the place in the range. No row is sorted or numbered for it.
    """
    small_batches(spark)
    rows = lines(spark, path)
    first: dict[tuple[str, int], tuple[int, int, int]] = {}
    files: list[tuple[int, str]] = []
    state, file, owner = 0, None, -1
    maps = rows.mapInArrow(_maps(scan, codes, states), "file string, start long, ends array<int>, ended array<boolean>")
    for i, r in enumerate(sorted(maps.collect(), key=lambda r: (r["file"], r["start"]))):  # a row a range
        if r["file"] != file:
            state, file, owner = 0, r["file"], -1
            files.append((i << PLACE, file))
        if state is None:
            raise ValueError(f"{file}: unreadable before byte {r['start']}")
        first[r["file"], r["start"]] = (state, i, owner)
        if r["ended"][state] or owner < 0:
            owner = i
        state = r["ends"][state]
    # read once: pieces go through a shuffle by statement, of which there is one a range
    cuts = cut(rows.mapInArrow(_cuts(scan, bulk, first), "seq long, piece long, text string"))
    parts = cuts.where("piece >= 0").groupBy("seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text"))
    return cuts.where("piece < 0").select("seq", "text").unionByName(parts.select("seq", "text")), files


# CSV

_REST = re.compile(r'(?:[^"]|"")*"(?!")[^,]*')
_FIELD = re.compile(r'(?:"(?:[^"]|"")*"(?!")[^,]*|(?!")[^,]*)(?:,|$)')


def scan_csv(line: str, state: int) -> tuple[int, list[int]]:
    """State 1 is inside a quoted field; a record ends with a line in state 0."""
    if '"' not in line:
        return state, [] if state else [len(line)]
    at = 0
    if state:
        m = _REST.match(line)
        if m is None:
            return 1, []
        at = m.end()
        if at < len(line):
            at += 1  # the comma
        elif at == len(line):
            return 0, [len(line)]
    while True:
        m = _FIELD.match(line, at)
        if m is None:
            return 1, []
        at = m.end()
        if at == len(line):
            return 0, [len(line)]


# whole batches of lines. A line is plain if its quoted fields begin at a field's start and no other quotes
# are in it; which of these holds then says what state it leads to. Only plain lines are handled here.
_PLAIN = r'(?:"(?:[^"]|"")*"[^",]*|[^",]*)'
_WAYS = (
    (0, 0, rf"(?s)\A{_PLAIN}(?:,{_PLAIN})*\z"),
    (0, 1, rf'(?s)\A(?:{_PLAIN},)*"(?:[^"]|"")*\z'),
    (1, 0, rf'(?s)\A(?:[^"]|"")*"[^",]*(?:,{_PLAIN})*\z'),
    (1, 1, rf'(?s)\A(?:[^"]|"")*(?:"[^",]*,(?:{_PLAIN},)*"(?:[^"]|"")*)?\z'),
)


def _after(lines: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """The state after each line from state 0 and from state 1; None if a line is not plain."""
    n = len(lines)
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    after = [np.zeros(n, np.int8), np.ones(n, np.int8)]
    if quoted.any():
        some = lines.filter(pa.array(quoted))
        for s in (0, 1):
            to0, to1 = (pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False) for a, _, p in _WAYS if a == s)
            if not (to0 ^ to1).all():
                return None
            after[s][quoted] = to1
    return after[0], after[1]


def _states(zero: np.ndarray, one: np.ndarray, state: int) -> np.ndarray:
    """The state after each line, from `state` before the first."""
    fixed, flip = zero == one, (zero == 1) & (one == 0)
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(zero)), -1))
    flips = np.cumsum(flip)
    before = np.where(at >= 0, zero[at], state)
    return before ^ ((flips - np.where(at >= 0, flips[at], 0)) & 1)


def csv_codes(lines: pa.Array) -> tuple[list[int], list[bool]] | None:
    after = _after(lines)
    if after is None:
        return None
    ways = [_states(*after, s) for s in (0, 1)]
    return [int(w[-1]) for w in ways], [bool((w == 0).any()) for w in ways]


def csv_bulk(lines: pa.Array, state: int) -> tuple[int, np.ndarray, pa.Array] | None:
    after = _after(lines)
    if after is None:
        return None
    way = _states(*after, state)
    ends = np.flatnonzero(way == 0)
    if len(ends) == len(lines):
        return 0, ends, lines
    groups = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]), pa.int32()), lines)
    return int(way[-1]), ends, pc.binary_join(groups, "\n")
