"""Texts as blocks of token numbers, each block with its own dictionary.

A task turns its texts into blocks of about TOKENS tokens. A token is its word's place in the
block's dictionary, so what a whole corpus must agree on about words (counts, numbers) goes
through the shuffle once for each word of a block, not once for each token, and packed.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

#: A block ends with the text that brings it to so many tokens, over all groups of a task.
TOKENS = 1 << 20
#: Words of blocks that a bucket has, about.
ENTRIES = 250_000

SCHEMA = "block long, group string, doc_ids array<long>, learn array<boolean>, lens array<int>, ids binary, n_words int, words binary, counts binary"

#: ASCII letters in lower case, as a table for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pack(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers from 0 as `width` planes of bytes, which the codecs of files and shuffles shorten well."""
    return np.ascontiguousarray(values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data, width: int = 4) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<i{width}").ravel()


class _Group:
    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.doc_ids, self.learn, self.lens, self.ids = [], [], [], array("i")

    def add(self, doc_id, learn: bool, words: list[bytes]) -> None:
        known, ids = self.number, self.ids
        for w in words:
            if w not in known:
                known[w] = len(known)
        ids.extend(map(known.__getitem__, words))
        self.doc_ids.append(doc_id)
        self.learn.append(learn)
        self.lens.append(len(words))

    def row(self, block: int, group: str) -> list:
        ids = np.frombuffer(self.ids, np.int32)
        own = ids[np.repeat(np.array(self.learn, bool), self.lens)]
        counts = np.bincount(own, minlength=len(self.number)).astype(np.int32)
        return [block, group, self.doc_ids, self.learn, self.lens, pack(ids), len(self.number), b" ".join(self.number), pack(counts)]


def encode(docs: DataFrame, text: Column, tokens: Callable[[bytes], list[bytes]], group: Column | None = None, doc_id: Column | None = None, learn: Column | None = None, size: int = TOKENS) -> DataFrame:
    """Rows of SCHEMA. `words` of a block are distinct, joined by spaces (no token holds one); `counts`
    are those of its texts with `learn`; ids and counts are packed.

    The number of a block rests on the task and its order of rows, so write the table before
    reading it twice.
    """
    given = [F.lit("") if group is None else group, F.lit(None).cast("long") if doc_id is None else doc_id.cast("long"), F.lit(True) if learn is None else learn]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        groups: dict[str, _Group] = {}
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for k, name in enumerate(sorted(groups)):
                row = groups[name].row(first + n + k, name)
                types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                columns = [pa.array([v], t) for v, t in zip(row, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "group", "doc_ids", "learn", "lens", "ids", "n_words", "words", "counts"])

        for batch in batches:
            for name, i, own, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens(value)
                groups.setdefault(name, _Group()).add(i, own, words)
                held += len(words)
                if held >= size:
                    yield from rows()
                    n, held, groups = n + len(groups), 0, {}
        yield from rows()

    cells = docs.select(*[c.alias(n) for c, n in zip(given, ("group", "doc_id", "learn"), strict=True)], F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("text"))
    return in_arrow(cells, pack, SCHEMA)


AGREED = "summary boolean, bucket int, block long, group string, local binary, n binary, place binary, words binary, totals array<long>"
_AGREED = pa.schema([("summary", pa.bool_()), ("bucket", pa.int32()), ("block", pa.int64()), ("group", pa.string()), ("local", pa.binary()), ("n", pa.binary()), ("place", pa.binary()), ("words", pa.binary()), ("totals", pa.list_(pa.int64()))])
_ASKS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("group", pa.string()), ("words", pa.binary()), ("local", pa.binary()), ("counts", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema.names)


@dataclass
class Agreed:
    """What all blocks know of their words: a written table with the replies to the blocks and a row
    of sums for each bucket of words, and each bucket's first number."""

    table: DataFrame
    starts: np.ndarray

    @property
    def numbered(self) -> int:
        return int(self.starts[-1])

    def totals(self) -> DataFrame:
        """(group, tokens, types, once, twice, skipped): counted tokens and words, words counted once and
        twice, tokens that are the word `skip`."""
        t = F.col("totals")
        return self.table.where("summary").groupBy("group").agg(*[F.sum(t[i]).alias(c) for i, c in enumerate(("tokens", "types", "once", "twice", "skipped"))])

    def words(self) -> DataFrame:
        """(gid, group, word, n) of the numbered words."""
        starts = self.starts

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, group, place, n, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "group", "place", "n", "words")), strict=True):
                    own = words.split(b" ") if words is not None else []
                    yield pa.RecordBatch.from_arrays([pa.array(starts[bucket] + unpack(place)), pa.array([group] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(unpack(n, 8))], ["gid", "group", "word", "n"])

        return in_arrow(self.table.where("summary").select("bucket", "group", "place", "n", "words"), spread, "gid long, group string, word string, n long")

    def placed(self, coded: DataFrame, f: Callable[[dict, np.ndarray, np.ndarray], tuple], schema: pa.Schema, sql: str) -> DataFrame:
        """A row `f(block's row, n, gid)` for each block: the count and the number (-1: none) of every
        word by its place in the block's dictionary."""
        got = self.table.where("NOT summary").groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("bucket", "local", "n", "place")).alias("replies"))
        starts = self.starts

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n, gid = np.zeros(row["n_words"], np.int64), np.full(row["n_words"], -1, np.int64)
                    for r in row.pop("replies") or []:
                        local = np.cumsum(unpack(r["local"]))
                        if r["n"] is not None:
                            n[local] = unpack(r["n"], 8)
                        at = unpack(r["place"])
                        gid[local] = np.where(at > 0, starts[r["bucket"]] + at - 1, -1)
                    yield _rows([f(row, n, gid)], schema)

        return in_arrow(coded.drop("words", "counts").join(got, F.col("block") == F.col("_block"), "left").drop("_block"), place, sql)


def agree(coded: DataFrame, least: int, skip: bytes, tell_counts: bool = True) -> Agreed:
    """Sum the counts of all blocks' words, tell them to the blocks, and number the words (by group)
    counted `least` times or more, `skip` left out. Without `tell_counts`, blocks get the numbers only.

    A block's words are dealt to buckets by hash, packed, as many buckets as bring about ENTRIES
    words together; a bucket's rows are one packed row for each block.
    """
    entries = coded.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-entries // ENTRIES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, group, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, counts, salt = words.split(b" "), unpack(counts), crc32(group.encode())
                bucket = (np.fromiter((crc32(w, salt) for w in own), np.uint64, len(own)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets < len(own) else np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]), len(own)]
                rows = []
                for a, z in zip(ends[:-1], ends[1:], strict=True):
                    if a < z:
                        at = order[a:z]
                        rows.append((int(bucket[at[0]]), block, group, b" ".join([own[i] for i in at]), pack(np.diff(at, prepend=0)), pack(counts[at])))
                yield _rows(rows, _ASKS)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
        for bucket in sorted(held):
            rows, known = held.pop(bucket), {}
            for r in rows:
                count = known.setdefault(r["group"], {})
                for w, n in zip(r["words"].split(b" "), unpack(r["counts"]).tolist(), strict=True):
                    count[w] = count.get(w, 0) + n
            at, place = 0, {}
            out = []
            for group in sorted(known):
                count = known[group]
                chosen = sorted(w for w, n in count.items() if n >= least and w != skip)
                place[group] = {w: at + k + 1 for k, w in enumerate(chosen)}
                n = np.fromiter(count.values(), np.int64, len(count))
                totals = [int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum()), count.get(skip, 0)]
                out.append((True, bucket, None, group, None, pack(np.array([count[w] for w in chosen]), 8), pack(np.arange(at, at + len(chosen))), b" ".join(chosen) if chosen else None, totals))
                at += len(chosen)
            yield _rows(out, _AGREED)
            for r in rows:
                own, count, numbers = r["words"].split(b" "), known[r["group"]], place[r["group"]]
                yield _rows([(False, bucket, r["block"], r["group"], r["local"], pack(np.array([count[w] for w in own]), 8) if tell_counts else None, pack(np.array([numbers.get(w, 0) for w in own])), None, None)], _AGREED)

    asks = in_arrow(coded.select("block", "group", "words", "counts"), ask, "bucket int, block long, group string, words binary, local binary, counts binary")
    table = cut(in_arrow(asks.repartition("bucket"), reply, AGREED))
    sizes = np.zeros(buckets + 1, np.int64)
    for r in table.where("summary").groupBy("bucket").agg(F.sum(F.length("place") / 4).cast("long").alias("n")).toLocalIterator():
        sizes[r["bucket"] + 1] = r["n"]
    return Agreed(table, np.cumsum(sizes))
