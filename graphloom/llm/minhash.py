"""Near-duplicate classes by ProbMinHash.

Texts are weighted sets of five-word shingles (weight: times found). Each shingle runs a
Poisson process whose rate is its weight; an arrival falls into one of M registers, each
register keeps the shingle of its earliest arrival, and a shingle stops as soon as its
next arrival comes after the latest register (early termination). Two texts agree in a
register with probability equal to their probability Jaccard similarity. Signatures are
cut into bands; texts that share a band are candidates, and a candidate pair is verified
by the exact probability Jaccard of its whole shingle sets. Classes are the connected
components of verified links.

Equal texts are collapsed first (one digest each), so a group of copies costs one row. A
bucket of a band never emits all pairs. Its texts are first set against a few centres, and
pairs whose signatures agree in PROMISING of the registers (more than three standard errors
below SIMILARITY) are verified. Buckets whose texts are then in one component are settled.
In what is still open every pair of texts of different components is compared, in blocks of
about UNIT texts on a side: an upper bound of the similarity of all pairs of a block comes
from matrix products over its shingles, pairs above it are verified exactly, and only links
that join two components of the block become rows; no bucket is capped.

Edge cases: a null text is a class of its own (its doc_id); equal texts are one class,
empty ones too; a text of fewer than five words has one shingle of all its words; rows
that share a doc_id but not a text keep their own rows; an empty table gives an empty
result; other columns are ignored (kept by `deduplicate`). A null doc_id gets the least
doc_id of its class, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_arrow, read
from .components import components
from .pairwise import blocks_of_pairs
from .shingles import byte_column, mix, shingles, slices, weighted, words

BANDS, ROWS = 20, 4
M = BANDS * ROWS
SIMILARITY = 0.8
CENTRES = 4
PROMISING = 0.64
UNIT, UNIT_BYTES = 1024, 1 << 24
#: Shingles of at most FEW texts of a block are added pair by pair, others COLUMNS at a time.
FEW, COLUMNS = 32, 2048
_U = np.uint64


def signatures(text: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) winning shingles; text, sh and weight hold the distinct shingles of n texts."""
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    latest = np.full(n, np.inf)
    t, r = np.zeros(len(sh)), 0
    rate = weight.astype(np.float64)
    while len(sh):
        r += 1
        u = mix(sh + _U(r * 0xD1B54A32D192ED03 % (1 << 64)))
        t = t - np.log(((u >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = t < latest[text]
        text, sh, rate, t, u = text[live], sh[live], rate[live], t[live], u[live]
        if not len(sh):
            break
        at = text * m + ((mix(u) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        np.minimum.at(earliest, at, t)
        won = earliest[at] == t
        winner[at[won]] = sh[won]
        latest = earliest.reshape(n, m).max(axis=1)
    return winner.reshape(n, m)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_column(batch.column("text"))
        for i, j in slices(offsets):
            part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            h, _, _, counts = words(part, local)
            sh, _, per = shingles(h, counts)
            sig = signatures(*weighted(sh, per), j - i).reshape(j - i, BANDS, ROWS)
            key = np.zeros((j - i, BANDS), np.uint64)
            for k in range(ROWS):
                key = mix(key * _U(0x9E3779B97F4A7C15) + sig[:, :, k])
            key = mix(key + np.arange(BANDS, dtype=np.uint64)[None, :] * _U(0xA24BAED4963EE407))
            some = per > 0
            ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel().view(np.int64)))
            short = pa.array([x.tobytes() for x in sig.reshape(j - i, M).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("digest").slice(i, j - i), bands, short], ["doc_id", "digest", "bands", "sig"])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted elements, weights)."""
    (x, v), (y, w) = a, b
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    union = np.union1d(x, y)
    va, wa = np.zeros(len(union)), np.zeros(len(union))
    va[np.searchsorted(union, x)], wa[np.searchsorted(union, y)] = v, w
    ratio, kind = np.unique(v[i] / w[j], return_inverse=True)
    total = np.array([np.maximum(va, r * wa).sum() for r in ratio])
    return float((v[i] / total[kind]).sum())


def _set_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    h, _, _, counts = words(data, np.array([0, len(data)]))
    sh, _, per = shingles(h, counts)
    _, s, w = weighted(sh, per)
    return s, w.astype(np.float64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks_of_pairs: b's text, then its partners'."""
    known = None
    for batch in batches:
        texts, kinds = batch.column("text"), batch.column("kind").to_pylist()
        keep = []
        for k, kind in enumerate(kinds):
            own = _set_of(texts[k].as_py().encode())
            if kind == 0:
                known = own
            elif probability_jaccard(own, known) >= SIMILARITY:
                keep.append(k)
        at = pa.array(keep, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests whose texts are similar."""
    blocks = blocks_of_pairs(pairs, texts.select(F.col("digest").alias("id"), "text"), [])
    return in_arrow(blocks, _verify, "a binary, b binary")


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's members with the bucket's centre, b. Buckets fall into CENTRES
    classes with orders of their own, so a group of near copies meets that many centres."""
    kind = F.pmod(F.col("bucket"), F.lit(CENTRES))
    order = F.struct(F.xxhash64("node", kind).alias("o"), F.col("node").alias("c"))
    centres = members.groupBy("bucket").agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.col("c.c").alias("b"))
    return members.join(centres, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures promise enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("sig_a", "sig_b"))
        at = pa.array(np.flatnonzero((x == y).mean(axis=1) >= PROMISING))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    sig = lambda c: nodes.select(F.col("digest").alias(c), F.col("sig").alias(f"sig_{c}"))
    return in_arrow(pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b"), _agree, "a binary, b binary")


def overlaps(text: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, n): the share of text a's weight that lies on shingles of text b.

    text, sh and weight hold the distinct shingles of n texts. Shingles of few texts are added
    pair by pair, the others by matrix products, COLUMNS shingles at a time.
    """
    share = (weight / np.bincount(text, weight, n)[text]).astype(np.float32)
    order = np.argsort(sh, kind="stable")
    text, sh, share = text[order], sh[order], share[order]
    _, column, df = np.unique(sh, return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    few = (df[column] > 1) & (df[column] <= FEW)
    t, c, w = text[few], column[few], share[few]
    for d in range(1, FEW):
        at = np.flatnonzero(c[d:] == c[:-d])
        if not len(at):
            break
        np.add.at(out, (t[at], t[at + d]), w[at])
        np.add.at(out, (t[at + d], t[at]), w[at + d])
    many = df[column] > FEW
    t, c, w = text[many], np.unique(column[many], return_inverse=True)[1], share[many]
    for lo in range(0, int(c[-1]) + 1 if len(c) else 0, COLUMNS):
        i, j = np.searchsorted(c, [lo, lo + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[t[i:j], c[i:j] - lo] = w[i:j]
        out += dense @ (dense > 0).astype(np.float32).T
    return out


def _links_of_block(nodes: list[bytes], labels: list[bytes], side: np.ndarray, texts: list[bytes], within: bool) -> tuple[list, list]:
    """Links that join the components of a block's texts: pairs within it, or between its two sides.

    With p(B) the share of a's weight on b's shingles, 1 / J_P >= 1 / p(B) + 1 / q(A) - 1 (equal
    where no shingle is repeated), so pairs below SIMILARITY by this bound need no closer look.
    """
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    h, _, _, counts = words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    sh, _, per = shingles(h, counts)
    text, sh, weight = weighted(sh, per)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    share = overlaps(text, sh, weight, len(texts))
    with np.errstate(divide="ignore"):
        near = 1 / share + 1 / share.T - 1 <= 1 / SIMILARITY + 1e-3
    known: dict[bytes, int] = {}
    component = np.array([known.setdefault(x, len(known)) for x in labels])
    own = lambda k: (sh[ends[k] : ends[k + 1]], weight[ends[k] : ends[k + 1]].astype(np.float64))
    a, b = [], []
    for k in range(len(texts)):
        other = np.flatnonzero(near[k])
        other = other[other > k] if within else other[side[other] > side[k]]
        while len(other := other[component[other] != component[k]]):
            x, other = int(other[0]), other[1:]
            if probability_jaccard(own(k), own(x)) >= SIMILARITY:
                component[component == component[x]] = component[k]
                a.append(nodes[k])
                b.append(nodes[x])
    return a, b


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, i, j): a block (i = j), or two blocks (sides 0 and 1)."""
    now, rows = None, []

    def links() -> pa.RecordBatch:
        nodes, labels, side, texts = zip(*rows, strict=True)
        found = _links_of_block(nodes, labels, np.array(side), texts, now[1] == now[2])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in found], ["a", "b"])

    for batch in batches:
        texts = batch.column("text")
        for k, (bucket, i, j, side, node, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "node", "label")), strict=True)):
            if (bucket, i, j) != now:
                if len(rows) > 1:
                    yield links()
                now, rows = (bucket, i, j), []
            rows.append((node, label, side, texts[k].as_py().encode()))
    if len(rows) > 1:
        yield links()


def _blocks(still: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within open buckets. A bucket of many texts, or of long ones, is cut into blocks,
    and each pair of its blocks is a task's group of its own."""
    m = still.join(texts.select(F.col("digest").alias("node"), "text"), "node")
    size = still.join(texts.select(F.col("digest").alias("node"), F.octet_length("text").alias("bytes")), "node").groupBy("bucket")
    size = size.agg(F.greatest(F.ceil(F.count(F.lit(1)) / UNIT), F.ceil(F.sum("bytes") / UNIT_BYTES), F.lit(1)).cast("int").alias("parts"))
    m = m.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("bucket", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", "label", "text")
    m = m.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return in_arrow(m, _compare_blocks, "a binary, b binary").distinct()


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, node, label) of buckets that still hold texts of different components."""
    now = _labelled(members.select("bucket", "node"), labels)
    mixed = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("bucket", "n")
    return now.join(mixed, "bucket")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, bucket) for buckets of two texts or more; of buckets with the same texts, one."""
    members = nodes.select(F.col("digest").alias("node"), F.explode("bands").alias("bucket"))
    # one row a bucket: how many texts, and 128 bits of which
    sets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]).where("n > 1")
    one = sets.groupBy("n", "x0", "x1").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(one, "bucket")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed rows, (digest, label, class_id)) of a table of documents; a label is a class."""
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    signed = cut(in_arrow(rows.where(F.col("text").isNotNull()), _sign, "doc_id long, digest binary, bands array<long>, sig binary"))
    nodes = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    members = cut(_buckets(nodes))
    pairs = cut(_promising(_stars(members), nodes))
    # texts are shuffled once, those of buckets kept, a row for all copies of a text; how many there
    # are has no bound, so they are not broadcast at any size
    needed = members.select(F.col("node").alias("digest")).distinct().hint("merge")
    texts = cut(rows.join(needed, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")))
    links = cut(_verified(pairs, texts))
    labels = components(links)
    # a bucket of two texts is open as well if the signature filter dropped its pair
    still = cut(_open(members, labels))
    if not still.isEmpty():
        links = links.unionByName(cut(_blocks(still, texts)))
        labels = components(links)
    labels = _labelled(nodes.select(F.col("digest").alias("node"), "doc_id"), labels)
    least = labels.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return signed, labels.join(least, "label").select(F.col("node").alias("digest"), "label", "class_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the least doc_id of the row's class."""
    signed, by_digest = classes(docs)
    known = signed.select("doc_id", "digest").join(by_digest, "digest").select("doc_id", "class_id")
    return known.unionByName(docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Keep one row of each class, that of the least doc_id; rows with a null text stay. Other columns,
    of any name, stay as they are."""
    signed, by_digest = classes(docs)
    # the row to keep: the text that holds the class's least doc_id, one row of it
    keep = signed.select("doc_id", "digest").join(by_digest, "digest").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = keep.groupBy("label").agg(F.min("digest").alias("digest"), F.first("class_id").alias("class_id")).drop("label")
    # a class has one digest here, so the join and the choice of one row share a shuffle
    tagged = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = tagged.join(keep, "digest").where(F.col("row.doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["digest"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.where(F.col("text").isNull()))
