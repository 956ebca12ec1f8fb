"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import blocks, classlm, phrases, resample
from graphloom.llm.common import cut
from graphloom.llm.mph import PerfectHash
from tests.llm.test_operators import prose


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in ("score", "rank", "n", "word", "block", "ids", "slot", "key", "_n", "class")})


# the perfect hash


@pytest.mark.parametrize("n", [0, 1, 2, 3, 65, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n)).astype(np.uint64)
    table = PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys))) and (table.keys[table.slots(keys)] == keys).all()
    strangers = keys + np.uint64(1)
    assert (table.slots(strangers[~np.isin(strangers, keys)]) == -1).all()


# blocks


def test_blocks_hold_every_token(spark):
    texts = [(i, prose(i, 50 + i), i % 3 > 0) for i in range(40)] + [(90, None, True), (91, "", True)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, learn boolean").coalesce(2)
    rows = blocks.encode(docs, F.col("text"), classlm.tokens, doc_id=F.col("doc_id"), learn=F.col("learn"), size=500).collect()
    assert len(rows) > 4 and len({r["block"] for r in rows}) == len(rows)
    got, counts = {}, Counter()
    for r in rows:
        ids, at = blocks.unpack(r["ids"]), 0
        for i, n in zip(r["doc_ids"], r["lens"], strict=True):
            words = r["words"].decode().split(" ")
            got[i] = [words[k] for k in ids[at : at + n]]
            at += n
        assert len(words) == r["n_words"] == len(set(words))
        counts.update(dict(zip(words, blocks.unpack(r["counts"]).tolist(), strict=True)))
    assert got == {i: (t or "").split() + [""] for i, t, _ in texts}
    assert +counts == Counter(w for i, t, own in texts if own for w in (t or "").split() + [""])


def test_blocks_agree_on_counts_and_numbers(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ENTRIES", 300)
    texts = [(i, ["x", "y"][i % 2], prose(i, 150)) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    coded = blocks.encode(docs, F.col("text"), classlm.tokens, group=F.col("lang"), doc_id=F.col("doc_id"), learn=F.col("doc_id") > 4, size=700)
    coded = cut(coded)
    agreed = blocks.agree(coded, 2, b"")
    want = Counter((g, w) for i, g, t in texts if i > 4 for w in [*t.split(), ""])
    words = agreed.words().collect()
    assert {(r["group"], r["word"]): r["n"] for r in words} == {k: n for k, n in want.items() if n >= 2 and k[1]}
    assert sorted(r["gid"] for r in words) == list(range(agreed.numbered)) and len(agreed.starts) > 4
    gid = {(r["group"], r["word"]): r["gid"] for r in words}
    schema = pa.schema([("group", pa.string()), ("n", pa.list_(pa.int64())), ("gid", pa.list_(pa.int64())), ("block", pa.int64())])
    rows = agreed.placed(coded, lambda row, n, g: (row["group"], n.tolist(), g.tolist(), row["block"]), schema, "group string, n array<long>, gid array<long>, block long").collect()
    own = {r["block"]: r["words"].decode().split(" ") for r in coded.select("block", "words").collect()}
    assert len(rows) == len(own) > 4
    for r in rows:
        keys = [(r["group"], w) for w in own[r["block"]]]
        assert r["n"] == [want[k] for k in keys] and r["gid"] == [gid.get(k, -1) for k in keys]
    for r in agreed.totals().collect():
        n = [v for (g, _), v in want.items() if g == r["group"]]
        assert tuple(r)[1:] == (sum(n), len(n), n.count(1), n.count(2), want[r["group"], ""])


def test_packed_numbers():
    numbers = np.array([0, 1, 255, 256, 65_536, 2**31 - 1])
    assert (blocks.unpack(blocks.pack(numbers)) == numbers).all() and (blocks.unpack(blocks.pack(numbers << 20, 8), 8) == numbers << 20).all()


# 13 resampling


def brute_resample(docs, target, runs, buckets, percent, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], *r[2:], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("runs", [1, 3])
def test_resampling_against_brute_force(spark, runs):
    docs = [(i, prose(i, 5 + i)) for i in range(60)] + [(100, None), (101, ""), (102, "ÄÖ É9a-b_c Straße\x00x" * 9), (None, prose(3, 40)), (103, prose(9, 20_000))]
    target = [prose(i, 30) for i in range(30, 35)] + [None, ""]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, goal, runs=runs, buckets=500, percent=30, min_words=12)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, runs, 500, 30, 12)


def test_tries_that_start_again(spark):
    docs = spark.createDataFrame([(i, prose(i, 90)) for i in range(12)], "doc_id long, text string").coalesce(1)
    whole, small = ({r["bucket"]: r["n"] for r in resample.bucket_totals(docs, 2, 300, n).collect()} for n in (10**6, 40))
    assert whole == small and sum(whole.values()) == 12 * (90 + 89)
    gain = list(range(-150, 150))
    assert sorted(map(tuple, resample.weights(docs, gain, 2, 40).collect())) == sorted(map(tuple, resample.weights(docs, gain, 2).collect()))


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, docs).count() == 0
    rows = resample.resample(docs, none, percent=100).collect()
    assert sorted(r["rank"] for r in rows if r["doc_id"] == 1) == [1, 2] and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert next(tuple(r)[1:3] for r in rows if r["doc_id"] == 2) == (0, 0)


# 12 phrases


def brute_phrases(docs, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        rows = []
        often = [p for p in c if c[p] >= least]
        inside = defaultdict(int)
        for p in often:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c[p])
        for p in often:
            if len(p) > 1 and not 100 * inside[p] >= 100 * c[p]:
                score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_docs(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [*"abcdefgh", "New", "york", "é", "日本", "x\x0by", "\x00", "|"]
    docs = []
    for i in range(60):
        w = list(rng.choice(vocabulary, int(rng.integers(0, 80))))
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = ["new", "York", "city", "hall", "steps", "down"][: int(rng.integers(2, 7))]
        text = "".join(x + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0c", " ! "])) for x in w)
        docs.append((["en", "fr", None, "und"][i % 4 if i < 30 else 0], text))
    return [*docs, ("en", None), ("en", ""), (None, "..."), docs[3], docs[3]]


@pytest.mark.parametrize("seed,shard,load,bits,spread", [(1, 1 << 21, 32, 28, 16), (2, 40, 1, 16, 2)])
def test_phrases_against_brute_force(spark, monkeypatch, seed, shard, load, bits, spread):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "SPREAD", spread)
    monkeypatch.setattr(phrases, "LOAD", load if load > 1 else 0.005)
    monkeypatch.setattr(phrases, "SLOT_BITS", bits)
    docs = phrase_docs(seed)
    df = clashing(spark.createDataFrame(docs, "lang string, text string")).repartition(5)
    got = phrases.collocations(df, least=4, longest=5, top=60)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(docs, 4, 5, 60)


def test_phrases_of_long_texts_and_empty_tables(spark):
    docs = [("en", "to be or not to be " * 4000), ("en", prose(1, 3000))]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == brute_phrases(docs, 100, 5, 2000)
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df, least=10**6).count() == 0


# 11 class-based bigrams


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def two_languages(n=150):
    rng = np.random.default_rng(8)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    return [(i, " ".join(rng.choice(tongues[i % 2], int(rng.integers(5, 60))))) for i in range(n)] + [(500, None), (501, ""), (None, "a1 a2"), (502, "A1 B2\x0bnever-seen\tb3"), (503, "once1 b1"), (600, "a1"), (600, "a1")]


def test_class_model_against_brute_force(spark):
    docs = two_languages()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""]
    train = [toks(t) for i, t in docs if i is not None and not held_out(i)]
    c = Counter(w for t in train for w in t)
    total, types = sum(c.values()), len(c)
    corpus = classlm.gather(df, 5)
    assert (corpus.n_tokens, corpus.n_types, corpus.once, corpus.twice) == (total, types, sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
    found, pairs, seen = classlm.exchange(corpus, 8, 4)
    cls = {r["word"]: r["class"] for r in corpus.words.join(found, "gid").select("word", "class").collect()}
    assert set(cls) == {w for w, n in c.items() if n >= 5 and w}
    of = lambda w: cls.get(w, classlm.END if not w else classlm.ONCE if c[w] <= 1 else classlm.FEW)
    want = np.zeros((8, 8), int)
    for t in train:
        for a, b in zip(["", *t], t, strict=False):
            want[of(a), of(b)] += 1
    assert (pairs == want).all() and max(seen) == pytest.approx(classlm.likelihood(want)) and max(seen) > seen[0]
    model = classlm.Model.of(pairs, corpus.once, corpus.twice)
    assert np.allclose((10**model.transition).sum(1), 1)
    share = defaultdict(float)
    for w in c:
        share[of(w)] += 10 ** float(model.emission(np.array([c[w]]), np.array([of(w)]))[0])
    share[classlm.ONCE] += model.unknown
    assert all(x == pytest.approx(1) for x in share.values())
    rows = classlm.score(df, 8, 5, 4).collect()
    assert len(rows) == len(docs)
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    for r in rows:
        t = toks(texts[r["doc_id"]][0])
        assert r["held_out"] == (r["doc_id"] is None or held_out(r["doc_id"]))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t))
        by_hand = sum(float(model.transition[of(a), of(b)] + model.emission(np.array([c[b]]), np.array([of(b)]))[0]) for a, b in zip(["", *t], t, strict=False))
        assert r["score"] == pytest.approx(by_hand)
    # the two word lists never meet inside a text: classes keep them apart, and texts are likelier
    own = Counter((k, w[0]) for w, k in cls.items())
    assert sum(max(own[k, "a"], own[k, "b"]) for k in set(cls.values())) > 0.9 * len(cls)
    assert sum(r["score"] - r["base_score"] for r in rows if r["held_out"]) > 0


def test_classes_joined_to_blocks(spark, monkeypatch):
    df = spark.createDataFrame(two_languages(40), "doc_id long, text string").coalesce(1)
    one = sorted(classlm.score(df, 8, 3, 2).collect(), key=repr)
    monkeypatch.setattr(classlm, "SPREAD_WORDS", -1)
    two = sorted(classlm.score(df, 8, 3, 2).collect(), key=repr)
    assert [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in two] and np.allclose([r["score"] for r in one], [r["score"] for r in two])


def test_own_class_and_ties():
    pairs = np.zeros((6, 6), int)
    pairs[0, 3], pairs[3, 4], pairs[4, 0], pairs[3, 3], pairs[3, 0] = 12, 9, 9, 3, 3
    own = np.zeros((1, 6), int)
    left, right = own.copy(), own.copy()
    left[0, 3], right[0, 0] = 3, 3
    assert classlm.best_classes(left, right, np.array([3], np.uint8), pairs)[0] == 4
    assert classlm.best_classes(own, own, np.array([5], np.uint8), pairs)[0] == 5


def test_class_model_edges(spark):
    schema = "doc_id long, text string"
    assert classlm.score(spark.createDataFrame([], schema)).count() == 0
    lone = classlm.score(spark.createDataFrame([(None, None)], schema)).first()
    assert tuple(lone)[:6] == (None, True, 1, 0, 0, 0.0) and lone["score"] <= 0
    long = spark.createDataFrame([(1, "word " * 300_000), (2, "x")], schema)
    assert {r["doc_id"]: r["n_tokens"] for r in classlm.score(long).collect()} == {1: 300_001, 2: 2}
