"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, minhash, passages, quality, sharding, spm, toxicity
from tests.llm.test_operators import prose


def docs(spark):
    long = prose(50, 40_000)
    rows = [(None, prose(51, 80)), (None, prose(51, 80)), (1, None), (2, ""), (3, long), (4, prose(52, 70)), (4, prose(52, 70)), (5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def clashing(df, *names):
    return df.withColumns({c: F.lit("mine") for c in names})


def equal_for_equal_rows(rows, *ignore):
    """Rows with the same doc_id of `docs` have the same results."""
    for i in (None, 4):
        same = [{k: v for k, v in r.asDict().items() if k not in ignore} for r in rows if r["doc_id"] == i]
        assert len(same) == 2 and same[0] == same[1]


def test_sharding(spark):
    df = clashing(docs(spark), "size", "digest", "bucket")
    rows = sharding.shard(df, 3).collect()
    equal_for_equal_rows(rows, "shard", "slot", "position", "row_number")
    assert len(rows) == 8 and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}
    assert sharding.shard(df.limit(0), 3).count() == 0


def test_quality(spark):
    df = clashing(docs(spark), "words", "n_words", "votes", "kept")
    rows = quality.judge(df).collect()
    equal_for_equal_rows(rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and by_id[3]["n_words"] == 40_000 and by_id[1]["n_words"] == by_id[2]["n_words"] == 0
    assert by_id[1]["base_failed"] and not by_id[1]["kept"] and not by_id[5]["kept"]


def test_encoding(spark):
    df = clashing(docs(spark), "ids", "decoded", "digest")
    rows = spm.encode(df, spm.model_bytes()).collect()
    equal_for_equal_rows(rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 8 and by_id[1]["ids"] == [] == by_id[2]["ids"] and by_id[1]["decoded"] is None and by_id[2]["decoded"] == ""
    assert by_id[3]["decoded"] == by_id[3]["text"] and by_id[3]["digest"] == "mine"
    assert spm.encode(df.limit(0), spm.model_bytes()).count() == 0


def test_toxicity(spark):
    df = clashing(docs(spark), "score", "toxic", "x", "digest")
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    rows = toxicity.score(df, model).collect()
    equal_for_equal_rows(rows)
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.filter_toxic(df, model).columns == df.columns
    assert toxicity.score(df, toxicity.train(df, labels.limit(0))).count() == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_alignment_of_all_segments(spark, seed):
    """The query's pairs, against the least edits of every segment of every item in every text."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh ")
    items = [(i, "".join(rng.choice(letters, 130))) for i in range(3)]
    rows = []
    for k in range(14):
        own = decontaminate.normalise(items[k % 3][1])
        part = list(own[k : k + 105])
        for at in rng.choice(len(part), int(rng.integers(0, 12)), replace=False):
            part[at] = ["", "zz", "y"][at % 3]
        rows.append((k, "".join(rng.choice(letters, 40)) + "".join(part) + "".join(rng.choice(letters, 30))))
    rows += [rows[0], (20, "".join(rng.choice(letters, 200))), (21, None)]

    def least(segment, text):
        best = np.zeros(len(text) + 1, int)
        for c in segment:
            new = np.minimum(best[:-1] + (np.array(list(text)) != c), best[1:] + 1)
            row = np.concatenate([[best[0] + 1], new])
            best = np.minimum.accumulate(row - np.arange(len(row))) + np.arange(len(row))
        return best.min()

    want = set()
    for item in items:
        index = decontaminate.build_index([item])
        for doc, text in rows:
            if text and any(least([chr(c) for c in s], decontaminate.normalise(text)) <= e for s, e in zip(index.segment, index.edits.tolist(), strict=True)):
                want.add((doc, item[0]))
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    assert sum(r["doc_id"] == 0 for r in got) in (0, 2)


@pytest.mark.parametrize("bits", [(22, 27), (6, 9)])
def test_benchmark_of_many_parts(spark, monkeypatch, bits):
    """A long item in parts gives what its whole index gives, with a filter that lets most through as well;
    very long texts, repeated items and columns of clashing names included."""
    monkeypatch.setattr(decontaminate, "LEAST_BITS", bits[0])
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits[1])
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklm"), int(k))) for k in rng.integers(2, 9, n))
    items = [(1, prose(1500)), (2, prose(60)), (3, prose(12)), (2, prose(50))]
    long = items[0][1]
    rows = [(i, prose(40) + " " + long[at : at + 130] + " " + prose(40)) for i, at in enumerate(range(0, len(long) - 130, 331))]
    rows += [(90, prose(9000) + " " + items[1][1] + " " + prose(3000)), (91, items[2][1]), (92, long), (93, prose(500)), (94, ""), (95, None), (90, items[3][1].upper())]
    whole = decontaminate.build_index(items)
    want = sorted({(k, doc, item) for k, (doc, text) in enumerate(rows) if text for _, item, *_ in decontaminate.search(whole, [decontaminate.normalise(text)])})
    docs = spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], "doc_id long, text string, key string, part string, at int, `a.b` string")
    bench = spark.createDataFrame([*items, items[1]], "item_id long, text string")
    known = decontaminate.prepare(bench)
    assert known.texts.count() > 4
    got = decontaminate.matches(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((d, i) for _, d, i in want) and len(want) >= len(rows) - 3
    exact = {(doc, item): min(e for _, i, e, _ in decontaminate.search(whole, [decontaminate.normalise(text)]) if i == item) for doc, text in rows[:-7] for item in [1]}
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got if r["doc_id"] < 90} == exact
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [93, 94, 95]


def test_deduplication_keeps_columns_of_any_name(spark):
    df = clashing(docs(spark), "_id", "_digest", "digest", "label", "class_id", "row", "a.b")
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert all(r["_id"] == r["a.b"] == r["label"] == "mine" for r in kept.collect())
    assert minhash.deduplicate(df.limit(0)).count() == 0


def edited(rng, tag):
    """Two texts of 110 words; the second has 2 to 6 other words, or words put in or left out."""
    one = [f"w{x}" for x in rng.integers(0, 4000, 110)]
    two = list(one)
    for k in sorted(rng.choice(110, int(rng.integers(2, 7)), replace=False), reverse=True):
        put = [[f"z{tag}x{k}"]] * 8 + [[], [two[k], f"y{tag}x{k}"]]
        two[k : k + 1] = put[int(rng.integers(0, len(put)))]
    return one, two


def share_a_passage(one, two):
    """Whether stretches of equal length, 46 shingles or more, at any offset up to 6, are similar enough."""
    a, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (one, two))
    for d in range(-6, 7):
        for i in range(max(0, d), len(a)):
            for j in range(i + 46, min(len(a), len(b) + d) + 1):
                x, y = set(a[i:j]), set(b[i - d : j - d])
                if len(x & y) >= 0.8 * len(x | y):
                    return True
    return False


def test_passages_against_plain_search(spark):
    """The query on pairs of edited texts, against a search that shares no code with it."""
    rng = np.random.default_rng(3)
    pairs = [edited(rng, t) for t in range(120)]
    rows = [(2 * t + k, " ".join(w)) for t, p in enumerate(pairs) for k, w in enumerate(p)]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [t for t, p in enumerate(pairs) if share_a_passage(*p)]
    hit = [t for t in want if got.get(2 * t) is not None and got.get(2 * t) == got.get(2 * t + 1)]
    assert len(want) > 80 and len(hit) >= 0.95 * len(want), (len(hit), len(want))


def test_no_pair_with_a_passage_is_left_out():
    from graphloom.llm import passages as P

    rng = np.random.default_rng(5)
    found = 0
    for wide, trial in [(60, 0), (103, 0)] + [(103, t) for t in range(1, 60)]:
        base = rng.integers(0, 1 << 32, wide, np.uint32)
        if trial % 3 == 1:  # repeated shingles
            base = base[rng.integers(0, wide // 2, wide)]
        sets = [base]
        for _ in range(8):
            x = base.copy()
            hit = rng.random(wide) < rng.uniform(0, 0.25)
            x[hit] = rng.integers(0, 1 << 32, int(hit.sum()), np.uint32)
            cut_at = int(rng.integers(0, 12))
            sets.append(np.concatenate([x[cut_at:], x[: int(rng.integers(0, 5))]])[:wide])
        length = np.array([len(x) for x in sets])
        near = np.zeros((len(sets), wide), np.uint32)
        for r, x in enumerate(sets):
            near[r, : len(x)] = x
        single = P._single(sets, wide)
        for k in range(len(sets)):
            other = np.flatnonzero(np.arange(len(sets)) != k)
            may = P.may_share(near, length, single, k, other, P._index(sets[k]))
            for o, m in zip(other.tolist(), may.tolist(), strict=True):
                if P.passages_of(sets[o], sets[k], [0]):
                    found += 1
                    assert m
    assert found > 500


def test_scattered_common_places_are_not_looked_at(monkeypatch):
    """Pairs of a block with many common shingles, but in no run, cost no search on their diagonal."""
    from graphloom.llm import passages as P

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 32, 103, np.uint32)
    near = []
    for _ in range(20):
        x = rng.integers(0, 1 << 32, 103, np.uint32)
        x[::2] = base[::2]
        near.append(x.tobytes())
    looked, search = [], P.passages_of
    monkeypatch.setattr(P, "passages_of", lambda *a, **k: looked.append(1) or search(*a, **k))
    tid = [bytes([i]) * 16 for i in range(20)]
    assert P._links_of_block(tid, tid, np.zeros(20, int), [100] * 20, [True] * 20, [51] * 20, [46] * 20, near, True) == []
    assert not looked
