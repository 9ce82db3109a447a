"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import parity_join as pj
from quarry.llm import shared
from quarry.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t))
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                        n = len(x & y)
                        if n and 100 * n >= 75 * (len(x) + len(y) - n):
                            p, q = find(a), find(b)
                            root[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d in ids for s in sets[d])


def corpus(seed, n=220, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = " ".join(word() for _ in range(60))
    rows, bases = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 or not bases:
            base = [word() for _ in range(rng.choice([3, 5, 8, 20, 60, 150, 400]))]
            bases.append(base)
            text = base
        elif kind < 0.8:
            text = list(rng.choice(bases))
            for _ in range(max(1, int(len(text) * rng.choice([0, 0.01, 0.02, 0.03, 0.05])))):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
        else:
            text = passage.split() + [word() for _ in range(rng.choice([2, 10, 40, 100]))]
        rows.append((i * 3, " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One\ttwo"), (9005, "x " * 4000), (9006, "x " * 5000), (3, "again other words entirely here now"), (0, corpus(seed)[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in pj.near_duplicates(df).collect())
    assert got == brute(rows)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pj, "SHORT", 4)
    monkeypatch.setattr(pj, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = [(1000 + i, " ".join(base[:60] + [f"r{rng.randrange(10**6)}" for _ in range(20)])) for i in range(120)]
    rows += [(i, " ".join(base[:40] + [f"s{i % 9}_{k}" for k in range(40)] + [f"z{i}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in pj.near_duplicates(df).collect())
    assert got == brute(rows)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(0)
    frequent = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        if rng.random() < 0.5:
            x = np.unique(np.append(x, rng.choice(frequent, min(n, 300), replace=False)))
        cut = int(rng.integers(0, len(x) // 3 + 1))
        y = np.unique(np.append(rng.permutation(x)[: len(x) - cut], rng.integers(0, 2**63, int(rng.integers(0, cut + 2))).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < 75 * (len(x) + len(y) - both) or both == len(x) == len(y):  # equal sets are a class
            continue
        assert len(np.intersect1d(pj.keys(x, frequent)[0], pj.keys(y, frequent)[0])) >= pj.SHARED
        assert pj.may_link(len(x), len(y), pj.sketch(x), pj.sketch(y))
        assert pj.distance(pj.sketch(x), pj.sketch(y)) <= len(x) + len(y) - 2 * both


def morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate({97: 98, 98: 97})
    return a


def test_words_that_a_plain_polynomial_takes_for_equal(spark):
    x = morse(2048)
    y = x.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, x), (2, y), (3, x), (4, x + "\0"), (5, "w" * 448), (6, "w" * 449), (7, "w" * 449)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in pj.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (1, 6)}


def test_hashes_are_equal_where_words_are():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abAB\0é") for _ in range(rng.choice([1, 2, 6, 7, 8, 13, 14, 15, 100, 447, 448, 449, 450, 3000]))) for _ in range(40)) for _ in range(60)] + [None, "", "\t\n", "a", "A"]
    raw, at = shared.text_bytes(pa.array(texts))
    seen = {}
    for lower in (False, True):
        h, starts, lengths, doc = shared.words(raw, at, lower, shared.fresh_key())
        own = [bytes(raw[s : s + n]) for s, n in zip(starts, lengths, strict=True)]
        want = [(k, w.encode()) for k, t in enumerate(texts) for w in WORD.findall(t or "")]
        assert list(zip(doc.tolist(), own, strict=True)) == want
        seen = dict(zip((w.lower() if lower else w for w in own), h.tolist(), strict=True))
        assert all(seen[w.lower() if lower else w] == x for w, x in zip(own, h.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("most", [5, 64, 1000])
def test_slices_have_the_words_of_the_whole(monkeypatch, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("ab \n") for _ in range(3000)), "x" * 3000, " " * 300 + "y" * 2000 + " z", "a b"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    assert all(b"".join(bytes(x) for x in shared.slices(r, most)) == bytes(r) for r in raw)
    whole = [s.tolist() for s in shared.shingle_sets(pa.array(texts), 5, 7)]
    monkeypatch.setattr(shared, "BLOCK_BYTES", most)
    monkeypatch.setattr(shared.slices, "__defaults__", (most,))
    monkeypatch.setattr(shared.blocks, "__defaults__", (most,))
    assert [s.tolist() for s in shared.shingle_sets(pa.array(texts), 5, 7)] == whole


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(pj, "ASKED", 2)
    monkeypatch.setattr(pj, "HOT_SEEN", 3)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"c{i}"] + base[k + 1 :])) for i in range(150) for k in [rng.randrange(100)]] + [(500 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(20)]
    join = pj.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(join.hot) > 10
    salts = pj.emitted(join.docs, join.frequent, join.hot, 75, join.key).groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.count_distinct("salt").alias("s")).where("n > 40").agg(F.min("s")).first()[0]
    assert salts > 1
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in join.documents().collect()) == brute(rows)


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_of_a_hub_and_chains(spark, monkeypatch, few):
    monkeypatch.setattr(shared, "BROADCAST_EDGES", few)
    edges = [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(0, 60)] + [(1399, 700), (5, 5)]
    got = dict(tuple(r) for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {700: 700} | {i: 700 for i in range(1000, 1400)} | {i: 0 for i in range(61)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folders_are_full_paths_and_are_removed(spark):
    where = shared.shared_dir(spark)
    assert where.startswith("file:/")
    kept = shared.written(spark.range(3))
    assert kept.count() == 3 and shared.cleanup(spark) >= 2 and shared.cleanup(spark) == 0


def test_lowest_is_what_sorting_gives(spark):
    df = spark.range(20_000)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    got = shared.lowest(df, F.xxhash64("id"), 50, "id")
    assert [r.id for r in got.collect()] == want and shared.lowest(df.limit(0), F.xxhash64("id"), 5, "id").count() == 0


def test_ids_of_a_narrower_type(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(4)] + [(9, "alone here")]
    got = pj.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows) and brute(rows)[3][2] == 0


def test_empty_table(spark):
    assert pj.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op6_parity_join"](spark, sf).collect())
    assert got == brute(rows)
