"""Shards against a plain heap, and the classifier on held-out documents."""

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import classifier, sharding
from quarry.llm.queries import QUERIES
from quarry.llm.shared import FIXED_KEY


def heap_loads(sizes, shards):
    heap = [(0, j) for j in range(shards)]
    for s in sorted(sizes, reverse=True):
        load, j = heapq.heappop(heap)
        heapq.heappush(heap, (load + s, j))
    return sorted(x for x, _ in heap)


def test_deal_is_what_a_heap_does():
    rng = np.random.default_rng(0)
    for _ in range(200):
        classes = sorted({int(x) for x in rng.integers(1, 500, rng.integers(1, 20))}, reverse=True)
        counts = [int(x) for x in rng.integers(1, 200, len(classes))]
        dealt = sharding.deal(list(zip(classes, counts, strict=True)), 8)
        assert [sum(x) for x in dealt] == counts
        loads = sorted(sum(s * d[j] for s, d in zip(classes, dealt, strict=True)) for j in range(8))
        assert loads == heap_loads([s for s, c in zip(classes, counts, strict=True) for _ in range(c)], 8)


def test_shards(spark, sf):
    hot = [(i, "same text" * 3, "x") for i in range(200)]
    rows = hot + [(1000 + i, "t" * (i % 700) + str(i), "x") for i in range(400)] + [(7, None, "x"), (8, "", "x"), (8, "", "x"), (None, "z", "x")]
    small = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for docs in (small, spark.read.parquet(f"{sf}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        got = sharding.shard(docs, 8).collect()
        assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(d), len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts)
        home, loads, slots, groups = {}, [0] * 8, {}, {}
        for d, t in texts:
            groups[t] = groups.get(t, 0) + len(t.encode()) + 1
        for r in got:
            loads[r.shard] += r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
            assert home.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        want = heap_loads(groups.values(), 8)
        assert max(loads) <= want[-1] * 1.01 and min(loads) >= want[0] * 0.99
    assert sharding.shard(small.limit(0), 8).count() == 0
    assert sharding.shard(small.where("doc_id < 200"), 8).select("shard").distinct().count() <= 3


def test_ftrl_learns_and_stays_sparse():
    m = classifier.Ftrl(10)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        y = int(rng.random() < 0.5)
        m.learn(np.array([y, 5, 1024]), np.array([1.0, 0.1, 1.0]), y)
    w = m.weights(slice(None))
    assert w[1] > 1 and w[0] < -1 and np.count_nonzero(w) <= 4


def test_grams_don_t_depend_on_blocks():
    texts = ["a b c A! 5", "", None, "é é é", "x"] * 3
    raw, off = classifier.text_bytes(pa.array(texts))
    idx, doc = classifier.grams(raw, off)
    for k, t in enumerate(texts):
        one, _ = classifier.grams(*classifier.text_bytes(pa.array([t])))
        assert sorted(idx[doc == k].tolist()) == sorted(one.tolist())


def test_classifier(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = QUERIES["op2_quality_classifier"](spark, d)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(r.predicted for r in held if r.quality == 1)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (4, "a b " * 50000, "x"), (4, "a b " * 50000, "x")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs.select("doc_id", "text"), labels)
    assert [round(r.score, 6) for r in got.collect()] == [0.5] * 5
    assert classifier.classify(docs.limit(0).select("doc_id", "text"), labels).count() == 0
    assert got.agg(F.count_if("held_out")).first()[0] <= 3


M64, P61 = (1 << 64) - 1, (1 << 61) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_hash(word):
    h = 0
    for i in range(0, len(word), 7):
        h = (h * (FIXED_KEY % P61) + int.from_bytes(word[i : i + 7], "little")) % P61
    return plain_mix((h * (FIXED_KEY % P61) + len(word)) % P61 ^ FIXED_KEY << 3 & M64)


def plain_bag(text):
    """n-gram indexes of a text, with words, shapes and marks as the module's docstring says."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    shape = []
    for w in words:
        bits = 0
        for c in w:
            if chr(c) in "!|%$#*&<>.,":
                bits |= 1 << 4 + "!|%$#*&<>.,".index(chr(c))
            else:
                bits |= 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 8 if c >= 128 else 1 << 15
        shape.append(bits)
    h = [plain_hash(w) for w in words]
    raw = h + [s + (1 << 39) for s in shape]
    for i in range(len(words) - 1):
        raw += [h[i] * 0x9E3779B97F4A7C15 + h[i + 1] & M64, shape[i] * 65536 + shape[i + 1] + (1 << 40), 1 << 41 if h[i] == h[i + 1] else 1 << 42]
    return [plain_mix(x) & (1 << classifier.BITS) - 1 for x in raw]


def test_scores_are_those_of_plain_ftrl(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["good", "plain", "Word", "x1", "###", "a,b", "é" * 9, "longer-word-of-many-bytes"]
    rows = [(i, None if i == 7 else "" if i == 8 else " ".join(rng.choice(vocabulary[: 4 + 4 * (i % 2)], rng.integers(1, 30)))) for i in range(60)] + [(3, "an id again"), (None, "no id")]
    labels = [(i, i % 2, 0) for i in range(50)] + [(51, None, 0), (4, 1, 0), (4, 0, 0)]
    good = {}
    for i, q, _ in labels:
        if q is not None and zlib.crc32(str(i).encode()) % 5:
            good[i] = min(good.get(i, 1), q)
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in good], "i long").withColumn("h", F.xxhash64("i")).collect()}
    texts = {}
    for i, t in rows:
        if i in good and (i not in texts or t is not None and (texts[i] is None or t < texts[i])):
            texts[i] = t
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= classifier.L1 else -(z[k] - np.sign(z[k]) * classifier.L1) / ((classifier.BETA + n[k] ** 0.5) / classifier.ALPHA + classifier.L2)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for _ in range(classifier.EPOCHS):
        for i in sorted(texts, key=lambda i: order[i]):
            bag = plain_bag(texts[i])
            x = {k: classifier.SCALE * bag.count(k) / len(bag) for k in set(bag)} | {-1: 1.0}
            w = {k: weight(k) for k in x}
            p = logistic(sum(w[k] * v for k, v in x.items()))
            for k, v in x.items():
                g, old = (p - good[i]) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / classifier.ALPHA * w[k]
                n[k] = old + g * g
    want = []
    for i, t in rows:
        bag = plain_bag(t)
        want.append((str(i), t or "", logistic(sum(weight(k) for k in bag) * classifier.SCALE / max(1, len(bag)) + weight(-1))))
    got = classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for (i, t, s), r in zip(sorted(want), sorted(got, key=lambda r: (str(r.doc_id), r.text or "")), strict=True):
        assert (str(r.doc_id), r.text or "") == (i, t) and abs(r.score - s) < 1e-5 and r.predicted == int(r.score >= 0.3)
