"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

A text is a bag of hashed n-grams: its words and word pairs, and the same of the
words' shapes (which kinds of characters a word holds), besides a mark where a
word repeats the one before. The features are their shares of the bag, so the
score is a sparse dot product: the mean weight of the n-grams, scaled, through
the logistic function. Texts are hashed whole, in numpy, straight from the Arrow
buffers.

Training reads at most TRAIN_ROWS labelled documents (the ones whose ids hash
lowest; the bound is a parameter; of rows with one id the smallest text), never those held out (crc32 of the id's
decimal text mod 5 is 0), in one streaming pass per epoch over one task that
keeps only the model: 2**BITS weights, of a fixed size, which are broadcast.

Defined results: null and empty texts get the score of the intercept; repeated
rows are scored alike; a document with several labels counts as good only if all
say so; null labels are none; without any labelled document all scores are 0.5;
an empty table gives no rows. A null id is not held out and not trained on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarry.llm.shared import blocks, lowest, mix, small_batches, text_bytes, words

BITS = 18
TRAIN_ROWS = 8000
EPOCHS = 2
SCALE = 40.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
THRESHOLD = 0.3

#: A bit for each kind of character: lower-case, upper-case, digit, beyond ASCII, then single symbols and the other ones.
_KIND = np.full(256, 1 << 15, np.uint16)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[128:] = 8
for _i, _c in enumerate("!|%$#*&<>.,"):
    _KIND[ord(_c)] = 1 << (4 + _i)


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each n-gram of a block of texts, and the text it is of."""
    h, starts, lengths, doc = words(raw, offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where((raw == 32) | ((raw >= 9) & (raw <= 13)), np.uint16(0), _KIND[raw])
    shape = np.bitwise_or.reduceat(kind, starts).astype(np.uint64)
    one = np.uint64(0x9E3779B97F4A7C15)
    pair = doc[1:] == doc[:-1]
    d2 = doc[1:][pair]
    with np.errstate(over="ignore"):
        w2 = (h[:-1] * one + h[1:])[pair]
        s2 = (shape[:-1] * np.uint64(65536) + shape[1:] + np.uint64(1 << 40))[pair]
    same = (h[1:] == h[:-1])[pair]
    marks = np.where(same, np.uint64(1 << 41), np.uint64(1 << 42))
    mask = np.uint64((1 << BITS) - 1)
    parts = [mix(x) & mask for x in (h, w2, shape + np.uint64(1 << 39), s2, marks)]
    return np.concatenate(parts).astype(np.int64), np.concatenate([doc, d2, doc, d2, d2])


class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader updates."""

    def __init__(self, bits: int = BITS) -> None:
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> float:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[i] = n + g * g
        return float(p)


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: distinct indexes (the intercept's is 2**BITS) and values."""
    raw, offsets = text_bytes(texts)
    for i, j in blocks(offsets):
        part = raw[offsets[i] : offsets[j]]
        idx, doc = grams(part, offsets[i : j + 1] - offsets[i])
        order = np.argsort(doc, kind="stable")
        idx, ends = idx[order], np.searchsorted(doc[order], np.arange(j - i + 1))
        for k in range(j - i):
            own, n = np.unique(idx[ends[k] : ends[k + 1]], return_counts=True)
            yield np.append(own, 1 << BITS), np.append(SCALE * n / max(1, n.sum()), 1.0)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for b in batches:
        for (i, x), y in zip(_bags(b.column("text")), b.column("good").to_pylist(), strict=True):
            model.learn(i, x, int(y))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of a model for labels(doc_id, quality) of docs(doc_id, text), the intercept last."""
    small_batches(docs.sparkSession)
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    key = F.xxhash64("doc_id")
    chosen = lowest(marked, key, rows, "doc_id")  # at most `rows` ids
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    passes = sample.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(EPOCHS)])))
    # One task: EPOCHS * rows documents at most, in an order that depends on their ids alone.
    ordered = passes.repartition(1).sortWithinPartitions("epoch", key, "doc_id", "text").select("text", "good")
    got = ordered.mapInArrow(_train, "weights binary").collect()
    if not got:
        return np.zeros((1 << BITS) + 1)
    return np.frombuffer(got[0].weights, "<f4").astype(np.float64)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; the other columns stay in the JVM."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of a fixed size

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w = model.value.astype(np.float64)
        raw, offsets = text_bytes(texts)
        out = np.zeros(len(offsets) - 1)
        for i, j in blocks(offsets):
            idx, doc = grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total = np.bincount(doc, weights=w[idx], minlength=j - i)
            out[i:j] = SCALE * total / np.maximum(1, np.bincount(doc, minlength=j - i))
        return pa.array(1 / (1 + np.exp(-np.clip(out + w[-1], -35, 35))))

    return docs.withColumn(name, scored(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted (1: good, from the threshold on)."""
    scored = score(docs, train(docs, labels))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
