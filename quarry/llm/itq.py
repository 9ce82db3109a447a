"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Fit. On at most SAMPLE vectors (the ones whose ids hash lowest; a documented
bound) principal axes are taken and a rotation is learned that brings the rotated
vectors close to the corners of a cube, so that their signs are balanced codes
of a bit per dimension.

Retrieve. A table takes some of the bits of a code as its key, and vectors that
agree in all of them share it. How many bits a pair at the cosine differs in
depends on the vectors (a common mean widens the angles once it is subtracted),
so it is measured: pairs at exactly the cosine are planted around vectors of the
sample that the rotation was not learned on, and tables are added until RECALL of other planted pairs share a key. Of the
lengths of a key the one is taken that costs least in keys and in vectors compared
(none at all for few rows, which are one list), with at most MOST_KEYS tables. Every row is indexed. A pair may share many keys, but counts in one of them: that of the
first table where it does.

Rerank. Pairs with codes at most FAR bits apart are compared by the cosine of
their original vectors in double precision. Short lists of a key are joined pair
by pair on codes; long lists are compared in blocks of about BLOCK vectors, dealt by hash, whose tasks
return counts and a spanning forest of the links, never the pairs. Equal vectors
are one class from the start. No list is cut.

Defined results: vectors that are null, zero or hold null or non-finite numbers
link with nothing; vectors of different lengths don't link, and each length has
codes and tables of its own; repeated rows are vectors of their own, which link
with each other; a null id is in no component's choice of a smallest id, and a
component of null ids alone has a null id; an empty table gives no rows. Labels
and other columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import components, lowest, mix, small_batches, written

COSINE = 0.95
SAMPLE = 20_000
ROUNDS = 50
RECALL = 0.95
#: Planted pairs of each way, and tables tried for each one chosen.
PLANTS, TRIES = 8_000, 16
#: Cost of a vector compared in a list, where a key costs 1.
COMPARED = 1 / 16
#: Tables at most, so keys a vector, however many rows and however wide the angles; shorter keys make up for it.
MOST_KEYS = 128
SHORT, BLOCK = 64, 512


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Codes:
    """Centre, axes and rotation; codes are signs of what they give."""

    def __init__(self, sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> None:
        x = sample / np.linalg.norm(sample, axis=1)[:, None]
        self.dim = x.shape[1]
        self.bits = min(64, self.dim)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        v = x @ axes
        r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        self.turn = axes @ r

    def of(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.linalg.norm(vectors, axis=1)[:, None] - self.mean
        signs = (x @ self.turn >= 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def planted(sample: np.ndarray, cosine: float, codes: Codes, seed: int, pairs: int = PLANTS) -> list[np.ndarray]:
    """Differing bits of the codes of pairs at the cosine: vectors of the sample and
    what lies from them in any direction, and in the direction of another one."""
    rng = np.random.default_rng(seed)
    u = sample[rng.integers(0, len(sample), pairs)]
    u = u / np.linalg.norm(u, axis=1)[:, None]
    out = []
    for to in (rng.normal(size=u.shape), sample[rng.integers(0, len(sample), pairs)]):
        to = to / np.linalg.norm(to, axis=1)[:, None]
        to = to - np.einsum("ij,ij->i", u, to)[:, None] * u
        long = np.linalg.norm(to, axis=1)
        ok = long > 1e-6  # no direction from a vector to itself
        if ok.any():
            out.append(codes.of(u[ok]) ^ codes.of(cosine * u[ok] + math.sqrt(1 - cosine * cosine) * to[ok] / long[ok][:, None]))
    return out or [np.zeros(1, np.uint64)]


class Tables:
    """Which bits of a code each table takes as its key.

    fit, held: differing bits of planted pairs, one array for each way of planting.
    Tables are chosen on the first and recall is measured on the second, in the
    worst of the ways. Without them bits flip independently, as for a mean of zero."""

    def __init__(self, bits: int, rows: int, cosine: float = COSINE, recall: float = RECALL, fit: list[np.ndarray] | None = None, held: list[np.ndarray] | None = None, seen: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(11)
        if fit is None or held is None:
            flipped = rng.random((2, PLANTS, bits)) < math.acos(cosine) / math.pi
            fit, held = ([x] for x in (flipped.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64))
        if seen is None:
            seen = (rng.random((SAMPLE, bits)) < 0.5).astype(np.uint64) << np.arange(bits, dtype=np.uint64)
            seen = seen.sum(axis=1, dtype=np.uint64)
        self.bits, self.cost, self.full = bits, math.inf, False
        for width in range(0, bits + 1, 2):
            if found := self._chosen(width, recall, fit, held, rng, seen, rows):
                self.parts, self.recall, self.cost = found
            elif self.cost <= len(self.parts) * 2 or self.full:
                break  # keys are the greater part of the cost, or as many as may be, and longer keys need more of them
        self.far = int(max(np.bitwise_count(x).max() for x in (*fit, *held)))

    def _chosen(self, width: int, recall: float, fit: list[np.ndarray], held: list[np.ndarray], rng: np.random.Generator, seen: np.ndarray, rows: int) -> tuple[list[int], float, float] | None:
        """Tables of so many bits, each the one of TRIES that finds most of the
        pairs not found so far, the recall measured with them and what they cost
        a vector: its keys, and the other vectors that `seen` codes let expect in
        their lists. None if that is not below the least cost so far, or MOST_KEYS are not enough."""
        cost = 0.0
        parts, missed, left = [], np.concatenate(fit), list(held)
        while True:
            if len(parts) == MOST_KEYS:
                self.full = True
                return None
            tried = np.argsort(rng.random((TRIES, self.bits)), axis=1)[:, :width].astype(np.uint64)
            tried = (np.uint64(1) << tried).sum(axis=1, dtype=np.uint64)
            part = tried[((missed[None, :] & tried[:, None]) == 0).sum(axis=1).argmax()]
            parts.append(int(part))
            met = np.unique(seen & part, return_counts=True)[1].astype(float)
            cost += 1 + COMPARED * rows * (met * (met - 1)).sum() / max(1, len(seen) * (len(seen) - 1))
            if cost >= self.cost:
                return None
            missed = missed[(missed & part) != 0]
            left = [x[(x & part) != 0] for x in left]
            found = min(1 - len(x) / len(h) for x, h in zip(left, held, strict=True))
            if found >= recall:
                return parts, found, cost

    def keys(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(table, mask of the bits it leaves out, key of each code) for every table."""
        for t, part in enumerate(self.parts):
            space = mix(np.array([part ^ (t << 40) ^ 0x51ED270B], np.uint64))[0]
            yield t, ((1 << self.bits) - 1) & ~part, mix((codes & np.uint64(part)) ^ space)

    def first(self, x: np.ndarray, table: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Whether the table is the first one whose key pairs with differing bits x
        share; the mask follows from the table."""
        good = np.ones(len(x), bool)
        for t, part in enumerate(self.parts):
            good &= ((x & np.uint64(part)) != 0) | (table <= t)
        return good


def fitted(sample: np.ndarray, rows: int, cosine: float) -> tuple[Codes, Tables]:
    """Codes learned on one half of the sample and tables for them by pairs around
    the other half, as codes of vectors that the rotation has seen flip less."""
    codes, rest = Codes(sample[::2]), sample[1::2] if len(sample) > 1 else sample
    return codes, Tables(codes.bits, rows, cosine, fit=planted(rest, cosine, codes, 1), held=planted(rest, cosine, codes, 2), seen=codes.of(sample))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(link), bool), []
    for s in range(len(link)):
        if not left[s]:
            continue
        left[s] = False
        todo = [s]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(link[at] & left)
            left[new] = False
            out += [(at, k) for k in new.tolist()]
            todo += new.tolist()
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, embedding: str = "embedding") -> DataFrame:
    """vectors(vec_id, embedding) to vec_id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col("e")
    finite = ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col(embedding).cast("array<double>").alias("e")).withColumn("fine", F.coalesce(finite, F.lit(False)))
    rows = written(rows.withColumn("e", F.when(F.col("fine"), e)).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    lengths = [r.d for r in rows.where("fine").select(F.size("e").alias("d")).distinct().orderBy("d").toLocalIterator()]  # a number for each model that made vectors
    parts = [_of_length(rows.where(F.col("fine") & (F.size("e") == d)), d, cosine, sample) for d in lengths]
    out = reduce(DataFrame.union, parts, rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_length(rows: DataFrame, dim: int, cosine: float, sample: int) -> DataFrame:
    """rows(vec_id, e, row), vectors of one length, to vec_id, n_links and component_id."""
    spark = rows.sparkSession
    # Equal vectors are a class: its number is the smallest row number, its name the smallest id.
    classes = written(rows.groupBy("e").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many")))
    n = classes.count()
    picked = lowest(classes, F.xxhash64("least", "id"), sample, "id").select("e").toArrow()  # at most `sample` vectors
    near = matrix(picked.column("e"), dim)
    codes, tables = fitted(near, n, cosine)
    codes = spark.sparkContext.broadcast(codes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                c = codes.value.of(matrix(part.column("e"), dim))
                for t, _, key in tables.keys(c):
                    k = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column("id"), pa.array(c.view(np.int64)), pa.array(np.full(k, t, np.int32))], ["key", "id", "code", "tab"])

    keys = classes.select("id", "e").mapInArrow(keyed, "key long, id long, code long, tab int")
    # Keys are counted map-side first and joined with their counts, a join that adaptive execution splits at a dense key.
    counted = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    listed = written(keys.join(counted.hint("merge"), "key"))
    short, long = listed.where(F.col("m") <= SHORT), listed.where(F.col("m") > SHORT)
    a, b = short.select("key", F.col("id").alias("a"), F.col("code").alias("ca")), short.select("key", F.col("id").alias("b"), F.col("code").alias("cb"), "tab")
    pairs = a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= tables.far)).select("a", "b", F.col("ca").bitwiseXOR(F.col("cb")).alias("x"), "tab")

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q in batches:
            x, t = (q.column(c).to_numpy() for c in ("x", "tab"))
            yield pa.RecordBatch.from_arrays([q.column("a"), q.column("b")], ["a", "b"]).filter(pa.array(tables.first(x.view(np.uint64), t)))

    once = pairs.mapInArrow(firsts, "a long, b long")
    side = lambda x: classes.select(F.col("id").alias(x), F.col("e").alias(f"e_{x}"), F.col("many").alias(f"m_{x}"))
    wide = once.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "e_a", "e_b", "m_a", "m_b")

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q in batches:
            good = cosines(matrix(q.column("e_a"), dim), matrix(q.column("e_b"), dim)) >= cosine
            yield pa.RecordBatch.from_arrays([q.column(c) for c in ("a", "b", "m_a", "m_b")], ["a", "b", "m_a", "m_b"]).filter(pa.array(good))

    links = written(wide.mapInArrow(reranked, "a long, b long, m_a long, m_b long"))
    counts = links.select(F.col("a").alias("id"), F.col("m_b").alias("n")).union(links.select("b", "m_a"))
    edges = links.select("a", "b")
    if not long.isEmpty():
        blocked = written(_blocks(long, classes, tables, dim, cosine))
        counts = counts.union(blocked.where("b is null").select(F.col("a").alias("id"), "n"))
        edges = edges.union(blocked.where("b is not null").select("a", "b"))
    degree = counts.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(edges).select(F.col("node").alias("id"), "root")
    known = classes.drop("e").join(degree.hint("merge"), "id", "left").join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = written(known)
    names = written(known.groupBy("root").agg(F.min("least").alias("name")))
    named = written(known.join(names.hint("merge"), "root").select("id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).cast("long").alias("n_links"), "name"))
    return rows.join(classes.select("e", "id").hint("merge"), "e").join(named.hint("merge"), "id").select("vec_id", "n_links", F.col("name").alias("component_id"))


def _blocks(listed: DataFrame, classes: DataFrame, tables: Tables, dim: int, cosine: float) -> DataFrame:
    """Links of long lists, a task for every two blocks of a list: (a, null, n), n
    vectors linked with a here, and (a, b, 0), edges that connect what is linked."""
    placed = listed.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "code", "tab")
    wide = sent.join(classes.select("id", "e", "many").hint("merge"), "id")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, ids, many = (t.column(c).to_numpy() for c in ("block", "id", "many"))
        code = t.column("code").to_numpy().view(np.uint64)
        tab = t.column("tab").to_numpy()
        v = matrix(t.column("e"), dim)
        v = v / np.linalg.norm(v, axis=1)[:, None]
        p, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = v[p] @ v[q].T >= cosine - 1e-9
        r, c = np.nonzero(near)
        ok = (ids[p[r]] < ids[q[c]]) if i == j else np.ones(len(r), bool)
        r, c = p[r[ok]], q[c[ok]]
        x = code[r] ^ code[c]
        ok = (np.bitwise_count(x) <= tables.far) & tables.first(x, tab[r])
        r, c = r[ok], c[ok]
        ok = cosines(v[r], v[c]) >= cosine
        r, c = r[ok], c[ok]
        n = np.bincount(r, weights=many[c], minlength=len(ids)) + np.bincount(c, weights=many[r], minlength=len(ids))
        link = np.zeros((len(ids), len(ids)), bool)
        link[r, c] = link[c, r] = True
        tree = np.array(forest(link), np.int64).reshape(-1, 2)
        has = np.flatnonzero(n)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[has], ids[tree[:, 0]]])),
                "b": pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[tree[:, 1]], pa.int64())]),
                "n": pa.array(np.concatenate([n[has].astype(np.int64), np.zeros(len(tree), np.int64)])),
            }
        )

    return wide.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, n long")
