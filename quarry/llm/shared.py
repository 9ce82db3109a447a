"""What several operators share: tables in the cluster's shared folder, words
of an Arrow text column, gapless ranks and connected components."""

from __future__ import annotations

import math
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.shipping import ship

#: White space that separates words, as a class for Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
#: Edges up to which components() broadcasts its minima, a row for each end of an edge at most.
BROADCAST_EDGES = 100_000
#: Bytes of text that numpy code works on at once; a longer text is one block.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see, as a full
    URI: a path without a scheme lies in Spark's default file system.

    Where the setting is missing, a temporary folder is set for the session, but
    only on one machine: a cluster's executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path, store = _hadoop(spark, f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    _made.append(store.makeQualified(path).toString())
    return _made[-1]


def _hadoop(spark: SparkSession, uri: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cleanup(spark: SparkSession) -> int:
    """Removes every folder that shared_dir() made in this process, results read from
    them included; how many there were. For callers who have kept what they need."""
    n = len(_made)
    while _made:
        path, store = _hadoop(spark, _made.pop())
        store.delete(path, True)
    return n


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a
    lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Rows in an Arrow batch, so that a batch of long texts stays small; and the
    package for the workers."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of texts of about so many bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Modulus of word hashes, 2**61 - 1; words longer than LONG bytes are hashed one by one.
_MOD, LONG = np.uint64((1 << 61) - 1), 448
_LOW = np.uint64(0xFFFFFFFF)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)
#: Key of word hashes that must stay the same from run to run (a model's features).
FIXED_KEY = 0x1B873593CC9E2D51


def fresh_key() -> int:
    """A key for the word hashes of one run, which no author of a text can know."""
    return secrets.randbits(60) | 1 << 60


def _times(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """a * b modulo 2**61 - 1, for numbers below it."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW, b >> np.uint64(32), b & _LOW
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    total = (a1 * b1 << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (low & _MOD) + (low >> np.uint64(61))
    return _reduced(total)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _MOD) + (x >> np.uint64(61))
    return np.where(x >= _MOD, x - _MOD, x)


def _polynomial(values: np.ndarray, k: int) -> int:
    """The polynomial with these coefficients, the first one's power highest, at k."""
    p = int(_MOD)
    if len(values) <= 128:
        out = 0
        for x in values.tolist():
            out = (out * k + x) % p
        return out
    wide = math.isqrt(len(values))
    rows = np.concatenate([np.zeros(-len(values) % wide, np.uint64), values]).reshape(-1, wide)
    out = np.zeros(len(rows), np.uint64)
    for j in range(wide):
        out = _reduced(_times(out, np.uint64(k)) + rows[:, j])
    return _polynomial(out, pow(k, wide, p))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, key: int = FIXED_KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, length in bytes and number of the text of each word.

    A word is `[^\\x20\\x09-\\x0D]+`. lower: A-Z count as a-z. raw and offsets are
    those of one block. The hash is a polynomial over seven bytes at a time and the
    length, modulo 2**61 - 1, at the key: two different words of n bytes meet for at
    most n / 7 + 2 of the 2**60 keys, so under a key drawn for the run no text can be
    written to make words meet."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), none, none, none
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    before[at] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    after = before
    after[-1] = False
    after[:-1] = inside[1:]
    cut = offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= len(raw))] - 1
    after[cut] = False
    lengths = np.flatnonzero(inside & ~after) - starts + 1
    del inside, before, after
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5) if lower else raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the bytes from each place on
    k = np.uint64(key % int(_MOD))
    h = eight[starts] & _MASKS[np.minimum(lengths, 7)]
    todo = np.flatnonzero((lengths > 7) & (lengths <= LONG))
    done = 7
    while len(todo):
        h[todo] = _reduced(_times(h[todo], k) + (eight[starts[todo] + done] & _MASKS[np.minimum(lengths[todo] - done, 7)]))
        done += 7
        todo = todo[lengths[todo] > done]
    for i in np.flatnonzero(lengths > LONG).tolist():
        s, n = int(starts[i]), int(lengths[i])
        seven = np.zeros((-(-n // 7), 8), np.uint8)
        seven[:, :7] = np.append(padded[s : s + n], np.zeros(-n % 7, np.uint8)).reshape(-1, 7)
        h[i] = _polynomial(seven.view("<u8")[:, 0], int(k))
    h = _reduced(_times(h, k) + lengths.astype(np.uint64))
    return mix(h ^ np.uint64(key << 3 & (1 << 64) - 1)), starts, lengths, np.searchsorted(offsets, starts, side="right") - 1


def slices(raw: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """A long text in slices of about so many bytes, cut at white space (a longer word is one slice)."""
    i, n = 0, len(raw)
    while i < n:
        j = i
        while j < n:  # the last white space of the next so many bytes, or of those after them
            part = raw[j : j + most]
            white = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if j + len(part) == n:
                j = n
            elif len(white):
                j += int(white[-1]) + 1
                break
            else:
                j += len(part)
        yield raw[i:j]
        i = j


def shingle_sets(column: pa.Array, k: int, key: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z as a-z. A text
    longer than a block is hashed slice by slice; what is held are its bytes and
    some 40 bytes for each of its words."""
    raw, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        part = raw[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > BLOCK_BYTES:
            h = np.concatenate([words(x, np.array([0, len(x)]), True, key)[0] for x in slices(part)])
            yield from shingles(h, np.zeros(len(h), np.int64), 1, k)
        else:
            h, _, _, doc = words(part, offsets[i : j + 1] - offsets[i], True, key)
            yield from shingles(h, doc, j - i, k)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text of a block;
    with fewer words, the whole sequence is one; without words, none."""
    counts = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    ends = np.cumsum(counts)
    q = np.uint64(0xD6E8FEB86659FD93)
    out = []
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.uint64)
        if len(h) >= k:
            full = h[: len(h) - k + 1].copy()
            for i in range(1, k):
                full = full * q + h[i : len(h) - k + 1 + i]
            full = mix(full + np.uint64(k))
        for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
            s = e - c
            if c >= k:
                out.append(np.unique(full[s : e - k + 1]))
            elif c:
                x = h[s]
                for y in h[s + 1 : e]:
                    x = x * q + y
                out.append(mix(np.array([x + np.uint64(c)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def lowest(df: DataFrame, key: Column, rows: int, *ties: str) -> DataFrame:
    """The rows whose key, an evenly spread 64-bit hash, is lowest, `rows` of them.

    What is sorted is cut by the key first, to little more than `rows`, so that no
    task gets as many from each of very many others; that fewer pass is less
    likely than one in 10**20."""
    n = df.count()
    most = rows + 10 * math.sqrt(rows) + 100
    if n > 2 * most:
        df = df.where(key < F.lit(int(most / n * (1 << 64)) - (1 << 63)))
    return df.orderBy(key, *ties).limit(rows)


def gapless(df: DataFrame, part: str, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """Adds a gapless number from 0 within each value of `part`.

    One value may hold most rows: rows are numbered within buckets of a hash of
    `order`, and a table of counts, at most `buckets` rows a value, gives where
    each bucket begins."""
    b, own, begin = f"{name}_bucket", f"{name}_own", f"{name}_begin"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(part, b).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(part).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(part, b, F.coalesce(F.sum("c").over(w), F.lit(0)).alias(begin))
    own_w = Window.partitionBy(part, b).orderBy(*order)
    numbered = df.withColumn(own, F.row_number().over(own_w) - 1)
    joined = numbered.join(begins, [part, b])
    return joined.withColumn(name, (F.col(begin) + F.col(own)).cast("long")).drop(b, own, begin)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable number of every number in edges(a, b): (node, root).

    Alternates large-star and small-star steps, each a minimum by key and a join
    over the edges alone, and writes each round to the shared folder. Empty
    edges give no rows."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = e.count()  # no round makes more edges
    if not n:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A few minima are broadcast, so a number with very many edges lies in no one task. More are written, so that
    # the joins have a shuffle on either side, and adaptive execution splits such a number.
    few = n <= BROADCAST_EDGES
    kept = F.broadcast if few else (lambda df: written(df).hint("merge"))
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = large if few else written(large)
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = written(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(e.select("b", "b").distinct())
