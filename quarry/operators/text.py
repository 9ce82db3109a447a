"""Full-text search: BM25 over stems, from a written table of postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stemmer import stem, tokens
from quarry.operators.vector import best_of_each
from quarry.storage import spread, written

K1, B = 1.2, 0.75
#: Tasks over which the postings of a stem that very many documents have are spread.
SALTS = 16
#: Texts that a worker counts at a time.
TEXTS = 256


def field_texts(backend: Any, field: str) -> Column:
    """A string, or the strings of an array, as an array; NULL where the field is neither."""
    v = backend.value(field)
    if backend.dynamic:
        from quarry.functions.values import ARRAY, STRING
        from quarry.plans.dynamic import kind_rank

        text = lambda e: F.try_variant_get(e, "$", "string")
        items = F.try_variant_get(F.when(kind_rank(v) == ARRAY, v), "$", "array<variant>")
        many = F.when(F.forall(items, lambda e: F.coalesce(kind_rank(e) == STRING, F.lit(False))), F.transform(items, text))
        return F.when(kind_rank(v) == STRING, F.array(text(v))).otherwise(many)
    kind = backend.kind(field)
    if isinstance(kind, T.StringType):
        return F.when(v.isNotNull(), F.array(v))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.when(F.forall(v, lambda e: e.isNotNull()), v)
    return F.lit(None).cast("array<string>")


def query_stems(query: str) -> list[str]:
    return sorted({stem(t) for t in tokens(query)})


def postings(df: DataFrame, backend: Any, field: str) -> DataFrame:
    """(_id, stem, tf, dl): how often each document has each stem, and its number of
    tokens; one row more for each document has no stem. A document's tokens are
    counted where it is read; nothing is shuffled."""
    texts = df.select(backend.id().alias("_id"), field_texts(backend, field).alias("texts")).where("texts is not null")
    kind = texts.schema["_id"].dataType

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, TEXTS):
                part = b.slice(s, TEXTS)
                who, stems, tf, dl = [], [], [], []
                for k, own in enumerate(part.column("texts").to_pylist()):
                    found = Counter(t for text in own for t in tokens(text))
                    by_stem: Counter[str] = Counter()
                    for t, n in found.items():
                        by_stem[stem(t)] += n
                    who += [k] * (len(by_stem) + 1)
                    stems += [None, *by_stem]
                    tf += [0, *by_stem.values()]
                    dl += [found.total()] * (len(by_stem) + 1)
                yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(who, pa.int64())), pa.array(stems, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["_id", "stem", "tf", "dl"])

    schema = T.StructType([T.StructField("_id", kind), T.StructField("stem", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())])
    return spread(texts).mapInArrow(counted, schema)


class TextIndex:
    """Postings of one snapshot, sorted by stem in each file, so that a query's stems
    are read and the others skipped; with the number of documents and their mean length."""

    def __init__(self, df: DataFrame, backend: Any, field: str) -> None:
        rows = postings(df, backend, field)
        dealt = rows.repartition(F.col("stem"), F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
        self.postings = written(dealt.sortWithinPartitions("stem", "_id"))
        self.n, total = self.postings.where("stem is null").agg(F.count(F.lit(1)), F.sum("dl")).first()
        self.mean = (total or 0) / self.n if self.n else 0.0

    def scored(self, query: str) -> DataFrame:
        """(_id, score) of the documents with a score above 0. A stem's number of
        documents is a row of a table with a row for each query stem at most; parts
        are added in order of stems."""
        wanted = query_stems(query)
        if not wanted or not self.n:
            return self.postings.select("_id", F.lit(0.0).alias("score")).where(F.lit(False))
        hits = self.postings.where(F.col("stem").isin(wanted))
        df = hits.groupBy("stem").agg(F.count(F.lit(1)).cast("double").alias("df"))
        idf = df.select("stem", F.log(F.lit(1.0) + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        tf = F.col("tf").cast("double")
        part = F.col("idf") * (tf * (K1 + 1.0)) / (tf + K1 * ((1.0 - B) + B * F.col("dl") / F.lit(float(self.mean))))
        parts = hits.join(F.broadcast(idf), "stem").select("_id", F.struct("stem", part.alias("part")).alias("p"))
        summed = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(0.0), lambda s, x: s + x["part"])
        return parts.groupBy("_id").agg(summed.alias("score")).where("score > 0")

    def scored_many(self, queries: list[str], limit: int) -> DataFrame:
        """(query, _id, score): the best documents of each query by its number, ties by
        id. The postings of all queries' stems are read once; what is broadcast is a row
        for each query's stem."""
        spark = self.postings.sparkSession
        asked = [(k, s) for k, q in enumerate(queries) for s in query_stems(q)]
        plan = spark.createDataFrame(asked, "query int, stem string")
        hits = self.postings.where(F.col("stem").isin(sorted({s for _, s in asked})))
        df = hits.groupBy("stem").agg(F.count(F.lit(1)).cast("double").alias("df"))
        idf = df.select("stem", F.log(F.lit(1.0) + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        tf = F.col("tf").cast("double")
        part = F.col("idf") * (tf * (K1 + 1.0)) / (tf + K1 * ((1.0 - B) + B * F.col("dl") / F.lit(float(self.mean))))
        parts = hits.join(F.broadcast(idf.join(F.broadcast(plan), "stem")), "stem").select("query", "_id", F.struct("stem", part.alias("part")).alias("p"))
        summed = F.aggregate(F.array_sort(F.collect_list("p")), F.lit(0.0), lambda s, x: s + x["part"])
        return best_of_each(parts.groupBy("query", "_id").agg(summed.alias("score")).where("score > 0"), limit)
