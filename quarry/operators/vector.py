"""Brute-force cosine search, in single precision, over a written table of unit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarry.functions.values import NUMBER, rank_of_type
from quarry.storage import written


def as_vector(backend: Any, field: str, dim: int) -> Column:
    """The field as array<float> where it is exactly dim numbers, else NULL."""
    if backend.dynamic:
        from quarry.plans.dynamic import kind_rank

        items = F.try_variant_get(backend.value(field), "$", "array<variant>")
        good = (F.size(items) == dim) & F.forall(items, lambda e: F.coalesce(kind_rank(e) == NUMBER, F.lit(False)))
        return F.when(F.coalesce(good, F.lit(False)), F.transform(items, lambda e: F.try_variant_get(e, "$", "double").cast("float")))
    kind = backend.kind(field)
    if not isinstance(kind, T.ArrayType) or rank_of_type(kind.elementType) != NUMBER:
        return F.lit(None).cast("array<float>")
    v = backend.value(field)
    good = (F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull())
    return F.when(F.coalesce(good, F.lit(False)), v.cast("array<float>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    norm = F.sqrt(_sum(F.transform(v, lambda x: (x * x).cast("float")))).cast("float")
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def unit_vectors(df: DataFrame, backend: Any, field: str, dim: int) -> DataFrame:
    """(_id, unit) of the documents with a valid vector: what an index keeps."""
    return df.select(backend.id().alias("_id"), as_vector(backend, field, dim).alias("v")).where("v is not null").select("_id", unit(F.col("v")).alias("unit"))


def unit_query(query: list[float]) -> list[float]:
    q = np.asarray(query, np.float32)
    norm = np.float32(0)
    for x in q:
        norm = np.float32(norm + x * x)
    norm = np.sqrt(norm)
    return [float(x) for x in (q if norm == 0 else q / norm)]


class VectorIndex:
    """Unit vectors of one snapshot."""

    def __init__(self, df: DataFrame, backend: Any, field: str, dim: int) -> None:
        self.dim = dim
        self.units = written(unit_vectors(df, backend, field, dim))

    def scored(self, query: list[float]) -> DataFrame:
        """(_id, score) of every vector; none for a query of another length. Vectors are
        multiplied a batch at a time, as a matrix."""
        if len(query) != self.dim:
            return self.units.select("_id", F.lit(0.0).cast("float").alias("score")).where(F.lit(False))
        q, dim = np.array(unit_query(query), np.float32), self.dim

        @arrow_udf("float")
        def cosine(column: pa.Array) -> pa.Array:
            return pa.array(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) @ q, pa.float32())

        return self.units.select("_id", cosine("unit").alias("score"))


    def scored_many(self, queries: list[list[float]], limit: int) -> DataFrame:
        """(query, _id, score): the best vectors of each query by its number, ties by id.
        Each batch is multiplied with all queries at once and keeps its best ones."""
        good = [k for k, q in enumerate(queries) if len(q) == self.dim]
        q = np.array([unit_query(queries[k]) for k in good], np.float32).reshape(-1, self.dim)
        kind, dim = self.units.schema["_id"].dataType, self.dim

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                scores = b.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) @ q.T
                rows, which = np.nonzero(scores >= (np.partition(scores, -limit, axis=0)[-limit] if len(scores) > limit else -np.inf))  # ties stay
                yield pa.RecordBatch.from_arrays([pa.array(np.array(good, np.int32)[which]), b.column("_id").take(pa.array(rows)), pa.array(scores[rows, which])], ["query", "_id", "score"])

        schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("_id", kind), T.StructField("score", T.FloatType())])
        return best_of_each(self.units.mapInArrow(best, schema), limit)


def best_of_each(scores: DataFrame, limit: int) -> DataFrame:
    """The best `limit` rows of each query of (query, _id, score), ties by id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("_id")))
    return scores.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def top(scores: DataFrame, limit: int) -> DataFrame:
    """Best scores first, ties by id; limit 0 is all. A limit is a bounded heap per task."""
    df = scores.orderBy(F.desc("score"), F.asc("_id"))
    return df.limit(limit) if limit else df
