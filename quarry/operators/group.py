"""Grouping by one field with one aggregate."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import NUMBER, rank_of_type
from quarry.operators.query import Query
from quarry.plans import dynamic

#: Names of the functions, by their numbers.
FUNCTIONS = ("count", "sum", "mean", "min", "max", "collect", "first", "last")


def function_name(fn: str | int) -> str:
    if isinstance(fn, bool) or not isinstance(fn, (int, str)):
        raise ValueError(f"unknown function {fn!r}")
    if isinstance(fn, int):
        if not 0 <= fn < len(FUNCTIONS):
            raise ValueError(f"unknown function {fn!r}")
        return FUNCTIONS[fn]
    if fn.lower() not in FUNCTIONS:
        raise ValueError(f"unknown function {fn!r}")
    return fn.lower()


@dataclass(frozen=True)
class GroupQuery:
    query: Query
    field: str
    sort_field: str | None = None
    sort_descending: bool = False
    limit_count: int = 0

    def sort(self, field: str, descending: bool = False) -> GroupQuery:
        """By a field of the result, ties by the group; descending turns both around."""
        return replace(self, sort_field=field, sort_descending=descending)

    def limit(self, n: int) -> GroupQuery:
        return replace(self, limit_count=n)

    def frame(self, fn: str | int, field: str | None = None) -> DataFrame:
        """Groups in order of their keys, or as sort() says: _id and a column named
        as the function. Partial aggregates run before the one shuffle."""
        name = function_name(fn)
        back = self.query.backend
        df = self.query.frame()
        value = back.value(field) if field is not None else F.lit(None).cast("int") if not back.dynamic else F.parse_json(F.lit("null"))
        rows = df.select(back.value(self.field).alias("rep"), value.alias("v"), self._position().alias("o"))
        if back.dynamic:
            rows = dynamic.with_key(rows, F.col("rep"), "g")
            rows = dynamic.with_key(rows, F.col("v"), "k") if name in ("min", "max") else rows.withColumn("k", F.lit(0))
            out = rows.groupBy("g").agg(F.min_by("rep", "o").alias("rep"), self._dynamic(name).alias(name)).select(F.col("rep").alias("_id"), name, "g")
        else:
            rows = rows.withColumn("g", F.col("rep"))
            out = rows.groupBy("g").agg(self._typed(name, back.kind(field) if field else T.NullType()).alias(name)).select(F.col("g").alias("_id"), name, "g")
        keys = [F.col("g")]
        if self.sort_field is not None and self.sort_field != "_id":
            key = F.lit(None).cast("int")
            if self.sort_field == name:
                key = dynamic.order_key(F.col(name), True) if isinstance(out.schema[name].dataType, T.VariantType) else F.col(name)
            keys = [key, *keys]
        down = self.sort_field is not None and self.sort_descending
        out = out.orderBy(*[k.desc_nulls_last() if down else k.asc_nulls_first() for k in keys]).drop("g")
        return out.limit(self.limit_count) if self.limit_count else out

    def agg(self, fn: str | int, field: str | None = None) -> list[dict]:
        df = self.frame(fn, field)
        if not self.query.backend.dynamic:
            return [r.asDict(recursive=True) for r in df.collect()]
        name = function_name(fn)
        rows = df.select(F.to_json("_id").alias("_id"), (F.to_json(name) if isinstance(df.schema[name].dataType, (T.VariantType, T.ArrayType)) else F.col(name)).alias("v")).collect()
        typed = isinstance(df.schema[name].dataType, (T.VariantType, T.ArrayType))
        return [{"_id": None if r[0] is None else json.loads(r[0]), name: (None if r[1] is None else json.loads(r[1])) if typed else r[1]} for r in rows]

    def _position(self) -> Column:
        """Where a document stands in the stream: a struct, so a null key keeps its row."""
        q = self.query
        if q.sort_field is None:
            return F.struct(q.backend.order())
        return F.struct(q.backend.sort_key(q.sort_field), q.backend.id())

    def _ends(self) -> tuple[Any, Any]:
        down = self.query.sort_field is not None and self.query.sort_descending
        return (F.max_by, F.min_by) if down else (F.min_by, F.max_by)

    def _in_order(self, v: Column) -> Column:
        down = self.query.sort_field is not None and self.query.sort_descending
        listed = F.collect_list(F.struct(F.col("o").alias("o"), v.alias("v")))
        if isinstance(self.query.backend.dynamic, bool) and self.query.backend.dynamic:
            listed = F.array_sort(listed, lambda a, b: F.when(a["o"] < b["o"], F.lit(-1)).when(a["o"] > b["o"], F.lit(1)).otherwise(F.lit(0)))
        else:
            listed = F.array_sort(listed)
        return F.transform(F.reverse(listed) if down else listed, lambda x: x["v"])

    def _typed(self, name: str, kind: T.DataType) -> Column:
        v = F.col("v")
        number = rank_of_type(kind) == NUMBER
        if name == "count":
            return F.count(F.lit(1))
        if name == "sum":
            if not number:
                return F.lit(0).cast("long")
            if isinstance(kind, T.IntegralType):
                # Exact in 128 bits; a sum beyond 64 bits fails rather than wraps.
                return F.coalesce(F.sum(v.cast("decimal(38,0)")), F.lit(0)).cast("long")
            return F.coalesce(F.sum(v.cast("double")), F.lit(0.0))
        if name == "mean":
            if not number:
                return F.lit(None).cast("double")
            if isinstance(kind, T.IntegralType):
                return F.try_divide(F.sum(v.cast("decimal(38,0)")).cast("double"), F.count(v))
            return F.avg(v.cast("double"))
        if name == "min":
            return F.min(v)
        if name == "max":
            return F.max(v)
        if name == "collect":
            return self._in_order(v)
        first, last = self._ends()
        return (first if name == "first" else last)(v, F.col("o"))

    def _dynamic(self, name: str) -> Column:
        v, k, o = F.col("v"), F.col("k"), F.col("o")
        first, last = self._ends()
        if name == "count":
            return F.count(F.lit(1))
        if name in ("sum", "mean"):
            number = dynamic.kind_rank(v) == NUMBER
            whole = number & (F.schema_of_variant(v) == "BIGINT")
            i = F.sum(F.when(whole, F.try_variant_get(v, "$", "bigint").cast("decimal(38,0)")))
            f = F.sum(F.when(number & ~whole, F.try_variant_get(v, "$", "double")))
            total = F.coalesce(f, F.lit(0.0)) + F.coalesce(i.cast("double"), F.lit(0.0))
            if name == "mean":
                return F.try_divide(total, F.count_if(F.coalesce(number, F.lit(False))))
            fits = F.coalesce(i, F.lit(0).cast("decimal(38,0)")).between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
            return F.when(f.isNull() & fits, F.coalesce(i, F.lit(0).cast("decimal(38,0)")).cast("bigint").cast("variant")).otherwise(total.cast("variant"))
        if name == "min":
            return F.min_by(v, F.when(v.isNotNull(), F.struct(k, o)))
        if name == "max":
            return F.max_by(v, F.when(v.isNotNull(), F.struct(k, o)))
        if name == "collect":
            return self._in_order(v)
        return (first if name == "first" else last)(v, o)
