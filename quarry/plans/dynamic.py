"""Filters over schemaless documents held as VARIANT.

A field's kind is read once per comparison and values compare by an order key,
struct(rank, n, r, s, c): scalars need no Python; c, the key of an array or an
object, is only computed where one is compared as a whole."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.keys import container_key
from quarry.functions.values import ARRAY, BOOL, NULL, NUMBER, OBJECT, STRING, number_literal, order_bytes, rank
from quarry.plans.filters import Pred, column
from quarry.plans.plain import compares_containers, elements_match

KEY = "struct<k:int,n:double,r:bigint,s:string,c:binary>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once: filters have no other common parts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rank_of_schema(s: Column) -> Column:
    return (
        F.when(s == "BIGINT", F.lit(NUMBER)).when(s == "STRING", F.lit(STRING)).when(s == "VOID", F.lit(NULL)).when(s == "BOOLEAN", F.lit(BOOL))
        .when(s.startswith("ARRAY"), F.lit(ARRAY)).when(s.startswith("OBJECT"), F.lit(OBJECT)).otherwise(F.lit(NUMBER))
    )


def kind_rank(v: Column) -> Column:
    """Rank of a variant's value; NULL where it is missing."""
    return let(F.schema_of_variant(v), lambda s: F.when(s.isNotNull(), rank_of_schema(s)))


def _scalar_key(v: Column, s: Column) -> Column:
    """Order key of a value that is there, from its schema; without its container key."""
    k = rank_of_schema(s)
    i = F.try_variant_get(v, "$", "bigint")
    n = (
        F.when(s == "BIGINT", i.cast("double")).when(s == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(k == NUMBER, F.try_variant_get(v, "$", "double") + F.lit(0.0)).otherwise(F.lit(0.0))
    )
    r = F.when(s == "BIGINT", let(i, lambda i: F.when(i.cast("double") >= F.lit(2.0**63), i - F.lit((1 << 63) - 1) - 1).otherwise(i - i.cast("double").cast("long")))).otherwise(F.lit(0).cast("long"))
    text = F.when(s == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.lit(""))
    return F.struct(k.alias("k"), F.coalesce(n, F.lit(0.0)).alias("n"), F.coalesce(r, F.lit(0).cast("long")).alias("r"), F.coalesce(text, F.lit("")).alias("s"), F.lit(b"").cast("binary").alias("c"))


def order_key(v: Column, containers: bool) -> Column:
    """Order key of a variant; a missing one orders as null. containers: with keys of arrays and objects."""
    null = F.struct(F.lit(NULL).alias("k"), F.lit(0.0).alias("n"), F.lit(0).cast("long").alias("r"), F.lit("").alias("s"), F.lit(b"").cast("binary").alias("c"))
    key = let(v, lambda x: let(F.schema_of_variant(x), lambda s: F.when(s.isNotNull(), _scalar_key(x, s)).otherwise(null)))
    if not containers:
        return key
    c = container_key(F.when(F.coalesce(kind_rank(v), F.lit(NULL)) >= ARRAY, F.to_json(v)))
    return key.withField("c", F.coalesce(c, F.lit(b"").cast("binary")))


def with_key(df: DataFrame, v: Column, name: str) -> DataFrame:
    """df with the order key of a variant. Only rows with an array or an object there go
    through Python, and they alone."""
    large = F.coalesce(kind_rank(v), F.lit(NULL)) >= ARRAY
    return df.where(~large).withColumn(name, order_key(v, False)).unionByName(df.where(large).withColumn(name, order_key(v, True)))


def literal_key(value: Any) -> Column:
    k = rank(value)
    n, r = number_literal(value) if k == NUMBER else (float(value) if k == BOOL else 0.0, 0)
    c = order_bytes(value) if k in (ARRAY, OBJECT) else b""
    return F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(r).cast("long").alias("r"), F.lit(value if k == STRING else "").alias("s"), F.lit(bytearray(c)).cast("binary").alias("c"))


class Variant:
    """A value of a document, or an element of one of its arrays."""

    def __init__(self, v: Column, element: bool = False) -> None:
        self.v, self.element = v, element

    @property
    def col(self) -> Column:
        return self.v

    def missing(self) -> Pred:
        return False if self.element else self.v.isNull()

    def equal(self, value: Any) -> Pred:
        k = rank(value)
        if k == NULL:
            return F.coalesce(F.is_variant_null(self.v), F.lit(False))
        if k < ARRAY:  # a missing value orders as null, which no value of this kind does
            return order_key(self.v, False) == literal_key(value)
        return (order_key(self.v, True) == literal_key(value)) & self.v.isNotNull()

    def compare(self, op: str, value: Any) -> Pred:
        from quarry.plans.filters import _OPS

        return _OPS[op](order_key(self.v, rank(value) >= ARRAY), literal_key(value)) & self.v.isNotNull()

    def among(self, values: list) -> Pred:
        out: Pred = False
        for v in values:
            if v is not None:
                out = self.equal(v) if out is False else out | self.equal(v)
        return out

    def any_element(self, test: Callable[[Any], Pred], criteria: Any = None) -> Pred:
        if compares_containers(criteria):
            return elements_match(F.to_json(self.v), criteria)
        items = F.try_variant_get(F.when(kind_rank(self.v) == ARRAY, self.v), "$", "array<variant>")
        made = F.exists(items, lambda e: F.coalesce(column(test(Variant(e, True))), F.lit(False)))
        return F.coalesce(made, F.lit(False))

    def field(self, name: str) -> Any:
        return Variant(member(self.v, name))


def member(doc: Column, name: str) -> Column:
    """The value under a key of an object, whatever characters the key has; NULL where it is missing."""
    path = "$[" + json.dumps(name, ensure_ascii=False) + "]"
    if '"' in name or "\\" in name:
        if "'" in name:  # no path can hold both kinds of quotes
            return F.element_at(F.try_variant_get(doc, "$", "map<string,variant>"), F.lit(name))
        path = f"$['{name}']"
    return F.try_variant_get(doc, path, "variant")
