"""Kinds of values and their total order.

Ranks: null < bool < number < string < array < object < other (timestamps and
the like, which only typed columns have). Numbers compare exactly, whatever
their types; NaN is equal to itself and last; -0.0 equals 0.0."""

from __future__ import annotations

import json
import math
import struct
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT, OTHER = range(7)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def rank(value: Any) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    if isinstance(value, (list, tuple)):
        return ARRAY
    if isinstance(value, dict):
        return OBJECT
    return OTHER


def rank_of_type(kind: T.DataType) -> int:
    if isinstance(kind, T.NullType):
        return NULL
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.NumericType):
        return NUMBER
    if isinstance(kind, T.StringType):
        return STRING
    if isinstance(kind, T.ArrayType):
        return ARRAY
    if isinstance(kind, (T.StructType, T.MapType)):
        return OBJECT
    return OTHER


def order_bytes(value: Any) -> bytes:
    """Bytes that compare as the values do."""
    r = rank(value)
    head = bytes([r + 1])
    if r == NULL:
        return head
    if r == BOOL:
        return head + bytes([value])
    if r == NUMBER:
        return head + _number_bytes(value)
    if r == STRING:
        return head + value.encode().replace(b"\0", b"\0\xff") + b"\0\0"
    if r == ARRAY:
        return head + b"".join(order_bytes(v) for v in value) + b"\0"
    if r == OBJECT:
        return head + b"".join(order_bytes(k) + order_bytes(value[k]) for k in sorted(value, key=lambda k: k.encode())) + b"\0"
    raise TypeError(f"no order for {type(value).__name__}")


def _number_bytes(x: float) -> bytes:
    """A double, ordered as unsigned bytes, then what rounding to it left."""
    if isinstance(x, float):
        n, rest = (math.nan if math.isnan(x) else x + 0.0), 0
    else:
        n = float(x) if abs(x) < 1 << 1000 else math.copysign(math.inf, x)
        rest = x - int(n) if math.isfinite(n) else 0
    bits = struct.unpack(">Q", struct.pack(">d", abs(n) if math.isnan(n) else n))[0]
    bits = bits ^ (1 << 63) if not bits >> 63 else bits ^ ((1 << 64) - 1)
    return struct.pack(">QQ", bits, rest + (1 << 63))


def number_key(col: Column, kind: T.DataType) -> Column:
    """A number as struct(n double, r long), whose order is exact between integers and floats."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.struct((col.cast("double") + F.lit(0.0)).alias("n"), F.lit(0).cast("long").alias("r"))
    if isinstance(kind, T.DecimalType):
        return F.struct((col.cast("double") + F.lit(0.0)).alias("n"), F.lit(0).cast("long").alias("r"))
    i = col.cast("long")
    n = i.cast("double")
    r = F.when(n >= F.lit(2.0**63), i - F.lit(LONG_MAX) - F.lit(1)).otherwise(i - n.cast("long"))
    return F.struct(n.alias("n"), r.cast("long").alias("r"))


def number_literal(x: float) -> tuple[float, int]:
    if isinstance(x, float):
        return (x + 0.0, 0)
    n = float(x)
    return (n, x - int(n))


def rendered(value: Any) -> str:
    """JSON text that keeps integers and floats apart; non-finite numbers are refused."""
    return json.dumps(value, allow_nan=False, ensure_ascii=False)
