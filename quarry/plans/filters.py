"""Filters over typed columns.

A filter is a dict of fields and operators; it becomes one Column, or a constant
where kinds and missing columns decide. In a positive position SQL's NULL counts
as false, so comparisons stay bare and reach the Parquet scan; under $not they
are wrapped.

SQL NULL in a column means that the field is missing; with null_is="explicit" it
is the value null. In arrays NULL is always the value null."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.values import ARRAY, BOOL, LONG_MAX, LONG_MIN, NULL, NUMBER, OBJECT, OTHER, STRING, rank, rank_of_type
from quarry.plans.plain import compares_containers, elements_match

Pred = bool | Column


def both(a: Pred, b: Pred) -> Pred:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def either(a: Pred, b: Pred) -> Pred:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def negated(a: Pred) -> Pred:
    return not a if isinstance(a, bool) else ~F.coalesce(a, F.lit(False))


def column(a: Pred) -> Column:
    return F.lit(a) if isinstance(a, bool) else a


def is_operators(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(isinstance(k, str) and k.startswith("$") for k in value)


class Absent:
    """A field that no row has."""

    def missing(self) -> Pred:
        return True

    def equal(self, value: Any) -> Pred:
        return False

    def compare(self, op: str, value: Any) -> Pred:
        return False

    def among(self, values: list) -> Pred:
        return False

    def any_element(self, test: Callable[[Any], Pred], criteria: Any = None) -> Pred:
        return False

    def field(self, name: str) -> Any:
        return self


class Typed:
    """A column, field or element with a Spark type."""

    def __init__(self, col: Column, kind: T.DataType, explicit: bool) -> None:
        self.col = col.cast("double") if isinstance(kind, T.FloatType) else col
        self.kind = T.DoubleType() if isinstance(kind, T.FloatType) else kind
        self.rank, self.explicit = rank_of_type(kind), explicit

    def missing(self) -> Pred:
        """Where the field is absent."""
        return False if self.explicit else self.col.isNull()

    def null(self) -> Pred:
        """Where the value is null."""
        return self.col.isNull() if self.explicit else False

    def there(self) -> Pred:
        return True if self.explicit else self.col.isNotNull()

    def equal(self, value: Any) -> Pred:
        r = rank(value)
        if r == NULL:
            return self.null()
        if r != self.rank:
            return False
        if r == NUMBER:
            return self._number("$eq", value)
        if r == ARRAY:
            same = [Typed(F.get(self.col, F.lit(i)), self.kind.elementType, True).equal(v) for i, v in enumerate(value)]
            return reduce(both, same, F.size(self.col) == len(value))
        if r == OBJECT:
            if isinstance(self.kind, T.MapType):
                got = [both(F.map_contains_key(self.col, F.lit(k)), Typed(F.element_at(self.col, F.lit(k)), self.kind.valueType, True).equal(v)) for k, v in value.items()]
                return reduce(both, got, F.size(self.col) == len(value))
            names = set(self.kind.names)
            if set(value) - names:
                return False
            rest = [self.col[k].isNull() for k in self.kind.names if k not in value]
            return reduce(both, [*rest, *[self.field(k).equal(v) for k, v in value.items()]], self.col.isNotNull())
        return self.col == F.lit(value)

    def compare(self, op: str, value: Any) -> Pred:
        r = rank(value)
        above, orequal = op in ("$gt", "$gte"), op in ("$gte", "$lte")
        if r == NULL:
            return (self.there() if orequal else self.col.isNotNull()) if above else self.null() if orequal else False
        if r != self.rank:
            lower = self.rank < r
            return (False if lower else self.col.isNotNull()) if above else (self.there() if lower else self.null())
        if r == NUMBER:
            plain = self._number(op, value)
        elif r in (STRING, BOOL, OTHER):
            plain = _OPS[op](self.col, F.lit(value))
        else:
            plain = self._containers(op, value)
        return plain if above else either(self.null(), plain)

    def _containers(self, op: str, value: Any) -> Pred:
        from quarry.functions.keys import container_key
        from quarry.functions.values import order_bytes

        # Maps and structs drop NULL fields in JSON: a field that is NULL is missing.
        return _OPS[op](container_key(F.to_json(self.col, {"ignoreNullFields": str(not isinstance(self.kind, T.ArrayType)).lower()})), F.lit(bytearray(order_bytes(value))))

    def _number(self, op: str, value: float) -> Pred:
        if isinstance(self.kind, T.IntegralType):
            return self._integral(op, value)
        if isinstance(value, int):
            near = float(value) if abs(value) < 1 << 1023 else math.copysign(math.inf, value)
            if near != value:  # no double is equal: move to the nearest and adapt
                if op == "$eq":
                    return False
                above = op in ("$gt", "$gte")
                op = ("$gte" if above else "$lt") if near > value else ("$gt" if above else "$lte")
            value = near
        if isinstance(self.kind, T.DecimalType) and math.isfinite(value):
            return _OPS[op](self.col, F.lit(value).cast(self.kind) if float(value).is_integer() else F.lit(value))
        return _OPS[op](self.col, F.lit(float(value)))

    def _integral(self, op: str, value: float) -> Pred:
        above = op in ("$gt", "$gte")
        if isinstance(value, float):
            if math.isnan(value) or value == math.inf:
                return False if above or op == "$eq" else self.col.isNotNull()
            if value == -math.inf:
                return self.col.isNotNull() if above else False
            if not value.is_integer():
                if op == "$eq":
                    return False
                op, value = ("$gt", math.floor(value)) if above else ("$lt", math.ceil(value))
            value = int(value)
        if not LONG_MIN <= value <= LONG_MAX:
            return False if op == "$eq" or above == (value > 0) else self.col.isNotNull()
        return _OPS[op](self.col, F.lit(value))

    def among(self, values: list) -> Pred:
        """Equal to one of the values that are not null."""
        plain, out = [], False
        for v in values:
            if v is None:
                continue
            if rank(v) == self.rank and self.rank in (STRING, BOOL):
                plain.append(v)
            elif rank(v) == self.rank == NUMBER and isinstance(self.kind, T.IntegralType):
                if isinstance(v, int) or (math.isfinite(v) and v.is_integer()):
                    if LONG_MIN <= int(v) <= LONG_MAX:
                        plain.append(int(v))
            elif rank(v) == self.rank == NUMBER and isinstance(self.kind, T.DoubleType):
                if isinstance(v, float) or (abs(v) < 1 << 1023 and float(v) == v):
                    plain.append(float(v))
            else:
                out = either(out, self.equal(v))
        return either(self.col.isin(plain), out) if plain else out

    def any_element(self, test: Callable[[Any], Pred], criteria: Any = None) -> Pred:
        if not isinstance(self.kind, T.ArrayType):
            return False
        if compares_containers(criteria, ordered=True):
            return elements_match(F.to_json(self.col), criteria)
        fixed: list[Pred] = []
        inner = self.kind.elementType
        made = F.exists(self.col, lambda e: (fixed.append(p := test(Typed(e, inner, True))), F.coalesce(column(p), F.lit(False)))[1])
        if fixed[-1] is False:
            return False
        return F.size(self.col) > 0 if fixed[-1] is True else made

    def field(self, name: str) -> Any:
        if isinstance(self.kind, T.StructType) and name in self.kind.names:
            return Typed(self.col[name], self.kind[name].dataType, False)
        if isinstance(self.kind, T.MapType) and isinstance(self.kind.keyType, T.StringType):
            return Typed(F.try_element_at(self.col, F.lit(name)), self.kind.valueType, False)
        return Absent()


_OPS = {
    "$eq": lambda a, b: a == b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
}


def condition(ref: Any, cond: Any, null_matches_missing: bool = False) -> Pred:
    """A field's condition: an object of operators, or a value to be equal to."""
    if is_operators(cond):
        return reduce(both, [operator(ref, op, v) for op, v in cond.items()], True)
    if cond is None and null_matches_missing:
        return operator(ref, "$eq", None)
    return ref.equal(cond)


def operator(ref: Any, op: str, value: Any) -> Pred:
    if op == "$eq":
        return either(ref.equal(value), ref.missing()) if value is None else ref.equal(value)
    if op == "$ne":
        if value is None:
            return negated(either(ref.equal(None), ref.missing()))
        same = ref.equal(value)
        if isinstance(same, bool):
            return not same
        plain = isinstance(ref, Typed) and ref.rank in (BOOL, NUMBER, STRING, OTHER)
        return ref.col.isNull() | ~same if plain else negated(same)
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return ref.compare(op, value)
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            return False
        found = ref.among(list(value))
        if any(v is None for v in value):
            found = either(found, operator(ref, "$eq", None))
        if op == "$in":
            return found
        if isinstance(found, bool):
            return not found
        plain = isinstance(ref, Typed) and not any(v is None for v in value)
        return ref.col.isNull() | ~found if plain and ref.rank in (BOOL, NUMBER, STRING) else negated(found)
    if op == "$not":
        return negated(condition(ref, value)) if is_operators(value) else False
    if op == "$exists":
        if not isinstance(value, bool):
            return False
        gone = ref.missing()
        if isinstance(gone, bool):
            return gone != value
        return gone if not value else (ref.col.isNotNull() if isinstance(ref, Typed) else negated(gone))
    if op == "$elemMatch":
        if is_operators(value):
            return ref.any_element(lambda e: condition(e, value), value)
        if isinstance(value, dict):
            return ref.any_element(lambda e: document(e.field, value), value)
        return ref.any_element(lambda e: e.equal(value), value)
    return False


def document(field: Callable[[str], Any], query: Any, null_matches_missing: bool = False) -> Pred:
    """A filter on a document whose fields `field` finds."""
    if not isinstance(query, dict):
        return False
    out: Pred = True
    for key, cond in query.items():
        if key == "$and":
            ok = isinstance(cond, (list, tuple))
            part = reduce(both, [document(field, q, null_matches_missing) for q in cond], True) if ok else False
        elif key == "$or":
            ok = isinstance(cond, (list, tuple))
            part = reduce(either, [document(field, q, null_matches_missing) for q in cond], False) if ok else False
        elif key == "$not":
            part = False
        else:
            part = condition(field(key), cond, null_matches_missing)
        out = both(out, part)
    return out
