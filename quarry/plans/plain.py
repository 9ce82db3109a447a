"""Filters evaluated on Python values, for what columns can't express: criteria
of array elements that compare whole arrays or objects."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from quarry.functions.values import ARRAY, NULL, order_bytes, rank

_MISSING = object()
_TESTS = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


class Plain:
    """A value, or no value; what it answers are booleans."""

    def __init__(self, value: Any) -> None:
        self.value = value

    def missing(self) -> bool:
        return self.value is _MISSING

    def equal(self, value: Any) -> bool:
        return not self.missing() and order_bytes(self.value) == order_bytes(value)

    def compare(self, op: str, value: Any) -> bool:
        return not self.missing() and _TESTS[op](order_bytes(self.value), order_bytes(value))

    def among(self, values: list) -> bool:
        return any(self.equal(v) for v in values if v is not None)

    def any_element(self, test: Callable[[Any], Any], criteria: Any = None) -> bool:
        return isinstance(self.value, list) and any(test(Plain(e)) for e in self.value)

    def field(self, name: str) -> Plain:
        return Plain(self.value.get(name, _MISSING) if isinstance(self.value, dict) else _MISSING)


def compares_containers(criteria: Any, ordered: bool = False) -> bool:
    """Whether a criterion compares whole arrays or objects; ordered: by more than equality."""
    if isinstance(criteria, dict) and criteria and all(k.startswith("$") for k in criteria):
        for op, v in criteria.items():
            if op in ("$in", "$nin"):
                if not ordered and isinstance(v, (list, tuple)) and any(rank(x) >= ARRAY for x in v):
                    return True
            elif op in ("$not", "$elemMatch"):
                if compares_containers(v, ordered):
                    return True
            elif op in ("$and", "$or"):
                if isinstance(v, (list, tuple)) and any(_in_document(q, ordered) for q in v):
                    return True
            elif rank(v) >= ARRAY and (not ordered or op in _TESTS):
                return True
        return False
    if isinstance(criteria, dict):
        return _in_document(criteria, ordered)
    return rank(criteria) >= ARRAY and not ordered


def _in_document(query: Any, ordered: bool) -> bool:
    if not isinstance(query, dict):
        return False
    for key, cond in query.items():
        if key in ("$and", "$or"):
            if isinstance(cond, (list, tuple)) and any(_in_document(q, ordered) for q in cond):
                return True
        elif isinstance(cond, dict) and cond and all(k.startswith("$") for k in cond):
            if compares_containers(cond, ordered):
                return True
        elif rank(cond) >= ARRAY and not ordered:
            return True
    return rank(query) == NULL


def elements_match(text: Column, criteria: Any) -> Column:
    """$elemMatch on the JSON text of a value; NULL text does not match."""
    from quarry.plans.filters import operator

    @arrow_udf("boolean")
    def matched(column: pa.Array) -> pa.Array:
        return pa.array([x is not None and bool(operator(Plain(json.loads(x)), "$elemMatch", criteria)) for x in column.to_pylist()], pa.bool_())

    return matched(text)
