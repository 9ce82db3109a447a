"""The two ways in which a collection holds documents.

Typed: an ordinary frame with a key column. Dynamic: a frame of _id, seq (order
of insertion), json (the document, which keeps integers and floats apart and the
order of keys) and doc (the same as VARIANT, for evaluation only)."""

from __future__ import annotations

import json
import secrets
import time
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import IdMustBeString, InvalidUpdate, NotAnObject
from quarry.functions import paths
from quarry.functions.values import LONG_MAX, LONG_MIN, NUMBER, rank_of_type, rendered
from quarry.plans import dynamic, filters


class TypedBackend:
    dynamic = False

    def normalized(self, doc: Any) -> dict:
        """A document with its id."""
        if not isinstance(doc, dict):
            raise NotAnObject("a document is an object")
        if doc.get(self.key) is None:
            raise IdMustBeString(f"a row needs its {self.key!r}")
        return dict(doc)

    def __init__(self, schema: T.StructType, key: str, null_is: str = "missing", null_matches_missing: bool = False) -> None:
        self.schema, self.key = schema, key
        self.explicit = null_is == "explicit"
        self.null_matches_missing = null_matches_missing

    def ref(self, name: str) -> Any:
        return filters.Typed(F.col(f"`{name}`"), self.schema[name].dataType, self.explicit) if name in self.schema.names else filters.Absent()

    def predicate(self, query: Any) -> Column:
        return filters.column(filters.document(self.ref, query, self.null_matches_missing))

    def id(self) -> Column:
        return F.col(f"`{self.key}`")

    def sort_key(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.schema.names else F.lit(None).cast("int")

    def order(self) -> Column:
        """Order of a stream that isn't sorted."""
        return self.id()

    def value(self, name: str) -> Column:
        return self.sort_key(name)

    def kind(self, name: str) -> T.DataType:
        return self.schema[name].dataType if name in self.schema.names else T.NullType()

    def documents(self, rows: list[Row]) -> list[dict]:
        return [r.asDict(recursive=True) for r in rows]

    def frame_of(self, spark: Any, docs: list[dict], seq: int) -> DataFrame:
        return spark.createDataFrame([Row(**{n: d.get(n) for n in self.schema.names}) for d in docs], self.schema)

    def updated(self, df: DataFrame, match: Column, spec: dict) -> DataFrame:
        """Every matching row with the spec's operators applied in their order."""
        cols: dict[str, Column] = {n: F.col(f"`{n}`") for n in self.schema.names}
        for op, fields in spec.items():
            for path, operand in fields.items() if isinstance(fields, dict) else [(p, None) for p in fields]:
                tokens = paths.parse(path)
                if tokens[0] not in cols:
                    if op == "$unset":
                        continue
                    raise InvalidUpdate(f"no column {tokens[0]!r} in a typed collection")
                kind = self.schema[tokens[0]].dataType
                cols[tokens[0]] = _typed_step(op, cols[tokens[0]], kind, tokens[1:], operand)
        hit = F.coalesce(match, F.lit(False))
        return df.select(*[F.when(hit, c.cast(self.schema[n].dataType)).otherwise(F.col(f"`{n}`")).alias(n) if not _same(c, n) else F.col(f"`{n}`") for n, c in cols.items()])

    def replaced(self, df: DataFrame, match: Column, doc: dict) -> DataFrame:
        hit = F.coalesce(match, F.lit(False))
        new = {n: self.id() if n == self.key else _literal(doc.get(n), self.schema[n].dataType) for n in self.schema.names}
        return df.select(*[F.when(hit, new[n]).otherwise(F.col(f"`{n}`")).alias(n) for n in self.schema.names])


def _same(c: Column, name: str) -> bool:
    return str(c) == str(F.col(f"`{name}`"))


def _literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(value, (list, dict)):
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value).cast(kind)


def _typed_step(op: str, col: Column, kind: T.DataType, rest: list[str], operand: Any) -> Column:
    if rest and isinstance(kind, T.StructType):
        name = rest[0]
        if name not in kind.names:
            if op == "$unset":
                return col
            raise InvalidUpdate(f"no field {name!r} in a typed collection")
        base = F.when(col.isNotNull(), col).otherwise(_literal({}, kind)) if op != "$unset" else col
        return base.withField(name, _typed_step(op, base[name], kind[name].dataType, rest[1:], operand))
    if rest and isinstance(kind, T.ArrayType):
        if not paths.is_index(rest[0]):
            raise InvalidUpdate(f"{rest[0]!r} is no index")
        i, inner = int(rest[0]), kind.elementType
        size = F.coalesce(F.size(col), F.lit(0))
        if op == "$unset" and len(rest) == 1:
            gone = F.filter(col, lambda x, k: k != i)
            return F.when(size < i, F.raise_error(F.lit(f"index {i} is beyond an array"))).otherwise(gone)
        here = F.get(col, F.lit(i))
        new = F.array(_typed_step(op, here, inner, rest[1:], operand).cast(inner))
        if op == "$unset":
            return F.when(size <= i, col).otherwise(F.concat(F.slice(col, 1, i), new, F.slice(col, i + 2, F.greatest(size - i - 1, F.lit(0)))))
        whole = F.coalesce(col, F.array_repeat(F.lit(None).cast(inner), i + 1))
        tail = F.slice(whole, i + 2, F.greatest(F.size(whole) - i - 1, F.lit(0)))
        return F.when(F.size(whole) < i, F.raise_error(F.lit(f"index {i} is beyond an array"))).otherwise(F.concat(F.slice(whole, 1, i), new, tail))
    if rest:
        raise InvalidUpdate(f"{rest[0]!r} leads into a scalar")
    if op == "$unset":
        return F.lit(None).cast(kind)
    if op == "$set":
        return _literal(operand, kind)
    if rank_of_type(kind) != NUMBER:
        raise InvalidUpdate("$inc needs a number")
    if isinstance(kind, T.IntegralType) and isinstance(operand, int):
        return F.when(col.isNull(), F.lit(operand)).otherwise(F.coalesce(F.try_add(col.cast("long"), F.lit(operand).cast("long")), F.raise_error(F.lit("$inc leaves the range of an integer column")).cast("long")))
    if isinstance(kind, T.IntegralType):
        raise InvalidUpdate("$inc by a float needs a float column")
    return F.coalesce(col + F.lit(operand), F.lit(operand).cast(kind))


def check_spec(spec: Any) -> dict:
    """The spec of an update, or InvalidUpdate."""
    if not isinstance(spec, dict):
        raise InvalidUpdate("an update is an object")
    for op, fields in spec.items():
        if op not in ("$set", "$inc", "$unset"):
            raise InvalidUpdate(f"unknown operator {op!r}")
        if not isinstance(fields, dict) and not (op == "$unset" and isinstance(fields, (list, tuple)) and all(isinstance(f, str) for f in fields)):
            raise InvalidUpdate(f"{op} needs an object")
        for path, operand in fields.items() if isinstance(fields, dict) else [(f, 0) for f in fields]:
            if paths.parse(path)[0] == "_id":
                raise InvalidUpdate("_id can't be changed")
            if op == "$inc" and (isinstance(operand, bool) or not isinstance(operand, (int, float))):
                raise InvalidUpdate("$inc needs a number")
    return spec


def apply_spec(doc: dict, spec: dict) -> dict:
    """A document with the operators applied in their order."""
    for op, fields in spec.items():
        for path, operand in fields.items() if isinstance(fields, dict) else [(f, None) for f in fields]:
            tokens = paths.parse(path)
            if op == "$unset":
                doc = paths.drop(doc, tokens)
            elif op == "$set":
                doc = paths.put(doc, tokens, operand)
            else:
                old = paths.get(doc, tokens)
                if old is paths.MISSING:
                    new = operand
                elif isinstance(old, bool) or not isinstance(old, (int, float)):
                    raise InvalidUpdate(f"$inc of {path!r}, which is no number")
                else:
                    new = old + operand
                    if isinstance(new, int) and not LONG_MIN <= new <= LONG_MAX:
                        new = float(new)
                doc = paths.put(doc, tokens, new)
    return doc


DYNAMIC = T.StructType([T.StructField("_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("json", T.StringType())])


def with_doc(df: DataFrame) -> DataFrame:
    return df.select("_id", "seq", "json").withColumn("doc", F.parse_json("json"))


_process, _ids = secrets.token_hex(5), count(secrets.randbits(20))


def new_id() -> str:
    """24 hexadecimal digits: the second, a number of the process, a counter."""
    return f"{int(time.time()) & 0xFFFFFFFF:08x}{_process}{next(_ids) & 0xFFFFFF:06x}"


class DynamicBackend:
    dynamic = True
    key = "_id"

    def normalized(self, doc: Any) -> dict:
        """A document with its id; a missing one is made and comes first."""
        if not isinstance(doc, dict):
            raise NotAnObject("a document is an object")
        if "_id" not in doc:
            return {"_id": new_id()} | doc
        if not isinstance(doc["_id"], str):
            raise IdMustBeString("_id is a string")
        return dict(doc)

    def __init__(self, null_matches_missing: bool = False) -> None:
        self.null_matches_missing = null_matches_missing

    def ref(self, name: str) -> Any:
        return dynamic.Variant(self.value(name))

    def predicate(self, query: Any) -> Column:
        return filters.column(filters.document(self.ref, query, self.null_matches_missing))

    def id(self) -> Column:
        return F.col("_id")

    def value(self, name: str) -> Column:
        return dynamic.member(F.col("doc"), name)

    def sort_key(self, name: str) -> Column:
        return dynamic.order_key(self.value(name), True)

    def order(self) -> Column:
        return F.col("seq")

    def documents(self, rows: list[Row]) -> list[dict]:
        return [json.loads(r["json"]) for r in rows]

    def frame_of(self, spark: Any, docs: list[dict], seq: int) -> DataFrame:
        rows = []
        for i, d in enumerate(docs):
            if not isinstance(d, dict):
                raise NotAnObject("a document is an object")
            rows.append((d["_id"], seq + i, rendered(d)))
        return with_doc(spark.createDataFrame(rows, DYNAMIC))

    def _rewritten(self, df: DataFrame, match: Column, change: Callable[[str, str], str]) -> DataFrame:
        """Documents with change(id, text) where they match; text goes through Python in Arrow batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts, hits = (b.column(c).to_pylist() for c in ("_id", "json", "hit"))
                new = [change(i, t) if h else t for i, t, h in zip(ids, texts, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("seq"), pa.array(new, pa.string())], ["_id", "seq", "json"])

        hit = df.select("_id", "seq", "json", F.coalesce(match, F.lit(False)).alias("hit"))
        return with_doc(hit.mapInArrow(run, DYNAMIC))

    def updated(self, df: DataFrame, match: Column, spec: dict) -> DataFrame:
        return self._rewritten(df, match, lambda _, t: rendered(apply_spec(json.loads(t), spec)))

    def replaced(self, df: DataFrame, match: Column, doc: dict) -> DataFrame:
        plain = {k: v for k, v in doc.items() if k != "_id"}
        return self._rewritten(df, match, lambda i, _: rendered({"_id": i} | plain))
