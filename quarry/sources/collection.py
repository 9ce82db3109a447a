"""Collections: reads, searches, writes, indexes and batches over snapshots.

A collection's state is an immutable frame; a write evaluates the rows that it
touches into the shared folder, plans a frame of them and the untouched ones, and
swaps it in under a lock. Every CHECKPOINT_EVERY writes the whole frame is written,
which cuts the lineage. Indexes are written tables of one snapshot, made when they
are first read."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import DuplicateId, IdMismatch, IdMustBeString, InvalidUpdate, NoIndex, NoMatch, NotAnObject, PrimaryIndex, StoreError, VectorDimMismatch
from quarry.operators import hybrid, text, vector
from quarry.operators.index import FieldIndex
from quarry.operators.query import Query
from quarry.shipping import ship
from quarry.sources.backends import DYNAMIC, DynamicBackend, TypedBackend, check_spec, with_doc
from quarry.storage import written

CHECKPOINT_EVERY = 16


class Collection:
    """A named set of documents with unique ids."""

    def __init__(self, spark: SparkSession, name: str = "docs", frame: DataFrame | None = None, key: str = "_id", **policy: Any) -> None:
        """Without a frame: schemaless documents. With one: its rows, by the key column."""
        ship(spark)
        self.spark, self.name = spark, name
        self._lock = threading.RLock()
        #: How often the snapshot has moved.
        self.version = 0
        self._seq: int | None = None
        self._built: dict[tuple[str, str], Any] = {}
        self._value_indexes: set[str] = set()
        self._vector_indexes: dict[str, int] = {}
        self._text_indexes: set[str] = set()
        if frame is None:
            self.backend: Any = DynamicBackend(**policy)
            self.frame = with_doc(spark.createDataFrame([], DYNAMIC))
        else:
            self.backend = TypedBackend(frame.schema, key, **policy)
            self.frame = frame

    # Reads

    def find(self, query: Any = None) -> Query:
        return Query(self._source(query), self.backend, {} if query is None else query)

    def _source(self, query: Any) -> DataFrame:
        """The snapshot, or its copy in ranges of an indexed column that the filter names,
        whose files and row groups Parquet's statistics then skip."""
        named = [f for f in query if f in self._value_indexes and f in self.frame.columns] if isinstance(query, dict) and not self.backend.dynamic else []
        if not named:
            return self.frame
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._index("clustered", named[0], lambda: written(self.clustered(named[0], parts)))

    def find_one(self, query: Any = None) -> dict | None:
        return self.find(query).first()

    def count(self, query: Any = None) -> int:
        return self.find(query).count()

    def exists(self, query: Any = None) -> bool:
        return self.find(query).exists()

    def get(self, doc_id: Any) -> dict | None:
        rows = self.frame.where(self.backend.id() == F.lit(doc_id)).limit(1).collect()
        return self.backend.documents(rows)[0] if rows else None

    def contains(self, doc_id: Any) -> bool:
        return not self.frame.where(self.backend.id() == F.lit(doc_id)).isEmpty()

    def __len__(self) -> int:
        return self.frame.count()

    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    def __iter__(self):
        for row in self.frame.toLocalIterator():
            yield self.backend.documents([row])[0]

    # Search

    def _index(self, kind: str, field: str, make: Callable[[], Any]) -> Any:
        """An index of the present snapshot, made on its first use."""
        with self._lock:
            if (kind, field) not in self._built:
                self._built[kind, field] = make()
            return self._built[kind, field]

    def _vectors(self, field: str) -> vector.VectorIndex:
        if field not in self._vector_indexes:
            raise NoIndex(f"no vector index on {field!r}")
        return self._index("vector", field, lambda: vector.VectorIndex(self.frame, self.backend, field, self._vector_indexes[field]))

    def _texts(self, field: str) -> text.TextIndex:
        if field not in self._text_indexes:
            raise NoIndex(f"no text index on {field!r}")
        return self._index("text", field, lambda: text.TextIndex(self.frame, self.backend, field))

    def vector_scores(self, field: str, query: list[float], limit: int = 0) -> DataFrame:
        return vector.top(self._vectors(field).scored(query), limit)

    def text_scores(self, field: str, query: str, limit: int = 0) -> DataFrame:
        return vector.top(self._texts(field).scored(query), limit)

    def vector_scores_many(self, field: str, queries: list[list[float]], limit: int) -> DataFrame:
        """(query, _id, score) of the best `limit` documents of each of many queries, in one job."""
        return self._vectors(field).scored_many(queries, limit)

    def text_scores_many(self, field: str, queries: list[str], limit: int) -> DataFrame:
        """(query, _id, score) of the best `limit` documents of each of many queries, in one job."""
        return self._texts(field).scored_many(queries, limit)

    def hybrid_scores(self, text_field: str, vector_field: str, query: str, query_vector: list[float], limit: int = 0) -> DataFrame:
        words, vectors = self._texts(text_field), self._vectors(vector_field)
        return vector.top(hybrid.fused(words.scored(query), vectors.scored(query_vector)), limit)

    def _hits(self, scores: DataFrame) -> list[tuple[dict, float]]:
        own = self.frame.withColumn("__id", self.backend.id())
        rows = own.join(scores.withColumnRenamed("_id", "__id").withColumnRenamed("score", "__score"), "__id").orderBy(F.desc("__score"), F.asc("__id")).collect()
        docs = self.backend.documents(rows)
        return [({k: v for k, v in d.items() if k not in ("__id", "__score")}, r["__score"]) for d, r in zip(docs, rows, strict=True)]

    def vector_search(self, field: str, query: list[float], limit: int = 10) -> list[tuple[dict, float]]:
        return self._hits(self.vector_scores(field, query, limit))

    def text_search(self, field: str, query: str, limit: int = 10) -> list[tuple[dict, float]]:
        return self._hits(self.text_scores(field, query, limit))

    def hybrid_search(self, text_field: str, vector_field: str, query: str, query_vector: list[float], limit: int = 10) -> list[tuple[dict, float]]:
        return self._hits(self.hybrid_scores(text_field, vector_field, query, query_vector, limit))

    # Writes

    def _swap(self, frame: DataFrame) -> None:
        self.version += 1
        self._built.clear()
        self.frame = written(frame) if self.version % CHECKPOINT_EVERY == 0 else frame

    def _next_seq(self) -> int:
        """The place of the next document in the order of insertion."""
        if not self.backend.dynamic:
            return 0
        if self._seq is None:
            self._seq = self.frame.agg(F.max("seq")).first()[0] or 0
        return self._seq + 1

    def _check_vectors(self, frame: DataFrame) -> None:
        """Present fields with a vector index are vectors of its length."""
        for field, dim in self._vector_indexes.items():
            there = self.backend.value(field).isNotNull()
            if not frame.where(there & vector.as_vector(self.backend, field, dim).isNull()).isEmpty():
                raise VectorDimMismatch(f"{field!r} needs {dim} numbers")

    def insert(self, doc: dict) -> str:
        return self.insert_many([doc])[0]

    def insert_many(self, docs: list[dict]) -> list[str]:
        """All or none; the ids in order."""
        docs = [self.backend.normalized(d) for d in docs]
        ids = [d[self.backend.key] for d in docs]
        if not docs:
            return []
        if len(set(ids)) < len(ids):
            raise DuplicateId("an id occurs twice in the batch")
        with self._lock:
            seq = self._next_seq()
            self._insert_frame(self.backend.frame_of(self.spark, docs, seq))
            self._seq = seq + len(docs) - 1
        return ids

    def insert_frame(self, frame: DataFrame) -> None:
        """Rows of a frame of the collection's schema, all or none; ids are compared by joins, not on the driver."""
        with self._lock:
            if not frame.groupBy(self.backend.id()).count().where("count > 1").isEmpty():
                raise DuplicateId("an id occurs twice in the batch")
            self._insert_frame(frame)

    def _insert_frame(self, new: DataFrame) -> None:
        key = self.backend.key
        if not self.frame.select(key).join(new.select(key), key, "left_semi").isEmpty():
            raise DuplicateId("an id exists already")
        self._check_vectors(new)
        self._seq = None
        self._swap(self.frame.unionByName(new.select(*self.frame.columns)))

    def _first_match(self, query: Any) -> Any:
        found = self.frame.where(self.backend.predicate({} if query is None else query)).orderBy(self.backend.order()).select(self.backend.id()).limit(1).collect()
        return found[0][0] if found else None

    def evaluated(self, rows: DataFrame) -> DataFrame:
        """Rows of a planned change as a written table; InvalidUpdate where one can't be changed so."""
        try:
            return written(rows)
        except StoreError:
            raise
        except Exception as e:
            if any(x in str(e) for x in ("PathError", "InvalidUpdate", "USER_RAISED_EXCEPTION")):
                raise InvalidUpdate(str(e).splitlines()[0]) from e
            raise

    def _rewrite(self, match: Any, change: Callable[[DataFrame], DataFrame]) -> int:
        """Changes the rows that match and validates them before the snapshot moves; how many they are."""
        match = F.coalesce(match, F.lit(False))
        rows = self.evaluated(change(self.frame.where(match)))
        n = rows.count()
        if n:
            self._check_vectors(rows)
            self._swap(self.frame.where(~match).unionByName(rows))
        return n

    def update_one(self, query: Any, spec: dict) -> int:
        with self._lock:
            target = self._first_match(query)
            if target is None:
                raise NoMatch("nothing matches")
            check_spec(spec)
            return self._rewrite(self.backend.id() == F.lit(target), lambda df: self.backend.updated(df, F.lit(True), spec))

    def update_many(self, query: Any, spec: dict) -> int:
        """All or none of the matching documents."""
        with self._lock:
            check_spec(spec)
            return self._rewrite(self.backend.predicate({} if query is None else query), lambda df: self.backend.updated(df, F.lit(True), spec))

    def replace_one(self, query: Any, doc: dict) -> int:
        with self._lock:
            target = self._first_match(query)
            if target is None:
                raise NoMatch("nothing matches")
            self._check_replacement(target, doc)
            return self._rewrite(self.backend.id() == F.lit(target), lambda df: self.backend.replaced(df, F.lit(True), doc))

    def _check_replacement(self, target: Any, doc: Any) -> None:
        if not isinstance(doc, dict):
            raise NotAnObject("a document is an object")
        if self.backend.key in doc:
            if self.backend.dynamic and not isinstance(doc["_id"], str):
                raise IdMustBeString("_id is a string")
            if doc[self.backend.key] != target:
                raise IdMismatch("a replacement keeps the id")

    def delete_one(self, query: Any) -> bool:
        with self._lock:
            target = self._first_match(query)
            if target is None:
                return False
            self._swap(self.frame.where(self.backend.id() != F.lit(target)))
            return True

    def delete_many(self, query: Any) -> int:
        with self._lock:
            match = F.coalesce(self.backend.predicate({} if query is None else query), F.lit(False))
            n = self.frame.where(match).count()
            if n:
                self._swap(self.frame.where(~match))
            return n

    def remove_doc(self, doc_id: Any) -> dict | None:
        old = self.get(doc_id)
        if old is not None:
            with self._lock:
                self._swap(self.frame.where(self.backend.id() != F.lit(doc_id)))
        return old

    def set_doc(self, doc_id: Any, doc: dict) -> dict | None:
        """The old document, or None (and no change) where the id is unknown."""
        old = self.get(doc_id)
        if old is not None:
            self.replace_one({self.backend.key: doc_id}, doc)
        return old

    def begin(self) -> Any:
        from quarry.sources.transaction import Transaction

        return Transaction(self)

    # Indexes and figures

    def create_index(self, field: str) -> None:
        """An index of values and ids; of a typed column also a copy of the rows in ranges
        of it, which searches that name the column read. Both are made on first use."""
        if field != self.backend.key:
            self._value_indexes.add(field)

    def index(self, field: str) -> FieldIndex:
        """The index on a field: values and ids of the present snapshot."""
        if field not in self.index_names():
            raise NoIndex(f"no index on {field!r}")
        return self._index("value", field, lambda: FieldIndex(self.frame, self.backend, field))

    def drop_index(self, field: str) -> None:
        if field == self.backend.key:
            raise PrimaryIndex("the index on ids can't be dropped")
        if field not in self._value_indexes:
            raise NoIndex(f"no index on {field!r}")
        self._value_indexes.discard(field)
        self._built.pop(("value", field), None)
        self._built.pop(("clustered", field), None)

    def index_names(self) -> list[str]:
        return sorted({self.backend.key, *self._value_indexes})

    def create_vector_index(self, field: str, dim: int) -> None:
        self._vector_indexes[field] = dim
        self._built.pop(("vector", field), None)

    def drop_vector_index(self, field: str) -> None:
        self._vector_indexes.pop(field, None)
        self._built.pop(("vector", field), None)

    def has_vector_index(self, field: str) -> bool:
        return field in self._vector_indexes

    def vector_index_names(self) -> list[str]:
        return sorted(self._vector_indexes)

    def create_text_index(self, field: str) -> None:
        self._text_indexes.add(field)

    def drop_text_index(self, field: str) -> None:
        self._text_indexes.discard(field)
        self._built.pop(("text", field), None)

    def has_text_index(self, field: str) -> bool:
        return field in self._text_indexes

    def text_index_names(self) -> list[str]:
        return sorted(self._text_indexes)

    def clustered(self, field: str, partitions: int) -> DataFrame:
        """The documents in ranges of a field, sorted within: what an index on it would serve, for writing to files."""
        return self.frame.repartitionByRange(partitions, self.backend.sort_key(field), self.backend.id()).sortWithinPartitions(self.backend.sort_key(field), self.backend.id())

    def stats_frame(self) -> DataFrame:
        """(field, entries, distinct) of every index, from one pass; a missing value counts as null."""
        names = self.index_names()
        keys = {n: self._stat_key(n) for n in names}
        counted = self.frame.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(k)).alias(f"d{i}") for i, k in enumerate(keys.values())])
        return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col("n").alias("entries"), F.col(f"d{i}").alias("distinct")) for i, n in enumerate(names)])).alias("x")).select("x.*")

    def _stat_key(self, name: str) -> Any:
        return self.backend.id() if name == self.backend.key else self.backend.sort_key(name)

    def stats(self) -> dict:
        """Documents, indexes, and memory as Spark estimates it; total is documents plus all indexes."""
        rows = [r.asDict() for r in self.stats_frame().collect()]
        n = rows[0]["entries"]
        size = min(int(str(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 62)
        per = [r | {"memory": 16 * r["entries"]} for r in rows]
        return {"docs": n, "docs_memory": size, "indexes": len(per), "per_index": per, "total_memory": size + sum(r["memory"] for r in per)}

    def reindex(self) -> int:
        """Makes the value and text indexes anew; how many value indexes there are."""
        with self._lock:
            for kind, field in [k for k in self._built if k[0] != "vector"]:
                del self._built[kind, field]
            for field in self.index_names():
                self.index(field)
            for field in self._text_indexes:
                self._texts(field)
        return len(self.index_names())


class Store:
    """Collections by name; reading one that doesn't exist finds nothing.

    connect() and close() frame its use as a client's: it works in the given session,
    or the active one, and does not stop a session that others may use."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._lock = threading.Lock()
        self._collections: dict[str, Collection] = {}
        self._closed = False

    @classmethod
    def connect(cls, spark: SparkSession | None = None) -> Store:
        return cls(spark or SparkSession.builder.getOrCreate())

    def close(self) -> None:
        """Forgets the collections; the store answers no more. Closing again does nothing."""
        with self._lock:
            self._collections.clear()
            self._closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def collection(self, name: str) -> Collection:
        with self._lock:
            if self._closed:
                raise StoreError("the store is closed")
            if name not in self._collections:
                self._collections[name] = Collection(self.spark, name)
            return self._collections[name]

    def attach(self, name: str, frame: DataFrame, key: str, **policy: Any) -> Collection:
        """A typed collection over a frame."""
        with self._lock:
            self._collections[name] = Collection(self.spark, name, frame, key, **policy)
            return self._collections[name]

    def read_parquet(self, name: str, path: str, key: str, **policy: Any) -> Collection:
        return self.attach(name, self.spark.read.parquet(path), key, **policy)

    def read_json(self, name: str, path: str, id_field: str = "_id") -> Collection:
        """Schemaless documents of a JSON-lines file, ids from a string field."""
        lines = self.spark.read.text(path).where("trim(value) <> ''")
        # A filter on ids may come before that on blank lines, so these are no JSON by themselves.
        line = F.when(F.trim("value") != "", F.col("value"))
        rows = lines.select(F.try_variant_get(F.parse_json(line), f"$['{id_field}']", "string").alias("_id"), F.monotonically_increasing_id().alias("seq"), line.alias("json"))
        c = Collection(self.spark, name)
        c.insert_frame(with_doc(rows))
        with self._lock:
            self._collections[name] = c
        return c


def write_parquet(frame: DataFrame, path: str) -> None:
    """Documents or results to files; the VARIANT column, which is derived, is left out."""
    frame.select(*[f.name for f in frame.schema.fields if not isinstance(f.dataType, T.VariantType)]).write.parquet(path)
