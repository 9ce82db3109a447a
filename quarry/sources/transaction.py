"""Atomic batches: staged writes over a snapshot, applied together or not at all."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import Conflict, DuplicateId, NoMatch, StoreError
from quarry.operators.query import Query
from quarry.sources.backends import check_spec
from quarry.storage import written


class Transaction:
    """Reads see the snapshot of begin(). Of several writes to one id the last
    wins. The first error makes the batch fail; commit() then raises it, and so it
    does where the collection was written to since begin().

    Rows that an update, a replacement or a delete touches are written to the shared
    folder as they will be; only inserted documents, which the caller holds anyway,
    are on the driver."""

    def __init__(self, collection: Any) -> None:
        self.collection, self.backend = collection, collection.backend
        self.snapshot, self.version = collection.frame, collection.version
        self._new: dict[Any, dict] = {}
        self._staged: list[tuple[DataFrame, bool]] = []  # rows, and whether they go
        self._error: StoreError | None = None
        self._done = False

    @property
    def error(self) -> StoreError | None:
        return self._error

    @property
    def is_failed(self) -> bool:
        return self._error is not None

    def find(self, query: Any = None) -> Query:
        return Query(self.snapshot, self.backend, {} if query is None else query)

    def find_one(self, query: Any = None) -> dict | None:
        return self.find(query).first()

    def count(self, query: Any = None) -> int:
        return self.find(query).count()

    def get(self, doc_id: Any) -> dict | None:
        return self.find({self.backend.key: doc_id}).first()

    def contains(self, doc_id: Any) -> bool:
        return self.find({self.backend.key: doc_id}).exists()

    def __len__(self) -> int:
        return self.snapshot.count()

    def _fail(self, error: StoreError) -> None:
        self._error = self._error or error
        raise error

    def insert(self, doc: dict) -> Any:
        return self.insert_many([doc])[0]

    def insert_many(self, docs: list[dict]) -> list[Any]:
        """All or none. Ids of the snapshot are taken, deleted ones too."""
        try:
            docs = [self.backend.normalized(d) for d in docs]
        except StoreError as e:
            self._fail(e)
        ids = [d[self.backend.key] for d in docs]
        if len(set(ids)) < len(ids) or any(i in self._new for i in ids):
            self._fail(DuplicateId("an id occurs twice in the batch"))
        key = self.backend.key
        mine = self.collection.spark.createDataFrame([(i,) for i in ids], f"`{key}` {dict(self.snapshot.dtypes)[key]}")
        if ids and not self.snapshot.select(key).join(mine, key, "left_semi").isEmpty():
            self._fail(DuplicateId("an id exists already"))
        self._new |= dict(zip(ids, docs, strict=True))
        return ids

    def _stage(self, rows: DataFrame, gone: bool) -> int:
        try:
            rows = self.collection.evaluated(rows)
        except StoreError as e:
            self._fail(e)
        n = rows.count()
        if n:
            self._staged.append((rows, gone))
        return n

    def update(self, query: Any, spec: dict) -> int:
        """How many documents of the snapshot match; none is no failure."""
        try:
            check_spec(spec)
            rows = self.backend.updated(self.find(query).frame(), F.lit(True), spec)
        except StoreError as e:
            self._fail(e)
        return self._stage(rows, False)

    def replace(self, query: Any, doc: dict) -> int:
        old = self.find(query).first()
        if old is None:
            self._fail(NoMatch("nothing matches"))
        i = old[self.backend.key]
        try:
            self.collection._check_replacement(i, doc)
        except StoreError as e:
            self._fail(e)
        return self._stage(self.backend.replaced(self.snapshot.where(self.backend.id() == F.lit(i)), F.lit(True), doc), False)

    def delete(self, query: Any) -> int:
        return self._stage(self.find(query).frame(), True)

    def commit(self) -> None:
        """The snapshot without what was touched, the last version of each touched row,
        and what was inserted. Validated before the collection's snapshot moves."""
        if self._error is not None:
            raise self._error
        if self._done:
            raise StoreError("the batch is over")
        c, key = self.collection, self.backend.key
        with c._lock:
            if c.version != self.version:
                raise Conflict("the collection was written to since the batch began")
            frame, columns = self.snapshot, self.snapshot.columns
            fresh = self.backend.frame_of(c.spark, list(self._new.values()), c._next_seq()) if self._new else None
            if fresh is not None:
                c._check_vectors(fresh)
            if self._staged:
                marked = [rows.select(F.col(f"`{key}`").alias("k"), F.struct(*[F.col(f"`{x}`") for x in columns]).alias("r"), F.lit(op).alias("op"), F.lit(gone).alias("gone")) for op, (rows, gone) in enumerate(self._staged)]
                # Numbers of the last writes are compared, not rows, which may hold variants.
                every = reduce(DataFrame.unionByName, marked)
                last = every.groupBy("k").agg(F.max("op").alias("op"))
                won = written(every.join(last, ["k", "op"]))
                kept = won.where("not gone").select("r.*")
                c._check_vectors(kept)
                frame = frame.join(won.select(F.col("k").alias(key)), key, "left_anti").select(*columns).unionByName(kept)
            if fresh is not None:
                frame = frame.unionByName(fresh.select(*columns))
            if self._staged or fresh is not None:
                c._swap(frame)
            self._done = True

    def rollback(self) -> None:
        self._new.clear()
        self._staged.clear()
        self._done = True
