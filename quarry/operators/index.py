"""Value indexes: a field's values with their ids, as a table of one snapshot."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans import dynamic, filters
from quarry.storage import written


class FieldIndex:
    """Rows (_id, v): the field's value, where a missing one counts as null.

    Rows of a typed column lie in files by ranges of the value, so a search reads
    those alone that may hold it; schemaless values are searched through. What the
    methods give are frames of ids; counts and yes or no are values."""

    def __init__(self, df: DataFrame, backend: Any, field: str) -> None:
        self.backend, self.field = backend, field
        rows = df.select(backend.id().alias("_id"), backend.value(field).alias("v"))
        if not backend.dynamic and self._orderable(rows):
            parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.repartitionByRange(parts, "v", "_id").sortWithinPartitions("v", "_id")
        self.rows = written(rows)

    @staticmethod
    def _orderable(rows: DataFrame) -> bool:
        return not any(x in rows.schema["v"].dataType.simpleString() for x in ("map<", "variant", "void"))

    def _ref(self, _: str) -> Any:
        if self.backend.dynamic:
            return dynamic.Variant(F.col("v"))
        return filters.Typed(F.col("v"), self.rows.schema["v"].dataType, self.backend.explicit) if self.field in self.backend.schema.names else filters.Absent()

    def _where(self, cond: Any) -> Column:
        return filters.column(filters.document(self._ref, {self.field: cond}))

    def ids_equal(self, value: Any) -> DataFrame:
        """Ids of the documents with this value; null finds those without the field too."""
        return self.rows.where(self._where({"$eq": value})).select("_id")

    def ids_range(self, low: Any = None, high: Any = None, low_included: bool = True, high_included: bool = False, low_open: bool = False, high_open: bool = False) -> DataFrame:
        """Ids of the documents with a value between low and high in the order of all
        values; low_open and high_open: without that bound."""
        cond: dict[str, Any] = {} if low_open else {"$gte" if low_included else "$gt": low}
        if not high_open:
            cond["$lte" if high_included else "$lt"] = high
        found = self._where(cond) if cond else F.lit(True)
        # A missing value counts as null, the least one.
        above = low_open or (low is None and low_included)
        below = high_open or high is not None or high_included
        if cond and above and below:
            found = F.coalesce(found, F.lit(False)) | self._where({"$exists": False})
        return self.rows.where(found).select("_id")

    def contains_value(self, value: Any) -> bool:
        return not self.ids_equal(value).isEmpty()

    def _key(self) -> Column:
        return dynamic.order_key(F.col("v"), True) if self.backend.dynamic else F.col("v")

    def distinct(self) -> int:
        """How many different values there are, null or missing as one of them."""
        return self.rows.agg(F.count_distinct(F.struct(self._key()))).first()[0]

    def iter(self) -> DataFrame:
        """(_id, v) in order of values, ties by id."""
        if self.backend.dynamic:
            return dynamic.with_key(self.rows, F.col("v"), "k").orderBy("k", "_id").select("_id", "v")
        return self.rows.orderBy(F.col("v").asc_nulls_first(), "_id")

    def __len__(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def memory_size(self) -> int:
        """Bytes as stats() reckons them."""
        return 16 * len(self)
