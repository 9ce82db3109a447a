"""The query chain: filter, sort, skip, limit, and what ends it."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans import dynamic

if TYPE_CHECKING:
    from quarry.operators.group import GroupQuery


@dataclass(frozen=True)
class Query:
    """Lazy: every method but the last of a chain only adds to the plan."""

    source: DataFrame
    backend: Any
    filter: Any
    sort_field: str | None = None
    sort_descending: bool = False
    skip_count: int = 0
    limit_count: int = 0

    def sort(self, field: str, descending: bool = False) -> Query:
        """By one field, ties by id; descending turns both around. A later call replaces it."""
        return replace(self, sort_field=field, sort_descending=descending)

    def skip(self, n: int) -> Query:
        return replace(self, skip_count=n)

    def limit(self, n: int) -> Query:
        """At most n documents after skip; 0 is no limit."""
        return replace(self, limit_count=n)

    def group(self, field: str) -> GroupQuery:
        from quarry.operators.group import GroupQuery

        return GroupQuery(self, field)

    def ordering(self) -> list[Column]:
        if self.sort_field is None:
            return [self.backend.order().asc()]
        key, own = self.backend.sort_key(self.sort_field), self.backend.id()
        return [key.desc_nulls_last(), own.desc()] if self.sort_descending else [key.asc_nulls_first(), own.asc()]

    def frame(self) -> DataFrame:
        """The documents that the chain selects. A sort with a limit is a bounded
        heap in each task; an unsorted stream is put in order only where skip or
        limit would make its rows depend on chance."""
        df = self.source.where(self.backend.predicate(self.filter))
        if self.sort_field is not None and self.backend.dynamic:
            columns = df.columns
            keyed, down = dynamic.with_key(df, self.backend.value(self.sort_field), "__key"), self.sort_descending
            key, own = F.col("__key"), self.backend.id()
            df = keyed.orderBy(*([key.desc(), own.desc()] if down else [key.asc(), own.asc()])).select(*columns)
        elif self.sort_field is not None or self.skip_count or self.limit_count:
            df = df.orderBy(*self.ordering())
        if self.skip_count:
            df = df.offset(self.skip_count)
        return df.limit(self.limit_count) if self.limit_count else df

    def to_list(self) -> list[dict]:
        return self.backend.documents(self.frame().collect())

    def first(self) -> dict | None:
        found = self.backend.documents(self.frame().limit(1).collect())
        return found[0] if found else None

    find_one = first

    def count(self) -> int:
        """Documents after skip and limit; needs no sort."""
        df = self.source.where(self.backend.predicate(self.filter))
        n = df.count()
        n = max(0, n - self.skip_count)
        return min(n, self.limit_count) if self.limit_count else n

    def count_frame(self) -> DataFrame:
        """count() as a frame of one row."""
        n = self.source.where(self.backend.predicate(self.filter)).agg(F.count(F.lit(1)).alias("n"))
        n = n.select(F.greatest(F.col("n") - self.skip_count, F.lit(0)).alias("n"))
        return n.select(F.least("n", F.lit(self.limit_count)).alias("n")) if self.limit_count else n

    def exists(self) -> bool:
        return not self.source.where(self.backend.predicate(self.filter)).isEmpty()
