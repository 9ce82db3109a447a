"""Order keys of containers, from their JSON text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from quarry.functions.values import order_bytes


def container_key(text: Column) -> Column:
    """Bytes that order values of JSON text; NULL for NULL. Needed only where an
    array or an object is compared as a whole."""

    @arrow_udf("binary")
    def key(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else order_bytes(json.loads(x)) for x in column.to_pylist()], pa.binary())

    return key(text)
