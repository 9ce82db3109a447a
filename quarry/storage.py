"""Tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see, as a full
    URI: a path without a scheme lies in Spark's default file system.

    Where the setting is missing, a temporary folder is set for the session, but
    only on one machine: a cluster's executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path, store = _hadoop(spark, f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    _made.append(store.makeQualified(path).toString())
    return _made[-1]


def _hadoop(spark: SparkSession, uri: str) -> tuple[Any, Any]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost
    executor costs no more than the tasks that read it."""
    spark, path, schema = df.sparkSession, shared_dir(df.sparkSession), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in a partition for each core at least, for work that costs far more than
    moving the rows. A table of many files or blocks is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cleanup(spark: SparkSession) -> int:
    """Removes every folder that shared_dir() made in this process, results read from
    them included; how many there were. For callers who have kept what they need."""
    n = len(_made)
    while _made:
        path, store = _hadoop(spark, _made.pop())
        store.delete(path, True)
    return n
