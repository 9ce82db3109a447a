"""Reciprocal rank fusion of a text and a vector ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import written

RRF_K = 60


def ranked(scores: DataFrame) -> DataFrame:
    """(_id, rank) from 1 on, best score first, ties by id.

    Rows are dealt to tasks by ranges and written with their range's number, so that
    no later computation finds them in another one. Each range's rows are numbered on
    their own and begin where the counts of the ranges before it end: no task holds
    the whole ranking."""
    ranges = scores.sparkSession.conf.get("spark.sql.shuffle.partitions")
    split = written(scores.select("_id", "score").repartitionByRange(int(ranges), F.desc("score"), F.asc("_id")).withColumn("part", F.spark_partition_id()))
    counts = split.groupBy("part").agg(F.count(F.lit(1)).alias("c"))  # one row per range
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("score"), F.asc("_id")))
    return split.withColumn("own", own).join(F.broadcast(before), "part").select("_id", (F.col("before") + F.col("own")).alias("rank"))


def fused(text: DataFrame, vector: DataFrame) -> DataFrame:
    """(_id, score): the sum over both rankings of 1 / (60 + rank)."""
    part = lambda r: ranked(r).select("_id", (F.lit(1.0) / (F.col("rank") + RRF_K)).alias("part"))
    return part(text).unionByName(part(vector)).groupBy("_id").agg(F.sum("part").alias("score"))
