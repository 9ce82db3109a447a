"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import classifier, packing, parity_join, quality_rules, secrets
from quarry.llm.shared import table, written

#: Ids up to this number are broadcast to the scan that drops them; more are joined by shuffle.
BROADCAST_IDS = 100_000


def _carried(docs: DataFrame) -> Column:
    """A row of docs as one struct, whatever its columns are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones, whole rows.

    Null and empty texts get the intercept's score; without labels all scores are
    0.5 and all rows stay; equal texts share one fate, whatever their ids; an empty
    table gives none."""
    weights = classifier.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("text").alias("text"), _carried(docs))
    return classifier.score(rows, weights, name="score").where(F.col("score") >= classifier.THRESHOLD).select("carried.*")


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole rows.

    Null texts count as empty and go, as all texts of under 50 words do; a null lang
    is a stratum of its own; a ratio equal to its cutoff stays; repeated rows share
    one fate; an empty table gives none."""
    judged = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return judged.where("kept").select("carried.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id. Rows of
    one id are documents of their own, of which equal ones are one; null ids stay."""
    small = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = parity_join.near_duplicates(docs)
        gone = written(rows.where("doc_id <> component_id").select("doc_id"))
        return docs.join(small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # Ids that repeat: the rows are numbered, and the numbers take the place of the ids in the join.
    numbered = written(docs.select("doc_id", "text", _carried(docs), F.monotonically_increasing_id().alias("_row")))
    groups = parity_join.near_duplicates(numbered.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    named = numbered.where("doc_id is not null").select("_row", "doc_id", F.xxhash64("text").alias("_hash"))
    least = F.min(F.struct("doc_id", "_hash", "_row"))
    first = written(named.join(groups, "_row").groupBy("component_id").agg(least.alias("x")).select("x.*"))
    # Texts without a shingle are in no group, though they may be equal.
    again = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    equal = numbered.join(first.select("_row"), "_row", "left_semi").join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min("_row").alias("_row"))
    stay = first.join(again, "doc_id", "left_anti").select("_row").union(equal.select("_row")).union(numbered.where("doc_id is null").select("_row"))
    return numbered.join(written(stay), "_row", "left_semi").select("carried.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the secrets in their texts replaced; n_chars follows the text.
    Null texts stay null; repeated rows are changed alike; an empty table gives none."""
    found = secrets.scan(docs, carry=docs.columns)
    clean = found.select("carried", secrets.redact(F.col("carried.text"), F.concat("base", "added")).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.select(*[changed.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of the permitted lengths, in words. Null and
    empty texts are their end mark alone; repeated rows and null ids are pieces of
    their own; an empty table gives none."""
    return packing.pack(docs.select("doc_id", packing.word_length().alias("n")), "n")


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", within_rules),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Learned weights, similarity links and bins are beyond SQL; tests/llm hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
