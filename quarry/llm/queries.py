"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, classifier, itq, packing, parity_join, quality_rules, records, secrets, sharding, sql, warc_zip
from quarry.llm.shared import small_batches, table

#: Vocabulary of the tokenizing queries; a parameter of the operators.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents, law `bytes`. Nulls, ties, repeated rows, empty tables: as sharding says."""
    sharded = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document. Nulls, repeated rows and labels, empty tables: as classifier says."""
    scored = classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the record files, read back from them. Nulls, repeated rows, empty tables: as records says."""
    folder, manifest = records.write_tokens(table(spark, sf_dir, "documents"), VOCABULARY)
    return records.read_back(spark, folder, manifest)


def op5_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors. Odd vectors, repeated rows, null ids, empty tables: as itq says."""
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and components of all documents. Nulls, short and repeated texts, empty tables: as parity_join says."""
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives. Nulls, ties of ids, empty tables: as warc_zip says."""
    folder, parts = warc_zip.write_packages(table(spark, sf_dir, "pages"))
    return warc_zip.read_packages(spark, folder, parts)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins, by words and an end mark each. Nulls, repeated rows, empty tables: as packing says."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", packing.word_length().alias("n")), "n")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to. Nulls, empty texts and tables, repeated rows: as bpe says."""
    small_batches(spark)
    path = VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        v = bpe.vocabulary(path)
        for t in bpe.grouped(batches):
            doc_ids = t.column("doc_id").to_pylist()
            for which, ids, at in bpe.Encoded(t.column("text"), bpe.by_index(v)).parts():
                cuts = list(zip(at.tolist(), at[1:].tolist(), strict=False))
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_ids[k] for k in which.tolist()], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([sha(raw[4 * a : 4 * b]) for a, b in cuts], pa.string()),
                        pa.array([sha(bpe.decode(v, ids[a:b]).encode()) for a, b in cuts], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. Nulls, overlapping spans, repeated rows, empty tables: as secrets says."""
    found = secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_copied", "n_owned", "n_live")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Nulls, empty texts, labels that differ, empty tables: as quality_rules says."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard": op1_shard,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_records": op3_token_records,
    "op5_itq_near_dedup": op5_itq_near_dedup,
    "op6_parity_join": op6_parity_join,
    "op7_warc_zip": op7_warc_zip,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op4_secret_scan": op4_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}
SQL: dict[str, str] = {
    "op4_secret_scan": sql.secrets_sql(),
    "op5_itq_near_dedup": sql.VECTORS,
    "op6_parity_join": sql.JACCARD,
    "op7_warc_zip": sql.WARC,
    "op10_quality_rules": sql.rules_sql(),
}
