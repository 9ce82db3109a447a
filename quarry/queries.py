"""Queries over the tables of a folder, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.query import Query
from quarry.sources.backends import DYNAMIC, TypedBackend, with_doc
from quarry.shipping import ship
from quarry.sources.collection import Collection, Store, write_parquet
from quarry.storage import shared_dir, spread, written
from quarry.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _find(df: DataFrame, key: str, query: Any, **policy: Any) -> Query:
    return Query(df, TypedBackend(df.schema, key, **policy), query)


def _filter(name: str, table: str, key: str, query: Any, sql: str, columns: str = "*", prepare: Callable[[SparkSession, str], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = prepare(spark, d) if prepare else _read(spark, d, table)
        return _find(df, key, query).frame().select(*columns.split(", "))

    QUERIES[name] = run
    SQL[name] = f"SELECT {columns} FROM {sql}"


_O, _OK = "o_orderkey, o_orderstatus, o_totalprice", "o_orderkey"
_L = "l_orderkey, l_linenumber, l_quantity, l_returnflag"
_filter("filter_eq", "lineitem", "l_orderkey", {"l_returnflag": "R", "l_linenumber": {"$eq": 3.0}}, "lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3", _L)
_filter("filter_ne", "orders", _OK, {"o_orderstatus": {"$ne": "O"}}, "orders WHERE o_orderstatus <> 'O'", _O)
_filter("filter_gt_gte_lt_lte", "orders", _OK, {"o_totalprice": {"$gt": 1000}, "o_custkey": {"$gte": 5.5}, "o_orderdate": {"$lt": datetime(1996, 1, 1)}, "o_orderstatus": {"$lte": "O"}}, "orders WHERE o_totalprice > 1000 AND o_custkey >= 6 AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <= 'O'", _O)
_filter("filter_range", "orders", _OK, {"o_totalprice": {"$gte": 100000, "$lt": 150000.5}}, "orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000.5::DOUBLE", _O)
_filter("filter_in", "lineitem", "l_orderkey", {"l_returnflag": {"$in": ["A", "R", 5]}, "l_linenumber": {"$in": [1, 3.0, 2.5, "x"]}}, "lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3)", _L)
_filter("filter_nin", "lineitem", "l_orderkey", {"l_returnflag": {"$nin": ["A", "R"]}, "l_linenumber": {"$nin": []}}, "lineitem WHERE l_returnflag NOT IN ('A', 'R')", _L)
_filter("filter_and", "lineitem", "l_orderkey", {"$and": [{"l_returnflag": "A"}, {"l_quantity": {"$gt": 30}}], "l_linenumber": {"$lt": 4}}, "lineitem WHERE l_returnflag = 'A' AND l_quantity > 30 AND l_linenumber < 4", _L)
_filter("filter_or", "lineitem", "l_orderkey", {"$or": [{"l_quantity": {"$lt": 3}}, {"l_linenumber": 7}, 5]}, "lineitem WHERE l_quantity < 3 OR l_linenumber = 7", _L)
_filter("filter_nested_logical", "lineitem", "l_orderkey", {"$or": [{"$and": [{"l_quantity": {"$gte": 45}}, {"$or": [{"l_returnflag": "R"}, {"l_linestatus": "F"}]}]}, {"$and": [{"l_linenumber": 2}, {"l_quantity": 1}]}]}, "lineitem WHERE (l_quantity >= 45 AND (l_returnflag = 'R' OR l_linestatus = 'F')) OR (l_linenumber = 2 AND l_quantity = 1)", _L)
_filter("filter_not", "orders", _OK, {"o_totalprice": {"$not": {"$gte": 50000, "$lt": 400000}}}, "orders WHERE NOT (o_totalprice >= 50000 AND o_totalprice < 400000)", _O)
_filter("filter_malformed", "orders", _OK, {"o_totalprice": {"$not": {"$bogus": 1}}, "$or": [{"$bogus": [{}]}, {"o_orderstatus": {"$bogus": 1}}, {"o_orderstatus": {"$ne": "P"}}, {"o_custkey": {"$in": 7}}]}, "orders WHERE o_orderstatus <> 'P'", _O)
_filter("filter_cross_type", "orders", _OK, {"o_totalprice": {"$lt": "a string"}, "o_orderstatus": {"$gt": 5}, "o_custkey": {"$not": {"$gt": "a string"}}, "$or": [{"o_orderkey": {"$lt": 2**70}}, {"o_orderkey": "7"}]}, "orders", _O)


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(_read(spark, d, "labels"), "doc_id", "left")


_LJ = "(SELECT d.doc_id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_DQ = "doc_id, quality, toxic"
for _name, _query, _where in (
    ("filter_in_null", {"quality": {"$in": [0, None]}}, "quality = 0 OR quality IS NULL"),
    ("filter_nin_null", {"quality": {"$nin": [0, None]}}, "quality <> 0 AND quality IS NOT NULL"),
    ("filter_not_missing", {"quality": {"$not": {"$gt": 0}}}, "NOT coalesce(quality > 0, false)"),
    ("filter_ne_missing", {"toxic": {"$ne": 1}}, "toxic IS NULL OR toxic <> 1"),
    ("filter_eq_null", {"toxic": {"$eq": None}}, "toxic IS NULL"),
    ("filter_exists_true", {"quality": {"$exists": True}, "doc_id": {"$exists": True}}, "quality IS NOT NULL"),
    ("filter_exists_false", {"quality": {"$exists": False}, "nowhere": {"$exists": False}}, "quality IS NULL"),
    ("filter_absent_column", {"nowhere": {"$ne": 3}, "$or": [{"nowhere": None}, {"quality": 1}]}, "quality = 1"),
):
    _filter(_name, "", "doc_id", _query, f"{_LJ} t WHERE {_where}", _DQ, _labelled)


def _with_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))).alias("items"))
    return lines.withColumn("numbers", F.transform("items", lambda x: x["n"]))


_EL = "(SELECT l_orderkey AS o_orderkey, list({'n': l_linenumber, 'q': l_quantity, 'flag': l_returnflag}) AS items, list(l_linenumber) AS numbers FROM lineitem GROUP BY l_orderkey) t WHERE "
_filter("elem_direct", "", _OK, {"numbers": {"$elemMatch": 6}}, _EL + "list_contains(numbers, 6)", "o_orderkey", _with_lines)
_filter("elem_op", "", _OK, {"numbers": {"$elemMatch": {"$gt": 4, "$lt": 6.5}}}, _EL + "len(list_filter(numbers, lambda e: e > 4 AND e < 6.5)) > 0", "o_orderkey", _with_lines)
_filter("elem_subdoc", "", _OK, {"items": {"$elemMatch": {"q": {"$gte": 48}, "flag": {"$in": ["A", "R"]}, "$or": [{"n": 1}, {"n": {"$gt": 3}}]}}}, _EL + "len(list_filter(items, lambda e: e.q >= 48 AND e.flag IN ('A', 'R') AND (e.n = 1 OR e.n > 3))) > 0", "o_orderkey", _with_lines)
_filter("elem_vector", "embeddings", "vec_id", {"embedding": {"$elemMatch": {"$gt": 0.4}}}, "embeddings WHERE len(list_filter(embedding, lambda e: e::DOUBLE > 0.4::DOUBLE)) > 0", "vec_id, label")


def _chain(name: str, table: str, columns: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, d: build(_read(spark, d, table)).select(*columns.split(", "))
    SQL[name] = f"SELECT {columns} FROM {sql}"


_C = "c_custkey, c_mktsegment, c_acctbal"
_chain("sort_limit", "orders", _O, lambda o: _find(o, _OK, {"o_totalprice": {"$gte": 100000}}).sort("o_totalprice", True).limit(20).frame(), "orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
_chain("sort_desc_skip_limit", "customer", _C, lambda c: _find(c, "c_custkey", {}).sort("c_mktsegment", True).skip(15).limit(25).frame(), "customer ORDER BY c_mktsegment DESC, c_custkey DESC LIMIT 25 OFFSET 15")
_chain("sort_asc_ties", "lineitem", "l_orderkey, l_quantity", lambda x: _find(x.groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity")), "l_orderkey", {}).sort("l_quantity").skip(3).limit(50).frame(), "(SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey) t ORDER BY l_quantity, l_orderkey LIMIT 50 OFFSET 3")
QUERIES["sort_missing"] = lambda spark, d: _find(_labelled(spark, d), "doc_id", {}).sort("quality").limit(30).frame().select("doc_id", "quality")
SQL["sort_missing"] = f"SELECT doc_id, quality FROM {_LJ} t ORDER BY quality NULLS FIRST, doc_id LIMIT 30"
QUERIES["sort_missing_desc"] = lambda spark, d: _find(_labelled(spark, d), "doc_id", {"n_chars": {"$lt": 2000}}).sort("quality", True).limit(40).frame().select("doc_id", "quality")
SQL["sort_missing_desc"] = f"SELECT doc_id, quality FROM {_LJ} t WHERE n_chars < 2000 ORDER BY quality DESC NULLS LAST, doc_id DESC LIMIT 40"
QUERIES["count_pipeline"] = lambda spark, d: _find(_read(spark, d, "orders"), _OK, {"o_orderstatus": "O"}).sort("o_totalprice").skip(100).limit(3000).count_frame()
SQL["count_pipeline"] = "SELECT least(greatest(count(*) - 100, 0), 3000) AS n FROM orders WHERE o_orderstatus = 'O'"


def _exists(spark: SparkSession, d: str) -> DataFrame:
    orders = Collection(spark, "orders", _read(spark, d, "orders"), _OK)
    return spark.createDataFrame([("dear", orders.exists({"o_totalprice": {"$gt": 1e12}})), ("open", orders.exists({"o_orderstatus": "O"})), ("all", orders.exists())], "asked string, found boolean")


QUERIES["exists"] = _exists
SQL["exists"] = "SELECT 'dear' AS asked, count(*) > 0 AS found FROM orders WHERE o_totalprice > 1e12 UNION ALL SELECT 'open', count(*) > 0 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'all', count(*) > 0 FROM orders"


def _in_place(spark: SparkSession, d: str) -> DataFrame:
    """What to_list() gives, with each document's place in it."""
    found = _find(_read(spark, d, "customer"), "c_custkey", {"c_acctbal": {"$lt": 2000}}).sort("c_nationkey", True).to_list()
    return spark.createDataFrame([(i, r["c_custkey"], r["c_nationkey"]) for i, r in enumerate(found)], "place long, c_custkey long, c_nationkey int")


QUERIES["sort_places"] = _in_place
SQL["sort_places"] = "SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey DESC) - 1 AS place, c_custkey, c_nationkey FROM customer WHERE c_acctbal < 2000"
QUERIES["find_one"] = lambda spark, d: _find(_read(spark, d, "orders"), _OK, {"o_custkey": {"$gt": 20}}).sort("o_orderdate").limit(1).frame().select("o_orderkey", "o_custkey")
SQL["find_one"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 20 ORDER BY o_orderdate, o_orderkey LIMIT 1"
QUERIES["primary_key_get"] = lambda spark, d: _find(_read(spark, d, "customer"), "c_custkey", {"c_custkey": 77}).limit(1).frame().select(*_C.split(", "))
SQL["primary_key_get"] = f"SELECT {_C} FROM customer WHERE c_custkey = 77"


def _group(name: str, table: str, key: str, field: str, fn: str, value: str, expression: str, where: Any = None, sql_where: str = "true", rounded: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _find(_read(spark, d, table), key, where or {}).group(field).frame(fn, value)
        return df.select(F.col("_id").alias("id"), (F.round(fn, 4) if rounded else F.col(fn)).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"SELECT {field} AS id, {expression} AS value FROM {table} WHERE {sql_where} GROUP BY {field}"


_group("group_count", "lineitem", "l_orderkey", "l_returnflag", "count", "l_quantity", "count(*)")
_group("group_sum", "lineitem", "l_orderkey", "l_returnflag", "sum", "l_orderkey", "sum(l_orderkey)::BIGINT")
_group("group_sum_float", "lineitem", "l_orderkey", "l_linestatus", "sum", "l_extendedprice", "round(sum(l_extendedprice), 4)", rounded=True)
_group("group_mean", "lineitem", "l_orderkey", "l_returnflag", "mean", "l_quantity", "round(avg(l_quantity), 4)", rounded=True)
_group("group_min", "events", "event_id", "event_type", "min", "value", "min(value)")
_group("group_max", "events", "event_id", "event_type", "max", "user_id", "max(user_id)", {"value": {"$lt": 20}}, "value < 20")
_group("group_first", "events", "event_id", "event_type", "first", "user_id", "arg_min(user_id, event_id)")
_group("group_last", "events", "event_id", "event_type", "last", "value", "arg_max(value, event_id)")


def _collect(spark: SparkSession, d: str) -> DataFrame:
    df = _find(_read(spark, d, "orders"), _OK, {}).sort("o_totalprice", True).group("o_custkey").frame("collect", "o_orderkey")
    return df.select(F.col("_id").alias("id"), F.array_join("collect", ",").alias("value"))


QUERIES["group_collect"] = _collect
SQL["group_collect"] = "SELECT o_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey DESC) AS value FROM orders GROUP BY o_custkey"


def _group_places(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order in which they come without a sort."""
    rows = _find(_labelled(spark, d), "doc_id", {}).group("quality").agg("count")
    return spark.createDataFrame([(i, r["_id"], r["count"]) for i, r in enumerate(rows)], "place long, id int, count long")


QUERIES["group_places"] = _group_places
SQL["group_places"] = f"SELECT row_number() OVER (ORDER BY quality NULLS FIRST) - 1 AS place, quality AS id, count(*) AS count FROM {_LJ} t GROUP BY quality"
QUERIES["group_pipeline"] = lambda spark, d: _find(_read(spark, d, "orders"), _OK, {"o_orderstatus": {"$ne": "P"}}).sort("o_totalprice").skip(10).limit(200).group("o_orderpriority").frame("count").withColumnRenamed("_id", "id")
SQL["group_pipeline"] = "SELECT o_orderpriority AS id, count(*) AS count FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice, o_orderkey LIMIT 200 OFFSET 10) t GROUP BY o_orderpriority"
QUERIES["group_sort_limit"] = lambda spark, d: _find(_read(spark, d, "orders"), _OK, {}).group("o_custkey").sort("count", True).limit(10).frame("count").withColumnRenamed("_id", "id")
SQL["group_sort_limit"] = "SELECT o_custkey AS id, count(*) AS count FROM orders GROUP BY o_custkey ORDER BY count DESC, id DESC LIMIT 10"
QUERIES["group_missing"] = lambda spark, d: _find(_labelled(spark, d), "doc_id", {}).group("quality").frame("sum", "n_chars").withColumnRenamed("_id", "id")
SQL["group_missing"] = f"SELECT quality AS id, sum(n_chars)::BIGINT AS sum FROM {_LJ} t GROUP BY quality"
QUERIES["group_distinct_fields"] = lambda spark, d: Collection(spark, "orders", _read(spark, d, "orders"), _OK).stats_frame()
SQL["group_distinct_fields"] = "SELECT 'o_orderkey' AS field, count(*) AS entries, count(DISTINCT o_orderkey) AS distinct FROM orders"


def _stats(spark: SparkSession, d: str) -> DataFrame:
    c = Collection(spark, "docs", _labelled(spark, d), "doc_id")
    c.create_index("quality")
    c.create_index("lang")
    return c.stats_frame()


QUERIES["stats"] = _stats
SQL["stats"] = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS entries, count(DISTINCT {f}) + max(({f} IS NULL)::INT) AS distinct FROM {_LJ} t" for f in ("doc_id", "quality", "lang"))

VECTOR = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
_QV = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"
WORDS = "things tions from"
#: Tokens of the tables that have the stems of WORDS.
_STEMS = {"thing": ("thing", "things", "thinges", "thinging", "thinged"), "tion": ("tion", "tions", "tioned", "tioning", "tiones"), "from": ("from", "froms", "fromes", "froming", "fromed")}


#: Collections of this process by application, folder and name: as in a store, indexes serve many searches.
_held: dict[tuple[str, str, str], Collection] = {}


def held(spark: SparkSession, d: str, name: str) -> Collection:
    """A collection that the search queries share, with its indexes."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _held:
        if name == "vectors":
            c = Collection(spark, name, _read(spark, d, "embeddings"), "vec_id")
            c.create_vector_index("embedding", 64)
        elif name == "texts":
            c = Collection(spark, name, _read(spark, d, "documents"), "doc_id")
            c.create_text_index("text")
        elif name == "talks":
            turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
            c = Collection(spark, name, _read(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns")), "conv_id")
            c.create_text_index("turns")
        else:
            docs = _read(spark, d, "documents").select("doc_id", "text").join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
            c = Collection(spark, name, docs, "doc_id")
            c.create_text_index("text")
            c.create_vector_index("embedding", 64)
        _held[key] = c
    return _held[key]


def _vectors(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return held(spark, d, "vectors").vector_scores("embedding", VECTOR, limit)


QUERIES["vector_topk"] = lambda spark, d: _vectors(spark, d, 10).select(F.col("_id").alias("vec_id"), F.round(F.col("score").cast("double"), 4).alias("score"))
SQL["vector_topk"] = f"SELECT vec_id, round(s, 4) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {_QV}) AS s FROM embeddings) t ORDER BY s DESC, vec_id LIMIT 10"
QUERIES["vector_all_rank"] = lambda spark, d: _vectors(spark, d, 0).select(F.col("_id").alias("vec_id"), F.round(F.col("score").cast("double"), 3).alias("score"))
SQL["vector_all_rank"] = f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QV}), 3) AS score FROM embeddings"


def _texts(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return held(spark, d, "texts").text_scores("text", WORDS, limit)


_VALUES = ", ".join(f"('{t}', '{s}')" for s, ts in _STEMS.items() for t in ts)
_BM25 = f"""
WITH stems(token, stem) AS (VALUES {_VALUES}),
tok AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t)) AS ts FROM documents WHERE text IS NOT NULL),
len AS (SELECT doc_id, len(ts)::DOUBLE AS dl FROM tok),
tot AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT doc_id, stem, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM tok) x JOIN stems USING (token) GROUP BY doc_id, stem),
df AS (SELECT stem, count(*)::DOUBLE AS df FROM tf GROUP BY stem),
bm AS (SELECT doc_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM tf JOIN df USING (stem) JOIN len USING (doc_id) CROSS JOIN tot GROUP BY doc_id)
"""
QUERIES["text_bm25"] = lambda spark, d: _texts(spark, d, 0).select(F.col("_id").alias("doc_id"), F.round("score", 6).alias("score"))
SQL["text_bm25"] = _BM25 + "SELECT doc_id, round(score, 6) AS score FROM bm WHERE score > 0"
QUERIES["text_topk"] = lambda spark, d: _texts(spark, d, 10).select(F.col("_id").alias("doc_id"), F.round("score", 6).alias("score"))
SQL["text_topk"] = _BM25 + "SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 10) t"


def _array_texts(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "talks").text_scores("turns", "things", 0).select(F.col("_id").alias("conv_id"), F.round("score", 6).alias("score"))


QUERIES["text_array"] = _array_texts
SQL["text_array"] = _BM25.replace("SELECT doc_id, list_transform(regexp_extract_all(text,", "SELECT conv_id AS doc_id, list_transform(regexp_extract_all(text,").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT conv_id, string_agg(coalesce(text, ''), ' ') AS text FROM conversations GROUP BY conv_id) c").replace(_VALUES, ", ".join(f"('{t}', 'thing')" for t in _STEMS["thing"])) + "SELECT doc_id AS conv_id, round(score, 6) AS score FROM bm WHERE score > 0"


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return held(spark, d, "both").hybrid_scores("text", "embedding", WORDS, VECTOR, 20).select(F.col("_id").alias("doc_id"), F.round("score", 9).alias("score"))


QUERIES["hybrid_rrf"] = _hybrid
SQL["hybrid_rrf"] = _BM25.rstrip() + f""",
v AS (SELECT d.doc_id, list_cosine_similarity(embedding::DOUBLE[], {_QV}) AS s FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
parts AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM bm WHERE score > 0
          UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, doc_id)) FROM v),
f AS (SELECT doc_id, sum(p) AS score FROM parts GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score FROM (SELECT * FROM f ORDER BY score DESC, doc_id LIMIT 20) t"""


#: Texts by the event's id, of words whose stems do not begin as they do or end in y.
_Y_TEXTS = ("a wide eyed", "flies, ies and dyed", "fly by eyed eyes EYED", "say yes")
_Y_CASE = "CASE event_id % 4 " + " ".join(f"WHEN {i} THEN '{t} '" for i, t in enumerate(_Y_TEXTS)) + " END"
_Y_STEMS = {"ei": ("eyed",), "i": ("ies",), "fly": ("fly",)}


def _y_texts(spark: SparkSession, d: str) -> DataFrame:
    df = _read(spark, d, "events").select("event_id", F.concat(F.expr(_Y_CASE), "event_type").alias("text"))
    c = Collection(spark, "events", df, "event_id")
    c.create_text_index("text")
    return c.text_scores("text", "Eyed ies fly").select(F.col("_id").alias("event_id"), F.round("score", 6).alias("score"))


QUERIES["text_y_stems"] = _y_texts
SQL["text_y_stems"] = _BM25.replace("doc_id", "event_id").replace("FROM documents WHERE text IS NOT NULL", f"FROM (SELECT event_id, {_Y_CASE} || event_type AS text FROM events) e").replace(_VALUES, ", ".join(f"('{t}', '{x}')" for x, ts in _Y_STEMS.items() for t in ts)) + "SELECT event_id, round(score, 6) AS score FROM bm WHERE score > 0"


def _customers(spark: SparkSession, d: str) -> Collection:
    return Collection(spark, "customer", _read(spark, d, "customer"), "c_custkey")


def _write(name: str, act: Callable[[Collection], Any], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = _customers(spark, d)
        act(c)
        return c.frame.select(*_C.split(", "))

    QUERIES[name] = run
    SQL[name] = sql


_new = [{"c_custkey": 10**9 + i, "c_name": f"new {i}", "c_nationkey": i, "c_acctbal": i / 4, "c_mktsegment": None if i == 2 else "NEW"} for i in range(4)]
_NEW = " UNION ALL ".join(f"SELECT {r['c_custkey']}::BIGINT, {'NULL' if r['c_mktsegment'] is None else repr(r['c_mktsegment'])}::VARCHAR, {r['c_acctbal']}::DOUBLE" for r in _new)
_write("update_set", lambda c: c.update_many({"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "DEBT", "c_acctbal": 0.0}}), "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
_write("update_inc", lambda c: c.update_many({"c_mktsegment": "BUILDING"}, {"$inc": {"c_acctbal": 10.5}}), "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer")
_write("update_unset", lambda c: c.update_many({"c_custkey": {"$lte": 50}}, {"$unset": ["c_mktsegment"]}), "SELECT c_custkey, CASE WHEN c_custkey > 50 THEN c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
_write("update_one", lambda c: c.update_one({"c_mktsegment": "MACHINERY"}, {"$set": {"c_mktsegment": "FIRST"}}), "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY') THEN 'FIRST' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
_write("replace_one", lambda c: c.replace_one({"c_custkey": 33}, {"c_mktsegment": "ALL NEW"}), "SELECT c_custkey, CASE WHEN c_custkey = 33 THEN 'ALL NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 33 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
_write("delete_one", lambda c: c.delete_one({"c_acctbal": {"$gt": 100}}), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 100)")
_write("delete_many", lambda c: c.delete_many({"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}), "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_write("insert_many", lambda c: c.insert_many(_new), f"SELECT c_custkey, c_mktsegment, c_acctbal FROM customer UNION ALL {_NEW}")


_CUSTOMERS = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
_write("insert_one", lambda c: c.insert(_new[1]), f"{_CUSTOMERS} UNION ALL SELECT {_new[1]['c_custkey']}::BIGINT, 'NEW', 0.25::DOUBLE")
_write("insert_frame", lambda c: c.insert_frame(c.frame.select((F.col("c_custkey") + 10**9).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", F.lit("COPY").alias("c_mktsegment"))), f"{_CUSTOMERS} UNION ALL SELECT c_custkey + 1000000000, 'COPY', c_acctbal FROM customer")
_write("set_doc", lambda c: (c.set_doc(12, {"c_mktsegment": "SET"}), c.set_doc(-1, {"c_mktsegment": "NO"})), "SELECT c_custkey, CASE WHEN c_custkey = 12 THEN 'SET' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 12 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
_write("remove_doc", lambda c: (c.remove_doc(12), c.remove_doc(-1)), f"{_CUSTOMERS} WHERE c_custkey <> 12")


def _batch(c: Collection) -> None:
    t = c.begin()
    t.insert_many(_new)
    t.update({"c_custkey": {"$lt": 5}}, {"$set": {"c_mktsegment": "LOW"}})
    t.delete({"c_custkey": {"$gte": 5, "$lt": 9}})
    t.update({"c_custkey": 2}, {"$set": {"c_mktsegment": "TWO"}})
    t.commit()


def _batch_replace(c: Collection) -> None:
    t = c.begin()
    t.update({"c_acctbal": {"$lt": 0}}, {"$set": {"c_mktsegment": "DEBT"}})
    t.replace({"c_custkey": 21}, {"c_acctbal": 21.5})
    t.insert(_new[3])
    t.commit()


def _batch_rollback(c: Collection) -> None:
    t = c.begin()
    t.insert(_new[0])
    t.delete({})
    t.rollback()


_write("batch_replace", _batch_replace, f"SELECT c_custkey, CASE WHEN c_custkey = 21 THEN NULL WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 21 THEN 21.5 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT {_new[3]['c_custkey']}::BIGINT, 'NEW', 0.75::DOUBLE")
_write("batch_rollback", _batch_rollback, _CUSTOMERS)
_write("batch_commit", _batch, f"SELECT c_custkey, CASE WHEN c_custkey = 2 THEN 'TWO' WHEN c_custkey < 5 THEN 'LOW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE NOT (c_custkey >= 5 AND c_custkey < 9) UNION ALL {_NEW}")


def _documents(spark: SparkSession, d: str) -> Collection:
    """Schemaless documents: a number or a string by the event's id, missing for some, with the props."""
    e = _read(spark, d, "events")
    kind = F.col("event_id") % 4
    v = F.when(kind == 0, F.to_json(F.struct(F.col("user_id").alias("v")))).when(kind == 1, F.to_json(F.struct(F.col("event_type").alias("v")))).when(kind == 2, F.lit('{"v":null}')).otherwise(F.lit("{}"))
    body = F.concat(F.lit('{"_id":"'), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit('","type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.when(v == "{}", F.lit("")).otherwise(F.concat(F.lit(","), F.substring(v, 2, 1000), F.lit(""))), F.when(v == "{}", F.lit("}")).otherwise(F.lit("")))
    rows = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("_id"), F.col("event_id").alias("seq"), body.alias("json"))
    key = (spark.sparkContext.applicationId, d, "documents")
    if key not in _held:  # written once, with the parsed documents
        _held[key] = Collection(spark, "events")
        _held[key].frame = written(with_doc(spread(rows.select(*DYNAMIC.names))))
    c = Collection(spark, "events")
    c.frame = _held[key].frame
    return c


_DYN = "(SELECT lpad(event_id::VARCHAR, 12, '0') AS id, event_type, user_id, event_id, event_id % 4 AS kind, (props->>'k')::BIGINT AS k FROM events) t"


def _dynamic(name: str, query: Any, where: str) -> None:
    QUERIES[name] = lambda spark, d: _documents(spark, d).find(query).frame().select(F.col("_id").alias("id"))
    SQL[name] = f"SELECT id FROM {_DYN} WHERE {where}"


_dynamic("dyn_filter", {"v": {"$gte": 30}, "type": {"$ne": "view"}}, "((kind = 0 AND user_id >= 30) OR kind = 1) AND event_type <> 'view'")
_dynamic("dyn_filter_null", {"v": {"$in": [None, 7.0]}}, "kind IN (2, 3) OR (kind = 0 AND user_id = 7)")
_dynamic("dyn_exists", {"v": {"$exists": True, "$lt": "m"}}, "kind IN (0, 2) OR (kind = 1 AND event_type < 'm')")
_dynamic("dyn_subdocument", {"props": {"k": 42}}, "k = 42")
QUERIES["dyn_group"] = lambda spark, d: _documents(spark, d).find({}).group("type").frame("sum", "v").select(F.col("_id").cast("string").alias("id"), F.col("sum").cast("long").alias("sum"))
SQL["dyn_group"] = f"SELECT event_type AS id, sum(CASE WHEN kind = 0 THEN user_id ELSE 0 END)::BIGINT AS sum FROM {_DYN} GROUP BY event_type"
QUERIES["dyn_sort"] = lambda spark, d: _documents(spark, d).find({}).sort("v", True).skip(5).limit(60).frame().select(F.col("_id").alias("id"))
SQL["dyn_sort"] = f"SELECT id FROM {_DYN} ORDER BY CASE kind WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 0 END DESC, CASE WHEN kind = 0 THEN user_id END DESC NULLS LAST, CASE WHEN kind = 1 THEN event_type END DESC NULLS LAST, id DESC LIMIT 60 OFFSET 5"


def _dynamic_update(spark: SparkSession, d: str) -> DataFrame:
    c = _documents(spark, d)
    c.update_many({"type": "click"}, {"$set": {"props.seen[0].by": "me"}, "$inc": {"props.k": 5, "n": 1}, "$unset": ["v"]})
    doc = F.col("doc")
    return c.frame.select(F.col("_id").alias("id"), F.try_variant_get(doc, "$.props.k", "bigint").alias("k"), F.try_variant_get(doc, "$.props.seen[0].by", "string").alias("seen"), F.try_variant_get(doc, "$.n", "bigint").alias("n"))


QUERIES["dyn_update"] = _dynamic_update
SQL["dyn_update"] = f"SELECT id, CASE WHEN event_type = 'click' THEN k + 5 ELSE k END AS k, CASE WHEN event_type = 'click' THEN 'me' END AS seen, CASE WHEN event_type = 'click' THEN 1::BIGINT END AS n FROM {_DYN}"


def _read_json(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines in the shared folder, read as schemaless documents."""
    e = _read(spark, d, "events")
    line = F.to_json(F.struct(F.concat(F.lit("e"), "event_id").alias("_id"), "event_type", "value", "user_id"))
    path = shared_dir(spark)
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(line, F.lit("\n"))).otherwise(line)).write.text(path)
    c = Store(spark).read_json("events", path)
    doc = F.col("doc")
    return c.find({"value": {"$gte": 20}, "event_type": {"$in": ["click", "view"]}}).frame().select("_id", F.try_variant_get(doc, "$.user_id", "bigint").alias("user_id"), F.try_variant_get(doc, "$.value", "double").alias("value"))


QUERIES["read_json"] = _read_json
SQL["read_json"] = "SELECT 'e' || event_id AS _id, user_id, value FROM events WHERE value >= 20 AND event_type IN ('click', 'view')"


def _write_parquet(spark: SparkSession, d: str) -> DataFrame:
    """A result to files, and the files as a collection."""
    path = shared_dir(spark)
    write_parquet(_find(_read(spark, d, "customer"), "c_custkey", {"c_acctbal": {"$gt": 5000}}).frame(), path)
    return Store(spark).read_parquet("rich", path, "c_custkey").find({"c_mktsegment": {"$ne": "BUILDING"}}).frame().select(*_C.split(", "))


QUERIES["write_parquet"] = _write_parquet
SQL["write_parquet"] = f"{_CUSTOMERS} WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of files into a collection that has some of their rows already."""
    customers = _read(spark, d, "customer")
    path = shared_dir(spark)
    customers.repartition(3).write.parquet(path)
    c = Collection(spark, "customer", customers.where("c_custkey % 7 = 0").withColumn("c_mktsegment", F.lit("HAD")), "c_custkey")
    ingest(spark.readStream.schema(customers.schema).option("maxFilesPerTrigger", 2).parquet(path), c, shared_dir(spark)).awaitTermination()
    return c.frame.select(*_C.split(", "))


QUERIES["stream_ingest"] = _stream
SQL["stream_ingest"] = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'HAD' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer"


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """A search by an indexed column, and the ids of a range of its values."""
    c = Collection(spark, "orders", _read(spark, d, "orders"), _OK)
    c.create_index("o_custkey")
    found = c.find({"o_custkey": {"$gte": 20, "$lt": 40}, "o_orderstatus": {"$ne": "P"}}).frame().select("o_orderkey", F.lit("find").alias("by"))
    return found.unionByName(c.index("o_custkey").ids_range(20, 40).select(F.col("_id").alias("o_orderkey"), F.lit("range").alias("by")))


QUERIES["index_range"] = _indexed
SQL["index_range"] = "SELECT o_orderkey, 'find' AS by FROM orders WHERE o_custkey >= 20 AND o_custkey < 40 AND o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'range' FROM orders WHERE o_custkey >= 20 AND o_custkey < 40"


def _missing(spark: SparkSession, d: str) -> DataFrame:
    """What a collection that nobody made answers."""
    c = Store(spark).collection("none")
    return spark.createDataFrame([(c.count(), c.exists(), len(c.find().to_list()), len(c.find().group("x").agg("count")), c.stats()["docs"])], "n long, found boolean, listed long, groups long, docs long")


QUERIES["missing_collection"] = _missing
SQL["missing_collection"] = "SELECT 0::BIGINT AS n, false AS found, 0::BIGINT AS listed, 0::BIGINT AS groups, 0::BIGINT AS docs"
