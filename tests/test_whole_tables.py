"""Rules of the narrowed queries on every row of the table, against DuckDB."""

import duckdb
import pytest

from quarry.queries import _find


@pytest.mark.parametrize(
    "query, where",
    [
        ({"o_totalprice": {"$gt": 1000}, "o_custkey": {"$gte": 5.5, "$lte": 90.5}}, "o_totalprice > 1000 AND o_custkey >= 6 AND o_custkey <= 90"),
        ({"o_totalprice": {"$not": {"$bogus": 1}}}, "true"),
        ({"o_totalprice": {"$lt": "a string"}, "o_orderstatus": {"$gt": 5}, "$or": [{"o_orderkey": {"$lt": 2**70}}, {"o_orderkey": "7"}]}, "true"),
    ],
)
def test_without_key_ranges(spark, sf, query, where):
    d = sf.replace("0.001", "0.01")
    want = duckdb.execute(f"SELECT o_orderkey FROM read_parquet('{d}/orders.parquet') WHERE {where} ORDER BY 1").fetchall()
    got = sorted(tuple(r) for r in _find(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", query).frame().select("o_orderkey").collect())
    assert len(want) > 0 and got == want


def test_collect_without_limit(spark, sf):
    d = sf.replace("0.001", "0.01")
    want = duckdb.execute(f"SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) FROM read_parquet('{d}/orders.parquet') GROUP BY 1 ORDER BY 1").fetchall()
    got = _find(spark.read.parquet(f"{d}/orders.parquet"), "o_orderkey", {}).group("o_custkey").frame("collect", "o_orderkey").collect()
    assert len(want) > 60 and sorted((r["_id"], sorted(r["collect"])) for r in got) == want
