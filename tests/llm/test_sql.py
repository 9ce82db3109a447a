"""Queries of the operators that SQL can express against DuckDB."""

import math

import duckdb
import pytest

from quarry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    d = sf.replace("0.001", "0.01") if name != "op6_parity_join" else sf
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[c] for c in cols) for r in want), key=str)


def test_rules_equal_sql_where_cutoffs_exist(spark, tmp_path):
    d, words = str(tmp_path), [f"w{i}" for i in range(60)]
    good = [(i, " ".join(words[i % 7 :] + words[: i % 7]), "en") for i in range(1000)]
    bad = [(2000 + i, " ".join([*words, *["##########"] * 5, f"x{i}"]), "en") for i in range(100)]
    few = [(3000 + i, t, "fr") for i, (_, t, _) in enumerate(bad[:20])]
    spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, *_ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    rel = con.execute(SQL["op10_quality_rules"])
    names = [x[0] for x in rel.description]
    want = sorted(rel.fetchall())
    got = QUERIES["op10_quality_rules"](spark, d).select(*names).collect()
    assert sorted(map(tuple, got)) == want
    kept = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert all(kept[i] == (False, False) for i, *_ in bad)  # by a cutoff, not by the base rule
    assert all(kept[i] == (False, True) for i, *_ in good + few)


def test_vectors_equal_sql_where_links_exist(spark, tmp_path):
    d = str(tmp_path)
    at = [math.radians(25 * (i % 9) + i % 3) for i in range(120)]  # 18 degrees and less are linked
    rows = [(i, [math.cos(a), math.sin(a), 0.02 * (i % 4)], 0) for i, a in enumerate(at)] + [(500, None, 0), (501, [0.0, 0.0, 0.0], 0), (502, [1.0, float("nan"), 0.0], 0), (503, [1.0, 2.0], 0), (504, [2.0, 4.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet/*.parquet')")
    rel = con.execute(SQL["op5_itq_near_dedup"])
    names = [x[0] for x in rel.description]
    want = sorted(rel.fetchall())
    assert sum(r[names.index("n_links")] for r in want) > 100 and len({r[names.index("component_id")] for r in want}) > 5
    assert sorted(map(tuple, QUERIES["op5_itq_near_dedup"](spark, d).select(*names).collect())) == want
