"""Each stage against plain Python, on its own input."""

import re

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_native import counts, spans
from test_parity_join import brute

from quarry.llm.shared import table


def test_stages(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = table(spark, d, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    columns = docs.columns
    read = lambda df: {r.doc_id: r for r in df.collect()}
    before, frame = read(docs), docs
    after = []
    for name, stage in cp.STAGES:
        frame = cp.written(stage(spark, frame, d))
        if name != cp.STAGES[-1][0]:
            assert frame.columns == columns
            after.append(read(frame))
    classified, ruled, single, clean = after
    assert set(classified) < set(before) and all(labels.get(i) == 0 or labels.get(i) is None for i in set(before) - set(classified))
    assert sum(labels.get(i) == 0 for i in classified) <= 0.1 * sum(q == 0 for q in labels.values())
    assert all(not counts(r.text)[5] for r in ruled.values())
    lost = [i for i in set(classified) - set(ruled) if not counts(classified[i].text)[5]]
    assert sum(labels.get(i) == 1 for i in lost) <= 0.05 * len(labels)
    want = {i for i, _, c in brute([(i, r.text) for i, r in ruled.items()]) if i == c}
    assert set(single) == want
    assert set(clean) == set(single)
    for i, r in clean.items():
        old = single[i].text or ""
        if spans(old):
            assert "[SECRET]" in r.text and not re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", r.text) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (single[i].lang, single[i].source)
    rows = frame.collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {i: len((r.text or "").split()) + 1 for i, r in clean.items()}


def test_repeated_ids_keep_one_row(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text, "en", "s", 13), (1, text, "en", "s", 13), (2, text + " h", "en", "s", 15), (None, text, "en", "s", 13), (5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.one_of_each_group(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "5", "None"]  # seven and eight words share 3 of 4 shingles
    assert cp.without_secrets(spark, docs, "").count() == 5 and cp.packed(spark, docs, "").count() == 5
    empty = docs.limit(0)
    assert cp.one_of_each_group(spark, empty, "").count() == cp.without_secrets(spark, empty, "").count() == cp.packed(spark, empty, "").count() == 0


def test_rows_of_one_id_with_different_texts_stay(spark):
    one, two, three = "a b c d e f g", "the quick brown fox jumps over it", "some words that nobody else has written"
    rows = [(1, one), (1, two), (2, one + " h"), (3, one), (3, three), (4, two), (5, "x"), (5, "x"), (5, "y"), (5, None), (5, None), (6, three), (None, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.one_of_each_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, one), (1, two), (3, three), (5, "x"), (5, "y"), (5, None), (None, two)], key=str)


CLASH = ["_score", "score", "_clean", "_row", "_text", "kept", "carried", "_t", "base", "n_words", "lang.x", "hash", "grp", "row"]


def odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, None, "en", "s", None), (3, "w " * 200, "en", "s", 400), (3, "w " * 200, "en", "s", 400)]
    rows += [(10 + i, " ".join(f"word{(i * 7 + k * 3) % 500}" for k in range(80)) + " token=abcdef0123", None if i % 3 else "en", f"s{i}", 5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("map", F.create_map(F.lit("k"), F.col("doc_id")))
    d = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(10, 20)] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return docs, d


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    docs, d = odd_rows(spark, tmp_path)
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        got = cp.written(stage(spark, docs, d))
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        rows = got.collect()
        assert 0 < len(rows) <= docs.count()
        for r in rows:
            old = before[r.doc_id].asDict()
            new = r.asDict()
            if name == "secret scans":
                assert new.pop("text") == (old.pop("text") or "").replace("token=abcdef0123", "[SECRET]") or new == old | {"n_chars": new["n_chars"]} and r.text is None
                assert new.pop("n_chars") == (len(r.text) if r.text is not None else None)
                old.pop("n_chars"), old.pop("text", 0)
            assert new == old
    assert sorted(str(r.doc_id) for r in cp.within_rules(spark, docs, d).collect()) == sorted(str(10 + i) for i in range(12))
    assert sum(r.length for r in cp.packed(spark, docs, d).collect()) == sum(len((r.text or "").split()) + 1 for r in docs.collect())


def test_stages_take_empty_tables(spark, tmp_path):
    docs, d = odd_rows(spark, tmp_path)
    for name, stage in cp.STAGES:
        got = stage(spark, docs.limit(0), d)
        assert got.count() == 0 and (name == cp.STAGES[-1][0] or got.columns == docs.columns)
