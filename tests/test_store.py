"""Collections: the fixtures' scenarios, writes, batches, search and figures."""

import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from matcher import MISSING, matches
from pyspark.sql import functions as F

from quarry.errors import Conflict, DuplicateId, IdMismatch, IdMustBeString, InvalidUpdate, NoIndex, NoMatch, NotAnObject, PrimaryIndex, StoreError, VectorDimMismatch
from quarry.functions import paths
from quarry.functions.stemmer import stem, tokens
from quarry.functions.values import order_bytes
from quarry.operators.group import function_name
from quarry.sources.collection import CHECKPOINT_EVERY, Collection, Store, write_parquet
from quarry.streaming.ingest import ingest


def made(spark, docs, name="c"):
    c = Collection(spark, name)
    c.insert_many(docs)
    return c


def ids_of(query):
    return sorted(d["id"] for d in query.to_list())


def ids(query):
    return [d["_id"] for d in query.to_list()]


def drawn(seed, n, **fields):
    """Documents with ids d00.. and each field drawn from its values; MISSING leaves it out."""
    rng = random.Random(seed)
    return [{"_id": f"d{i:02d}"} | {f: v for f, values in fields.items() if (v := rng.choice(values)) is not MISSING} for i in range(n)]


def in_order(docs, field, down=False):
    return sorted(docs, key=lambda d: (order_bytes(d.get(field)), d["_id"]), reverse=down)


def names(docs):
    return [d["_id"] for d in docs]


STATIONS = drawn(4, 30, height=[0, 25, 50, 75, 400, 1200], zone=["coast", "plain", "hill"], manned=[True, False])


@pytest.fixture(scope="module")
def stations(spark):
    return made(spark, STATIONS)


def test_sort_skip_limit(stations):
    up, down = names(in_order(STATIONS, "height")), names(in_order(STATIONS, "height", True))
    assert ids(stations.find().sort("height")) == up and ids(stations.find().sort("height", True)) == down == up[::-1]
    assert ids(stations.find().sort("height").skip(4).limit(9)) == up[4:13]
    query = {"height": {"$gte": 25, "$lt": 400}, "manned": True}
    want = [d for d in STATIONS if matches(d, query)]
    assert 0 < len(want) < 30 and sorted(ids(stations.find(query))) == sorted(names(want))
    assert stations.find(query).skip(2).count() == len(want) - 2 and stations.count(query) == len(want)
    assert stations.find({"zone": "sea"}).first() is None and not stations.exists({"zone": "sea"}) and stations.exists({"zone": "hill"})
    assert stations.find_one({"height": 1200, "manned": True})["height"] == 1200 and stations.get("d07") == STATIONS[7] and stations.contains("d29") and not stations.contains("d30")
    q = stations.find({"a": 1}).sort("b", True).skip(2).limit(3)
    assert (q.filter, q.sort_field, q.sort_descending, q.skip_count, q.limit_count) == ({"a": 1}, "b", True, 2, 3)
    assert len(stations) == 30 and not stations.is_empty() and sorted(names(stations)) == sorted(names(STATIONS))


READINGS = [{"_id": "r1", "t": -4}, {"_id": "r2", "t": 12.5}, {"_id": "r3", "t": None}, {"_id": "r4"}, {"_id": "r5", "t": 12}, {"_id": "r6", "t": "off"}, {"_id": "r7", "t": True}, {"_id": "r8", "t": 12.0}]


@pytest.mark.parametrize(
    "cond",
    [
        {"$gt": 12}, {"$gte": 12}, {"$lt": 12}, {"$lte": -4.0}, {"$ne": 12}, {"$eq": None}, {"$ne": None}, 12, None, True, {"$gte": None}, {"$gt": None}, {"$lt": "off"}, {"$in": [None, 12.5]}, {"$in": []}, {"$nin": [12, "off"]}, {"$nin": []},
        {"$not": {"$gt": 5}}, {"$exists": True}, {"$exists": False}, {"$exists": 0}, {"$in": "off"}, {"$nin": None}, {"$not": {"$bogus": 1}}, {"$not": 12}, {"$and": []}, {"$gt": 20, "$lt": 1},
    ],
)
def test_missing_and_null(spark, cond):
    c = made(spark, READINGS)
    assert sorted(ids(c.find({"t": cond}))) == [d["_id"] for d in READINGS if matches(d, {"t": cond})]


def test_direct_null_policy(spark):
    c = Collection(spark, null_matches_missing=True)
    c.insert_many(READINGS)
    assert sorted(ids(c.find({"t": None}))) == ["r3", "r4"]


def test_malformed_filters_match_nothing_or_everything(spark):
    c = made(spark, READINGS)
    assert ids(c.find({"$nor": [{"t": 1}]})) == [] == ids(c.find({"$not": {"t": 1}})) == ids(c.find({"t": {"$bogus": 1}})) == ids(c.find({"$and": 5})) == ids(c.find({"$or": []}))
    assert len(ids(c.find({"$and": []}))) == len(READINGS) == len(ids(c.find({})))


LEGS = [
    {"_id": "f1", "legs": [{"km": 320, "by": "rail"}, {"km": 40, "by": "foot"}], "stops": [2, 8]}, {"_id": "f2", "legs": [{"km": 900, "by": "air"}], "stops": [5]},
    {"_id": "f3", "legs": [], "stops": []}, {"_id": "f4", "legs": {"km": 10, "by": "rail"}, "stops": 8}, {"_id": "f5", "stops": [[8], "8", 8.0, None]}, {"_id": "f6", "legs": [{"by": "rail"}, 7, None]},
]


@pytest.mark.parametrize(
    ("field", "cond"),
    [("stops", 8), ("stops", {"$gt": 5}), ("stops", {"$lt": 3, "$gte": 2}), ("stops", {"$in": [5, None]}), ("stops", {"km": 1}), ("stops", {}), ("stops", [8]), ("stops", {"x": {"$exists": False}}), ("stops", {"$not": {"$lte": 8}}),
     ("legs", {"by": "rail"}), ("legs", {"by": "rail", "km": {"$lt": 400}}), ("legs", {"$or": [{"km": 900}, {"by": "foot"}]}), ("legs", {"km": {"$exists": False}}), ("legs", {"km": 900, "by": "air"}), ("legs", {"$and": [{"km": 40}]})],
)
def test_elem_match(spark, field, cond):
    c = made(spark, LEGS)
    assert sorted(ids(c.find({field: {"$elemMatch": cond}}))) == [d["_id"] for d in LEGS if matches(d, {field: {"$elemMatch": cond}})]


def test_rank_comparison(spark):
    docs = [{"_id": str(i), "v": v} for i, v in enumerate([None, False, True, -7, 0.5, 3, "", "x", [0], [], {"k": 1}, {}])] + [{"_id": "gone"}]
    c = made(spark, docs)
    for cond in ({o: v} for o in ("$gt", "$gte", "$lt", "$lte") for v in (None, True, 3, "x", [0], {"k": 1})):
        assert sorted(ids(c.find({"v": cond}))) == sorted(d["_id"] for d in docs if matches(d, {"v": cond})), cond


def test_keys_with_both_kinds_of_quotes(spark):
    key = "it's \"odd\\"
    c = made(spark, [{"_id": "a", key: 1}, {"_id": "b", key: None}, {"_id": "c"}])
    assert ids(c.find({key: 1})) == ["a"] and sorted(ids(c.find({key: {"$exists": True}}))) == ["a", "b"]


def random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 2 else 7)
    if kind == 0:
        return None
    if kind == 1:
        return rng.random() < 0.5
    if kind in (2, 3):
        return rng.choice([0, 1, 5, -3, 2**53, 2**53 + 1, 2**62, -(2**63)])
    if kind == 4:
        return rng.choice([0.0, -0.0, 1.0, 5.5, 2.0**53, -3.0, 1e300])
    if kind in (5, 6):
        return rng.choice(["", "a", "b", "ab", "é", "a\x00b"])
    if kind == 7:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {k: random_value(rng, depth + 1) for k in rng.sample(["p", "q"], rng.randrange(3))}


def random_condition(rng, depth=0):
    if rng.random() < 0.25:
        return random_value(rng)
    out = {}
    for _ in range(rng.choice([1, 1, 2])):
        o = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not", "$elemMatch", "$bogus"])
        if o in ("$in", "$nin"):
            out[o] = [random_value(rng) for _ in range(rng.randrange(3))]
        elif o == "$exists":
            out[o] = rng.choice([True, False, 1])
        elif o == "$not":
            out[o] = random_condition(rng, depth + 1) if depth < 2 else {"$gt": 1}
        elif o == "$elemMatch":
            out[o] = rng.choice([random_value(rng), {"p": random_condition(rng, 2)}, {"$gt": random_value(rng)}, {"$not": {"$lt": 3}}])
        else:
            out[o] = random_value(rng)
    return out


def random_query(rng, depth=0):
    q = {rng.choice(["x", "y", "z"]): random_condition(rng) for _ in range(rng.choice([1, 1, 2]))}
    if depth < 2 and rng.random() < 0.3:
        q[rng.choice(["$and", "$or"])] = [random_query(rng, depth + 1) for _ in range(rng.randrange(3))]
    return q


def test_dynamic_filters_equal_a_plain_matcher(spark):
    rng = random.Random(11)
    docs = [{"_id": f"{i:03d}"} | {k: random_value(rng) for k in ("x", "y", "z") if rng.random() < 0.8} for i in range(60)]
    c = made(spark, docs)
    queries = [random_query(rng) for _ in range(40)]
    cols = [F.coalesce(c.backend.predicate(q), F.lit(False)).alias(f"q{i}") for i, q in enumerate(queries)]
    for part in range(0, len(queries), 8):
        for r in c.frame.select("_id", *cols[part : part + 8]).collect():
            for i in range(part, min(part + 8, len(queries))):
                assert r[f"q{i}"] == matches(docs[int(r._id)], queries[i]), (docs[int(r._id)], queries[i])


def test_typed_filters_equal_a_plain_matcher(spark):
    rng = random.Random(12)
    docs, rows = [], []
    for i in range(80):
        x = rng.choice([None, 0, 1, 5, -3, 2**53 + 1, -(2**63)])
        y = rng.choice([None, 0.0, 1.0, 5.5, 2.0**53, float("inf"), float("nan")])
        z = rng.choice([None, "", "a", "b", "é"])
        a = rng.choice([None, [], [1, None], [5], [0, 1]])
        s = rng.choice([None, [{"p": 1, "q": "a"}], [{"p": None, "q": "b"}, {"p": 5, "q": None}]])
        rows.append((str(i), x, y, z, a, s))
        strip = lambda d: {k: v for k, v in d.items() if v is not None}
        docs.append(strip({"_id": str(i), "x": x, "y": y, "z": z, "a": a, "s": [strip(e) for e in s] if s is not None else None}))
    df = spark.createDataFrame(rows, "_id string, x long, y double, z string, a array<long>, s array<struct<p:long,q:string>>")
    c = Collection(spark, "t", df)
    values = lambda: rng.choice([None, True, 0, 1, 5, 5.5, -3.0, 2**53 + 1, 2**53, 2**70, float("inf"), float("nan"), "", "a", "zz", [1], [5], [1, None], []])
    queries = []
    for _ in range(250):
        f = rng.choice(["x", "y", "z", "a", "s", "none"])
        o = rng.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "direct"])
        v = [values() for _ in range(rng.randrange(4))] if o in ("$in", "$nin") else rng.choice([True, False]) if o == "$exists" else values()
        cond = v if o == "direct" else {o: v}
        if o != "direct" and rng.random() < 0.3:
            cond = {"$not": cond}
        if f == "s":
            cond = {"$elemMatch": rng.choice([{"p": {rng.choice(["$gt", "$ne", "$exists"]): True if rng.random() < 0.3 else 1}}, {"q": "a"}, {}, {"p": {"$in": [5, None]}}])}
        elif f == "a" and rng.random() < 0.5:
            cond = {"$elemMatch": rng.choice([1, None, {"$gt": 0}, {"$lt": 5}, {"$ne": 1}, {"$in": [0, None]}, {"$not": {"$gte": 1}}, {"k": 1}])}
        queries.append({f: cond})
    for part in range(0, len(queries), 50):
        own = queries[part : part + 50]
        cols = [F.coalesce(c.backend.predicate(q), F.lit(False)).alias(f"q{i}") for i, q in enumerate(own)]
        for r in c.frame.select("_id", *cols).collect():
            for i, q in enumerate(own):
                assert r[f"q{i}"] == matches(docs[int(r._id)], q), (docs[int(r._id)], q)


def test_filters_reach_the_scan(spark, sf):
    orders = Collection(spark, "o", spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey")
    plan = lambda q: q.frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in plan(orders.find({"o_totalprice": {"$gte": 1000}}))
    assert "EqualTo(o_custkey,5)" in plan(orders.find({"o_custkey": 5.0}))
    assert "In(o_orderstatus, [F,O])" in plan(orders.find({"o_orderstatus": {"$in": ["F", "O"]}}))
    assert "TakeOrderedAndProject" in plan(orders.find().sort("o_totalprice").limit(5))


PARCELS = drawn(6, 40, route=["north", "ring", None, MISSING], kg=[2, 7, 12, 7.5, MISSING, None, "heavy"], label=["a", "b", MISSING])


def plain_group(docs, field, fn, value=None, key=None, down=False):
    """Groups in order of their keys; first, last and collect see documents in the given order."""
    if key:
        docs = in_order(docs, key, down)
    groups = {}
    for d in docs:
        groups.setdefault(order_bytes(d.get(field)), (d.get(field), []))[1].append(d)
    out = []
    for _, (g, own) in sorted(groups.items()):
        values = [d.get(value) for d in own]
        there = [d[value] for d in own if value in d]
        numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        low, high = min(there, key=order_bytes, default=None), max(there, key=order_bytes, default=None)
        out.append((g, {"count": len(own), "sum": sum(numbers), "mean": sum(numbers) / len(numbers) if numbers else None, "min": low, "max": high, "collect": values, "first": values[0], "last": values[-1]}[fn]))
    return out


def test_grouping(spark):
    c = made(spark, PARCELS)
    g = c.find().group("route")
    rows = lambda fn, field=None, q=g: [(r["_id"], r[function_name(fn)]) for r in q.agg(fn, field)]
    assert rows("count") == rows(0) == rows("COUNT") == plain_group(PARCELS, "route", "count")
    for fn in ("sum", "mean", "min", "max"):
        assert rows(fn, "kg") == plain_group(PARCELS, "route", fn, "kg"), fn
    assert rows("mean", "label")[0][1] is None and rows("sum", "label")[0][1] == 0
    for down in (False, True):
        by = c.find().sort("kg", down).group("route")
        for fn in ("first", "last", "collect"):
            assert rows(fn, "label", by) == plain_group(PARCELS, "route", fn, "label", "kg", down), (fn, down)
    counted = plain_group(PARCELS, "route", "count")
    assert rows("count", None, g.sort("count", True)) == sorted(counted, key=lambda r: (r[1], order_bytes(r[0])), reverse=True)
    assert rows("sum", "kg", g.sort("sum")) == sorted(plain_group(PARCELS, "route", "sum", "kg"), key=lambda r: (r[1], order_bytes(r[0])))
    assert rows("count", None, c.find().sort("kg").limit(5).group("route")) == plain_group(in_order(PARCELS, "kg")[:5], "route", "count")
    assert rows("count", None, g.limit(2)) == counted[:2]
    mixed = made(spark, [{"_id": str(i), "v": v} for i, v in enumerate([4, 4.0, [1], [1.0], {"k": [2]}, "4", None])])
    assert [r["count"] for r in mixed.find().group("v").agg("count")] == [1, 2, 1, 2, 1]
    big = made(spark, [{"_id": "1", "v": 2**62}, {"_id": "2", "v": 2**62}, {"_id": "3", "v": 3}])
    assert big.find({"v": {"$gt": 5}}).group("none").agg("sum", "v")[0]["sum"] == float(2**63) and isinstance(big.find({"v": 3}).group("none").agg("sum", "v")[0]["sum"], int)
    with pytest.raises(ValueError):
        g.agg("median")


#: Words and stems that the paper of 1980 gives for its rules, with what the later rules make of them.
PAPER = """plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl tanned tan radicalli radic differentli differ vileli vile analogousli analog
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl formalize formal
electriciti electr goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac dependent depend homologou homolog communism commun activate activ angulariti angular effective effect probate probat rate rate roll roll"""


def test_words():
    pairs = PAPER.split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word
    assert stem("eyed") == "ei" and stem("ies") == "i" and stem("as") == "as"
    assert tokens("O'Neil İzmir x-86 Ärger") == ["o", "neil", "zmir", "x", "86", "rger"]


def plain_bm25(texts, query):
    """Scores above 0 of texts by id, from a scan that stems all."""
    counts = {i: Counter(stem(t) for t in tokens(x)) for i, x in texts.items()}
    n, mean = len(counts), sum(c.total() for c in counts.values()) / max(1, len(counts))
    out = {}
    for i, c in counts.items():
        score = 0.0
        for s in sorted({stem(t) for t in tokens(query)}):
            if c[s]:
                df = sum(1 for o in counts.values() if o[s])
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * (c[s] * 2.2) / (c[s] + 1.2 * (0.25 + 0.75 * c.total() / mean))
        if score > 0:
            out[i] = score
    return out


WORDS = "eyed eyes eye ies ties tied tying yes says say dyed dying flies fly yyy y s as is ed ing boat boats boating harbour quay 7 77 a-b İi".split()


def test_text_search_equals_a_scan_that_stems_all(spark):
    rng = random.Random(9)
    texts = {f"t{i:02d}": " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 3, 20]))) for i in range(60)}
    c = made(spark, [{"_id": i, "x": t if rng.random() < 0.7 else t.split(" ")} for i, t in texts.items()] + [{"_id": "n1", "x": 4}, {"_id": "n2", "x": ["a", 1]}, {"_id": "n3"}])
    with pytest.raises(NoIndex):
        c.text_search("x", "boat")
    c.create_text_index("x")
    for query in ["eyed", "ies", "flies and ties", "yes", "y", "ED ing", "boat harbours quay 77", "!!", "", *WORDS[:12]]:
        want = plain_bm25(texts, query)
        got = {r["_id"]: r["score"] for r in c.text_scores("x", query).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-9 for i, s in want.items()), query
    best = sorted(plain_bm25(texts, "boats").items(), key=lambda x: (-x[1], x[0]))
    assert [d["_id"] for d, _ in c.text_search("x", "boating", 4)] == [i for i, _ in best[:4]]
    c.insert({"_id": "new", "x": "boat " * 9})  # the index follows the snapshot
    assert "new" in [d["_id"] for d, _ in c.text_search("x", "boat", 0)]
    c.delete_many({"_id": {"$ne": "new"}})
    assert [d["_id"] for d, _ in c.text_search("x", "boat")] == ["new"]
    assert c.has_text_index("x") and c.text_index_names() == ["x"]
    c.drop_text_index("x")
    assert not c.has_text_index("x")


def test_vector_and_hybrid_search(spark):
    rng = np.random.default_rng(3)
    vectors = {f"v{i:02d}": [round(float(x), 2) for x in rng.normal(size=3)] for i in range(25)} | {"zero": [0.0, 0.0, 0.0], "ints": [1, 0, 0]}
    texts = {i: " ".join(rng.choice(["kite", "kites", "wind", "sand"], 4)) for i in [*list(vectors)[:20], "only-text"]}
    docs = [{"_id": i} | ({"e": vectors[i]} if i in vectors else {}) | ({"x": texts[i]} if i in texts else {}) for i in sorted({*vectors, *texts})]
    c = made(spark, docs)
    with pytest.raises(NoIndex):
        c.hybrid_search("x", "e", "kite", [1, 0, 0])
    c.create_text_index("x")
    c.create_vector_index("e", 3)
    query = [0.2, -1.0, 0.4]
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    cosine = {i: float(unit(v) @ unit(query)) for i, v in vectors.items()}
    order = sorted(cosine, key=lambda i: (-round(cosine[i], 6), i))
    hits = c.vector_search("e", query, 0)
    assert [d["_id"] for d, _ in hits] == order and all(abs(s - cosine[d["_id"]]) < 1e-6 for d, s in hits)
    assert c.vector_search("e", [1.0, 0.0]) == [] and len(c.vector_search("e", [0, 0, 0], 0)) == 27 and [d["_id"] for d, _ in c.vector_search("e", query, 1)] == order[:1]
    many = {(r["query"], r["_id"]): r["score"] for r in c.vector_scores_many("e", [query, [1.0], [0, 1, 0]], 5).collect()}
    assert {i for k, i in many if k == 0} == set(order[:5]) and not [k for k, _ in many if k == 1] and len([k for k, _ in many if k == 2]) == 5
    asked = ["kite", "wind sand", "", "kites sand"]
    many = {(r["query"], r["_id"]): r["score"] for r in c.text_scores_many("x", asked, 4).collect()}
    for k, q in enumerate(asked):
        want = plain_bm25(texts, q)
        best = sorted(want, key=lambda i: (-want[i], i))[:4]
        assert {i for x, i in many if x == k} == set(best) and all(abs(many[k, i] - want[i]) < 1e-9 for i in best)
    by_text = plain_bm25(texts, "kite wind")
    ranks = [sorted(by_text, key=lambda i: (-by_text[i], i)), order]
    fused = {i: sum(1 / (60 + r.index(i) + 1) for r in ranks if i in r) for i in {*by_text, *order}}
    got = c.hybrid_search("x", "e", "kite wind", query, 0)
    assert {d["_id"] for d, _ in got} == set(fused) and all(abs(s - fused[d["_id"]]) < 1e-12 for d, s in got)
    assert [d["_id"] for d, _ in got] == sorted(fused, key=lambda i: (-round(fused[i], 12), i))
    with pytest.raises(VectorDimMismatch):
        c.insert({"_id": "x", "e": [1, 2]})
    with pytest.raises(VectorDimMismatch):
        c.update_one({"_id": "v03"}, {"$set": {"e": "no"}})
    c.delete_one({"_id": order[0]})
    assert [d["_id"] for d, _ in c.vector_search("e", query, 3)] == order[1:4]


def test_inserts(spark):
    c = Collection(spark)
    made_id = c.insert({"v": 1})
    assert len(made_id) == 24 and list(c.get(made_id)) == ["_id", "v"]
    c.insert({"z": 1.0, "_id": "k", "a": [1, {"b": None}]})
    assert c.get("k") == {"z": 1.0, "_id": "k", "a": [1, {"b": None}]} and list(c.get("k")) == ["z", "_id", "a"] and isinstance(c.get("k")["z"], float)
    for bad, error in (([{"_id": "n1"}, {"_id": "k"}], DuplicateId), ([{"_id": "n"}, {"_id": "n"}], DuplicateId), ([{"_id": 5}], IdMustBeString), ([7], NotAnObject)):
        with pytest.raises(error):
            c.insert_many(bad)
    assert len(c) == 2 and DuplicateId.status == 3 and NoMatch.status == 7


def test_updates(spark):
    c = made(spark, [{"_id": "a", "n": 1, "t": {"x": [1, 2]}}, {"_id": "b", "n": "s"}, {"_id": "c"}])
    assert c.update_one({"_id": "a"}, {"$set": {"t.x[2]": 3, "t.y.z": 1, "new[1]": "p"}, "$inc": {"n": 2, "f": 0.5}, "$unset": ["t.x.0", "none.here"]}) == 1
    assert c.get("a") == {"_id": "a", "n": 3, "t": {"x": [2, 3], "y": {"z": 1}}, "f": 0.5, "new": [None, "p"]}
    with pytest.raises(InvalidUpdate):
        c.update_many({}, {"$inc": {"n": 1}})
    assert c.get("a")["n"] == 3  # all or none
    with pytest.raises(NoMatch):
        c.update_one({"_id": "zz"}, {"$bogus": 1})
    for spec in (5, {"$push": {}}, {"$set": 5}, {"$set": {"_id": "q"}}, {"$unset": {"_id": 1}}, {"$inc": {"n": "x"}}, {"$set": {"a..b": 1}}, {"$set": {"a[": 1}}):
        with pytest.raises(InvalidUpdate):
            c.update_many({}, spec)
    assert c.update_many({"_id": {"$in": ["b", "c"]}}, {"$set": {"v": 2}}) == 2 and c.count({"v": 2}) == 2
    c.update_one({"_id": "c"}, {"$inc": {"v": 2**63 - 1}})
    assert c.get("c")["v"] == float(2**63 + 1)
    assert c.replace_one({"_id": "b"}, {"w": 1}) == 1 and c.get("b") == {"_id": "b", "w": 1}
    for doc, error in (({"_id": "x"}, IdMismatch), (5, NotAnObject), ({"_id": 5}, IdMustBeString)):
        with pytest.raises(error):
            c.replace_one({"_id": "b"}, doc)
    with pytest.raises(NoMatch):
        c.replace_one({"_id": "none"}, {})
    assert c.delete_one({"w": 1}) and not c.delete_one({"w": 1}) and c.delete_many({"v": {"$exists": True}}) == 1 and c.delete_many({"v": 1}) == 0
    assert c.set_doc("none", {}) is None and c.set_doc("a", {"q": 1})["n"] == 3 and c.remove_doc("a") == {"_id": "a", "q": 1} and c.is_empty()


def test_paths():
    assert paths.parse("a.b[0].c[x.y]") == ["a", "b", "0", "c", "x.y"]
    for bad in ("", ".a", "a.", "a..b", "a[]", "a[0", "a[0]b", "a[0].", "a.[0]"):
        with pytest.raises(paths.PathError):
            paths.parse(bad)
    doc = {"a": [1, {"b": 2}]}
    assert paths.get(doc, ["a", "1", "b"]) == 2 and paths.get(doc, ["a", "9"]) is paths.MISSING
    assert paths.put(doc, ["a", "2"], 3) == {"a": [1, {"b": 2}, 3]} and paths.drop(doc, ["a", "2"]) == doc and paths.drop(doc, ["z", "q"]) == doc
    for tokens_, what in ((["a", "3"], "put"), (["a", "x"], "put"), (["a", "0", "q"], "put")):
        with pytest.raises(paths.PathError):
            paths.put(doc, tokens_, 1)
    for tokens_ in (["a", "3"], ["a", "0", "q"]):
        with pytest.raises(paths.PathError):
            paths.drop(doc, tokens_)


def test_order_of_values():
    values = [None, False, True, float("-inf"), -(2**63), -1.5, 0, 1, 2**53, 2**53 + 1, 2**62, float("inf"), float("nan"), "", "a", "a\x00", "ab", "b", [], [None], [1], [1, 0], [2], {}, {"a": 1}, {"a": 1, "b": 0}, {"a": 2}, {"b": 0}]
    keys = [order_bytes(v) for v in values]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert order_bytes(1) == order_bytes(1.0) and order_bytes(-0.0) == order_bytes(0) and order_bytes({"a": 1, "b": 2}) == order_bytes({"b": 2, "a": 1})


def test_batches(spark):
    c = made(spark, [{"_id": "a", "n": 1}, {"_id": "b", "n": 2}, {"_id": "c", "n": 3}])
    t = c.begin()
    t.insert({"_id": "d", "n": 4})
    assert t.update({"n": {"$lte": 2}}, {"$inc": {"n": 10}}) == 2 and t.update({"_id": "a"}, {"$set": {"m": 1}}) == 1
    assert t.delete({"_id": "b"}) == 1 and t.update({"_id": "zz"}, {"$set": {"n": 1}}) == 0 and t.replace({"_id": "c"}, {"r": 1}) == 1
    assert t.count() == len(t) == 3 and t.find_one({"_id": "a"})["n"] == 1 and c.count() == 3 and not t.contains("d")
    t.commit()
    assert {d["_id"]: d for d in c.find().to_list()} == {"a": {"_id": "a", "n": 1, "m": 1}, "c": {"_id": "c", "r": 1}, "d": {"_id": "d", "n": 4}}
    assert ids(c.find().skip(0).limit(9)) == ["a", "c", "d"]  # what was there keeps its place
    t = c.begin()
    t.delete({"_id": "a"})
    with pytest.raises(DuplicateId):
        t.insert({"_id": "a"})
    assert t.is_failed and t.error.status == 3
    with pytest.raises(DuplicateId):
        t.commit()
    t = c.begin()
    with pytest.raises(NoMatch):
        t.replace({"_id": "zz"}, {})
    t = c.begin()
    t.delete({})
    t.rollback()
    assert len(c) == 3


BOATS = drawn(8, 24, mast=[1, 2, 2.0, 3, None, MISSING, "none"], port=["Kiel", "Brest"])


def test_indexes_and_stats(spark):
    c = made(spark, BOATS)
    c.create_index("mast")
    c.create_index("port")
    c.create_index("_id")
    assert c.index_names() == ["_id", "mast", "port"] and c.reindex() == 3
    s = c.stats()
    different = {f: len({order_bytes(d.get(f)) for d in BOATS}) for f in ("_id", "mast", "port")}
    assert s["docs"] == 24 and s["indexes"] == 3 and {r["field"]: r["distinct"] for r in s["per_index"]} == different
    assert s["total_memory"] == s["docs_memory"] + sum(r["memory"] for r in s["per_index"])
    assert names(c.clustered("mast", 2).collect()) == names(in_order(BOATS, "mast"))
    mast = c.index("mast")
    assert len(mast) == 24 and not mast.is_empty() and mast.distinct() == different["mast"] and mast.memory_size() == 16 * 24
    assert names(mast.iter().collect()) == names(in_order(BOATS, "mast"))
    key = lambda d: order_bytes(d.get("mast"))
    for v in (2, None, "none", 9):
        want = sorted(d["_id"] for d in BOATS if key(d) == order_bytes(v))
        assert sorted(names(mast.ids_equal(v).collect())) == want and mast.contains_value(v) == bool(want)
    for low, high in ((1, 3), (None, 2), (2, "none"), (None, None), (3, 1)):
        for a in (True, False):
            for b in (True, False):
                want = [d["_id"] for d in BOATS if (order_bytes(low) <= key(d) if a else order_bytes(low) < key(d)) and (key(d) <= order_bytes(high) if b else key(d) < order_bytes(high))]
                assert sorted(names(mast.ids_range(low, high, a, b).collect())) == want, (low, high, a, b)
    assert len(mast.ids_range(low_open=True, high_open=True).collect()) == 24 and sorted(names(mast.ids_range(low_open=True, high=2).collect())) == [d["_id"] for d in BOATS if key(d) < order_bytes(2)]
    c.insert({"_id": "new", "mast": 9})
    assert c.index("mast").contains_value(9)
    c.drop_index("mast")
    with pytest.raises(PrimaryIndex):
        c.drop_index("_id")
    for act in (c.drop_index, c.index):
        with pytest.raises(NoIndex):
            act("mast")
    c.create_vector_index("v", 3)
    assert c.has_vector_index("v") and c.vector_index_names() == ["v"]
    c.drop_vector_index("v")
    c.drop_vector_index("v")


def test_index_of_a_typed_column(spark):
    c = Collection(spark, "t", spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(40)], "id long, v int"), "id")
    c.create_index("v")
    v = c.index("v")
    assert sorted(names(v.ids_equal(3.0).collect())) == [i for i in range(40) if i % 5 and i % 7 == 3]
    assert sorted(names(v.ids_equal(None).collect())) == list(range(0, 40, 5)) and v.distinct() == 8
    assert sorted(names(v.ids_range(2, 4, True, True).collect())) == [i for i in range(40) if i % 5 and 2 <= i % 7 <= 4]
    assert [r.v for r in v.iter().limit(9).collect()] == [None] * 8 + [0]
    assert ids_of(c.find({"v": {"$gte": 5}})) == [i for i in range(40) if i % 5 and i % 7 >= 5] and c.find({"v": 3}).source is not c.frame and c.find({"id": 3}).source is c.frame
    c.update_one({"id": 3}, {"$set": {"v": 50}})
    assert ids_of(c.find({"v": {"$gt": 40}})) == [3]


def test_store_files_and_streams(spark, tmp_path):
    store = Store(spark)
    assert store.collection("none").find().to_list() == [] and store.collection("none").count() == 0
    with open(tmp_path / "d.jsonl", "w") as f:
        f.write('{"_id":"x","v":1.0}\n{"_id":"y","v":[1]}\n')
    c = store.read_json("files", str(tmp_path / "d.jsonl"))
    assert c.get("x") == {"_id": "x", "v": 1.0} and store.collection("files") is c
    write_parquet(c.frame, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    spark.range(20).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "in"))
    t = store.attach("typed", spark.createDataFrame([(3, 0)], "id long, v long"), "id")
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    ingest(stream, t, str(tmp_path / "cp")).awaitTermination(60)
    assert len(t) == 20 and t.get(3) == {"id": 3, "v": 0} and t.get(4) == {"id": 4, "v": 8}


def test_typed_updates_of_nested_columns(spark):
    df = spark.createDataFrame([("a", (1, "x"), [1, 2]), ("b", None, None)], "_id string, s struct<p:long,q:string>, a array<long>")
    c = Collection(spark, "t", df)
    c.update_many({}, {"$set": {"s.q": "new", "a[0]": 9}, "$inc": {"s.p": 4}})
    assert c.get("a") == {"_id": "a", "s": {"p": 5, "q": "new"}, "a": [9, 2]} and c.get("b") == {"_id": "b", "s": {"p": 4, "q": "new"}, "a": [9]}
    c.update_one({"_id": "a"}, {"$unset": {"a.0": 1, "s": 1}})
    assert c.get("a") == {"_id": "a", "s": None, "a": [2]}
    with pytest.raises(InvalidUpdate):
        c.update_many({}, {"$set": {"a[7]": 1}})
    with pytest.raises(InvalidUpdate):
        c.update_many({}, {"$set": {"nope": 1}})


def test_lineage_is_cut(spark):
    c = Collection(spark)
    scans = lambda: c.frame._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    for i in range(CHECKPOINT_EVERY - 1):
        c.insert({"_id": f"{i:02d}", "v": i}) if i % 5 != 1 else c.update_many({"v": {"$lt": 3}}, {"$inc": {"w": 1}})
    before = c.find().sort("v").to_list()
    plan = c.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    c.insert({"_id": "last"})
    plan = c.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and scans() == 1 and c.version == CHECKPOINT_EVERY
    assert {d["_id"]: d for d in c.find().to_list()} == {d["_id"]: d for d in [*before, {"_id": "last"}]}


def test_writes_leave_nothing_persisted(spark):
    c = made(spark, PARCELS)
    c.update_many({"kg": {"$gt": 3}}, {"$set": {"seen": True}})
    c.update_one({"route": "ring"}, {"$set": {"seen": False}})
    assert c.count({"seen": {"$exists": True}}) > 0 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_a_batch_notices_writes_since_it_began(spark):
    c = made(spark, [{"_id": "a", "n": 1}, {"_id": "b", "n": 2}])
    t = c.begin()
    t.update({"_id": "a"}, {"$inc": {"n": 1}})
    c.update_one({"_id": "a"}, {"$set": {"n": 50}})
    with pytest.raises(Conflict):
        t.commit()
    assert c.get("a")["n"] == 50
    t = c.begin()
    t.insert_many([{"_id": "c"}, {"n": 7}])
    for bad in ([{"_id": "c"}], [{"_id": "e"}, {"_id": "e"}], [{"_id": "b"}]):
        with pytest.raises(DuplicateId):
            t.insert_many(bad)
    with pytest.raises(DuplicateId):
        t.commit()
    assert len(c) == 2


def test_typed_batches_without_collecting(spark):
    c = Collection(spark, "t", spark.range(1000).selectExpr("id", "id % 10 AS v", "cast(null as string) AS s"), "id")
    t = c.begin()
    assert t.update({"v": {"$lt": 5}}, {"$inc": {"v": 100}}) == 500 and t.delete({"v": 3}) == 100 and t.update({"id": 13}, {"$set": {"s": "back"}}) == 1
    t.replace({"id": 0}, {"s": "new"})
    t.insert({"id": 5000, "v": 1, "s": None})
    t.commit()
    assert len(c) == 902 and c.get(13) == {"id": 13, "v": 3, "s": "back"} and c.get(0) == {"id": 0, "v": None, "s": "new"} and c.get(4)["v"] == 104 and c.get(5000)["v"] == 1 and c.get(23) is None
    with pytest.raises(StoreError):
        t.commit()


def test_ids_differ_between_processes():
    code = "from quarry.sources.backends import new_id; print(*[new_id() for _ in range(50)])"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made_ids = [i for _ in range(2) for i in subprocess.run([sys.executable, "-c", code], cwd=root, check=True, capture_output=True, text=True, timeout=120).stdout.split()]
    assert len(set(made_ids)) == 100 and all(len(i) == 24 and int(i, 16) for i in made_ids)


def test_store_connects_and_closes(spark):
    with Store.connect(spark) as store:
        store.collection("c").insert({"_id": "a"})
        assert store.collection("c").count() == 1
    store.close()
    with pytest.raises(StoreError):
        store.collection("c")
