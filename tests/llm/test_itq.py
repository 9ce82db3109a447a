"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from quarry.llm import itq
from quarry.llm.queries import QUERIES


def brute(ids, x, cosine=0.95):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
    names = {}
    for i in range(len(ids)):
        names[find(i)] = min(names.get(find(i), ids[i]), ids[i])
    return link.sum(axis=1), [names[find(i)] for i in range(len(ids))]


def clusters(seed, n=400, groups=12, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for g in range(groups):
        base = rng.normal(size=dim)
        own = rng.choice(n, 15 if g else n // 4, replace=False)
        x[own] = base + rng.normal(size=(len(own), dim)) * 0.15
    return x.astype(np.float32)


@pytest.mark.parametrize("short", [64, 3])
def test_links_and_components(spark, monkeypatch, short):
    monkeypatch.setattr(itq, "SHORT", short)
    monkeypatch.setattr(itq, "BLOCK", 32)
    x = clusters(3)
    x[50] = x[51] = x[52] = x[53] * np.float32(1)
    ids = np.random.default_rng(0).permutation(1000)[: len(x)].tolist()
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0, None] * 32), (2004, [float("inf")] * 64), (2005, [1.0, 2.0])]
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, x, strict=True)] + [(i, v, 2) for i, v in odd]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")).collect()}
    assert len(got) == len(rows)
    n, names = brute(ids, x.astype(np.float64))
    assert sum(got[i].n_links for i in ids) >= 0.9 * n.sum()
    for i, k, name in zip(ids, n, names, strict=True):
        assert got[i].n_links <= k and got[i].kept == (got[i].component_id == i)
    assert np.mean([got[i].component_id == name for i, name in zip(ids, names, strict=True)]) >= 0.98
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_both_ways_of_lists_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clusters(9, 300))], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, itq.near_duplicates(df).collect()))
    monkeypatch.setattr(itq, "SHORT", 1)
    monkeypatch.setattr(itq, "BLOCK", 16)
    assert sorted(map(tuple, itq.near_duplicates(df).collect())) == one


def test_a_pair_counts_in_one_key():
    rng = np.random.default_rng(1)
    for rows in (100, 10_000, 100_000):
        t = itq.Tables(64, rows)
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = a.copy()
        for _ in range(6):
            b ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        times = np.zeros(300, int)
        shared = np.zeros(300, bool)
        for (tab, mask, x), (_, _, y) in zip(t.keys(a), t.keys(b), strict=True):
            same = x == y
            shared |= same
            times += same & t.first(a ^ b, np.full(300, tab), np.full(300, mask, np.uint64))
        assert (times == shared).all() and shared.mean() > 0.8


def test_rotation_balances_codes():
    x = np.random.default_rng(0).normal(size=(3000, 64)) * np.linspace(0.2, 3, 64)
    c = itq.Codes(x).of(x)
    on = [((c >> np.uint64(k)) & np.uint64(1)).mean() for k in range(64)]
    assert 0.4 < min(on) and max(on) < 0.6


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert itq.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = itq.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 2, 1), ("1", 2, 1), ("5", 0, 5), ("None", 2, 1)]


def test_recall_on_the_whole_table(spark, sf):
    d = sf.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    n, names = brute(ids, x)
    got = {r.vec_id: r for r in QUERIES["op5_itq_near_dedup"](spark, d).collect()}
    assert sum(got[i].n_links for i in ids) >= 0.9 * n.sum()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, names, strict=True)]) >= 0.98


def common(share, n, seed, most=0.97, dim=64):
    """Vectors whose average cosine is the share, and pairs at 0.95 to `most` planted around every tenth one."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.normal(size=(n, dim))) + np.sqrt(share / (1 - share)) * unit(np.ones(dim)))
    u, c = x[: n // 10], rng.uniform(0.95, most, (n // 10, 1))
    to = rng.normal(size=u.shape)
    to = unit(to - (to * u).sum(axis=1, keepdims=True) * u)
    return np.concatenate([x, c * u + np.sqrt(1 - c * c) * to])


def recall(x, rows, sample=itq.SAMPLE):
    """Share of all links of x that tables for so many rows find, learned on other vectors."""
    codes, tables = itq.fitted(x[-sample:], rows, 0.95)
    x = x[:-sample]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    code = codes.of(x)
    found = np.zeros(len(a), bool)
    for _, _, key in tables.keys(code):
        found |= key[a] == key[b]
    return (found & (np.bitwise_count(code[a] ^ code[b]) <= tables.far)).mean(), len(a)


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_recall_with_a_common_mean(share):
    x = common(share, 6000, 5, most=0.951)
    found, links = recall(np.concatenate([x, common(share, 20_000, 6)[:20_000]]), 51_282)
    assert links >= 500 and found >= 0.93


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.7, 0.8])
@pytest.mark.parametrize("rows", [51_282, 150_000, 3_000_000])
def test_recall_of_large_tables(share, rows):
    x = common(share, 6000, 7)
    found, links = recall(np.concatenate([x, common(share, 20_000, 8)[:20_000]]), rows)
    assert links >= 500 and found >= 0.93


def test_links_of_a_large_table_with_a_common_mean(spark, monkeypatch):
    tables = itq.Tables
    monkeypatch.setattr(itq, "Tables", lambda bits, rows, *a, **k: tables(bits, 51_282, *a, **k))
    x = common(0.5, 2000, 6).astype(np.float32)
    n, _ = brute(list(range(len(x))), x.astype(np.float64))
    assert n.sum() >= 400
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert all(r.n_links <= n[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.9 * n.sum()


@pytest.mark.parametrize("rows", [51_282, 65_537, 150_000, 3_000_000])
def test_keys_stay_few_as_rows_grow(rows):
    t = itq.Tables(64, rows)
    assert len(list(t.keys(np.zeros(1, np.uint64)))) <= 64 and t.recall >= 0.93


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("rows", [10**5, 10**7, 10**9])
def test_keys_are_bounded_whatever_the_mean(rows, share):
    _, t = itq.fitted(common(share, 18_000, 9)[:20_000], rows, 0.95)
    assert len(t.parts) <= itq.MOST_KEYS == 128 and t.recall >= 0.93


def test_every_length_is_indexed(spark):
    rng = np.random.default_rng(4)
    base = {d: rng.normal(size=(60, d)) for d in (64, 32, 3)}
    rows = [(100 * d + i, v.tolist()) for d, x in base.items() for i, v in enumerate(x)] + [(100 * d + 60 + i, (v * 2 + 0.01).tolist()) for d, x in base.items() for i, v in enumerate(x[:30])]
    rows += [(7, [1.0] * 5), (8, [1.0] * 5), (9, [0.0] * 3), (10, [])]
    got = {r.vec_id: r for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    for d in base:
        own = [(i, v) for i, v in rows if i >= 100 and i // 100 == d]
        n, _ = brute([i for i, _ in own], np.array([v for _, v in own], np.float32).astype(np.float64))
        assert sum(n) >= 60 and sum(got[i].n_links for i, _ in own) >= 0.9 * sum(n)
        assert all(got[i].n_links <= k for (i, _), k in zip(own, n, strict=True))
    assert [(got[i].n_links, got[i].component_id) for i in (7, 8, 9, 10)] == [(1, 7), (1, 7), (0, 9), (0, 10)]
