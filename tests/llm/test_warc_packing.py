"""Packages against zipfile and brute force; packing against its rules."""

import base64
import hashlib
import io
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import packing, shared, warc_zip
from quarry.llm.files import Ranges, Whole
from quarry.llm.queries import QUERIES


def expected(rows):
    top, size = {}, {}
    for p, h in rows:
        raw = (h or "").encode()
        size[raw] = size.get(raw, 0) + 1
        if p is not None:
            top[raw] = max(top.get(raw, p), p)
    out, seen = [], set()
    for p, h in rows:
        raw = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = p is None or (p == top[raw] and (raw, p) not in seen)
        seen.add((raw, p))
        out.append((p, len(raw), d, "response" if response else "revisit", None if response else top[raw]))
    return sorted(out, key=str)


def test_rows_equal_brute_force(spark, sf):
    small = [(1, None), (2, ""), (3, "é" * 5), (4, "x"), (5, "x"), (5, "x"), (5, "x"), (None, "x"), (None, "y"), (9, "long " * 100000), (3, "y\r\n\r\ny"), (11, "\r\n")]
    for rows in (small, [(i, "same") for i in range(300)] + small):
        df = spark.createDataFrame([(p, "http://a/\r\nX: y", h, "clash") for p, h in rows], "page_id long, url string, html string, sha1 string")
        folder, parts = warc_zip.write_packages(df)
        assert sorted((tuple(r) for r in warc_zip.read_packages(spark, folder, parts).collect()), key=str) == expected(rows)
    folder, parts = warc_zip.write_packages(df.limit(0))
    assert warc_zip.read_packages(spark, folder, parts).count() == 0
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op7_warc_zip"](spark, sf).collect()), key=str) == expected(pages)


def test_payloads_are_not_shuffled(spark, sf, monkeypatch):
    monkeypatch.setattr(warc_zip, "written", lambda df: (plans.append(df), shared.written(df))[1])
    plans: list = []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = spark.read.parquet(f"{sf}/pages.parquet")
        warc_zip.write_packages(pages)
        plans.append(warc_zip.revisits(pages))
        for df in plans:
            text = df._jdf.queryExecution().optimizedPlan().toString()
            below = [i for i, line in enumerate(text.splitlines()) if "Join" in line or "Aggregate" in line or "Repartition" in line]
            assert not below or "html" not in text and "payload" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(plans) >= 4


def test_changed_pages_are_noticed(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "x")], "page_id long, url string, html string").coalesce(1)
    other = spark.createDataFrame([(1, "u", "changed"), (2, "u", "same"), (3, "u", "x")], "page_id long, url string, html string").coalesce(1)
    old = warc_zip.revisits
    monkeypatch.setattr(warc_zip, "revisits", lambda _: old(df))
    with pytest.raises(Exception, match="other rows"):
        warc_zip.write_packages(other)


@pytest.mark.parametrize("small", [0xFFFFFFFF, 10])
def test_package_is_a_zip_file_with_zip64_where_needed(tmp_path, small):
    path = f"{tmp_path}/a.zip"
    packer = warc_zip.Packer(path, member_bytes=300, small=small)
    for i in range(20):
        html = f"page {i}".encode()
        packer.add(warc_zip.record(i, "u", html, len(html), warc_zip.digest(html), None))
    packer.close()
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert len(z.namelist()) > 3
        names = {n: z.read(n) for n in z.namelist()}
    f = Ranges(path)
    assert {n: f.read(*x) for n, x in warc_zip.directory(f).items()} == names
    assert [r["page_id"] for r in warc_zip.records_of(path, [7, 3, 19])] == [7, 3, 19]
    assert [r["payload"] for r in warc_zip.records_of(path)] == [f"page {i}".encode() for i in range(20)]


def test_reads_packages_of_others(tmp_path):
    data = warc_zip.record(5, "u", b"<p>", 3, warc_zip.digest(b"<p>"), None)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("readme.txt", "packed elsewhere")
        with z.open("archive/data-0.warc.gz", "w", force_zip64=True) as m:
            m.write(data)
        z.writestr("indexes/index.cdxj", f"0 0 0 {len(data)}\n")
        z.comment = b"PK\5\6 not the end"
    path = f"{tmp_path}/b.zip"
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    assert [r["page_id"] for r in warc_zip.records_of(path)] == [5]
    with pytest.raises(ValueError):
        warc_zip.directory(Ranges(__file__))


def test_failed_writer_leaves_nothing(tmp_path):
    with pytest.raises(RuntimeError), Whole(f"{tmp_path}/c") as w:
        w.write(b"x")
        raise RuntimeError
    assert os.listdir(tmp_path) == []


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    for data in (b"first", b"second"):
        with Whole(f"{tmp_path}/c") as w:
            w.write(data)
    assert os.listdir(tmp_path) == ["c"] and (tmp_path / "c").read_bytes() == b"second"


def check_bins(rows, caps):
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), own in bins.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert capacity == min(c for c in caps if c >= at)
    return bins


def test_best_fit_is_brute_force_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = [int(x) for x in rng.integers(1, 4097, 60)]
        where, offset, sizes = packing.best_fit(lengths)
        bins, left = [], sum(lengths)
        for n in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= n]
            if fits:
                b = min(fits, key=lambda b: b[0])
            else:
                c = min((c for c in packing.CAPACITIES if c >= n), key=lambda c: (packing.cost(c) / min(c, left), c))
                b = [c, 0]
                bins.append(b)
            b[0] -= n
            b[1] += n
            left -= n
        assert sorted(b[1] for b in bins) == sorted(np.bincount(where, weights=lengths).astype(int).tolist())
        assert sum(sizes) == sum(min(c for c in packing.CAPACITIES if c >= b[1]) for b in bins)


def least_cost(lengths, caps):
    """Cost of the best packing there is, by trying all ways to put pieces together."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(min(c for c in caps if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(caps):
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        place(i + 1, bins + [lengths[i]])

    place(0, [])
    return best[0]


def test_lengths_chosen_together_are_near_the_optimum_and_never_worse_than_greedy():
    rng = np.random.default_rng(4)
    price = lambda sizes: sum(map(packing.cost, sizes))
    ours = greedy = optimum = 0.0
    for _ in range(60):
        lengths = [int(x) for x in (rng.integers(1, 4097, 7) if rng.random() < 0.5 else rng.integers(1, 700, 7))]
        where, offset, sizes = packing.joint(lengths)
        used = np.bincount(where, weights=lengths)
        assert all(u <= s and s in packing.CAPACITIES for u, s in zip(used, sizes, strict=True))
        for b in range(len(sizes)):
            own = sorted((offset[i], lengths[i]) for i in range(7) if where[i] == b)
            assert [o for o, _ in own] == np.append(0, np.cumsum([n for _, n in own])[:-1]).tolist()
        own, plain, best = price(sizes), price(packing.best_fit(lengths)[2]), least_cost(lengths, packing.CAPACITIES)
        assert best <= own + 1e-9 and own <= plain + 1e-9 and own <= 1.35 * best
        ours, greedy, optimum = ours + own, greedy + plain, optimum + best
    assert ours <= 1.05 * optimum and ours < greedy
    assert packing.mixes((5, 3, 9)) == [(3, 5, 9), (5, 9), (3, 9), (9,)] and len(packing.mixes(tuple(range(1, 30)))) == packing.MIXES


def test_no_id_and_no_long_text_makes_a_group_large(spark):
    df = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "if(id = 7, 4096L * 3000, id % 900 + 1) AS n")
    got = packing.pack(df, "n", group_docs=500)
    sizes = [r.c for r in got.groupBy((F.col("bin_id") / 2**32).cast("int")).agg(F.count(F.lit(1)).alias("c")).collect()]
    assert len(sizes) == 14 and max(sizes) <= 2 * 7000 / 14 and sum(sizes) == 6999


def test_packing_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: len((r.text or "").split()) + 1 for r in docs.collect()}
    rows = QUERIES["op8_best_fit_packing"](spark, sf).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    bins = check_bins(rows, packing.CAPACITIES)
    assert sum(want.values()) >= 0.93 * sum(c for _, c in bins)


def test_packing_edges(spark):
    rows = [(1, 10000, 5), (2, 0, 5), (2, None, 5), (None, 4096, 5), (3, 1, 5)] + [(9, 100, 5)] * 300
    df = spark.createDataFrame(rows, "doc_id long, n long, bin_id int")
    got = packing.pack(df, "n", group_docs=50).collect()
    check_bins(got, packing.CAPACITIES)
    assert sum(r.length for r in got) == 10000 + 1 + 1 + 4096 + 1 + 30000
    assert sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 1) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]
    assert packing.pack(df.limit(0), "n").count() == 0
    assert packing.pack(df.selectExpr("cast(doc_id as int) AS doc_id", "n"), "n").count() == len(got)
    assert packing.sequences(packing.pack(df, "n")).agg({"capacity": "sum"}).first()[0] >= 34099
