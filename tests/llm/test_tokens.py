"""Encoders and record files against the tokenizers library, and back."""

import hashlib
import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, records
from quarry.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\n b c", " x  y z", "it's we'll I'd '' 's", "aaaaaaaaa", "abababab aaa", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "héllo wörld ñ 日本語 テキスト", "😀 👨‍👩‍👧 é", "x" * 5000, "1234 56,78.9", "\x00\x01 \x7f", "tab\tsep\r\nline", "<|endoftext", "a\x1cb \x1c c", "w​z ​ q", "ab " * 3000,
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return HARD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("own", [True, False])
def test_encoders_equal_the_library(tok, texts, own):
    encode = bpe.by_index(bpe.vocabulary(PATH)) if own else records.library_encoder(PATH)
    ids, at = bpe.encode_all(pa.array(texts, pa.string()), encode)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, (t or "")[:50]


@pytest.mark.parametrize("own", [True, False])
def test_white_ends_of_texts_do_not_meet(tok, own):
    """Texts that begin and end with white space, of which tokens of two texts together could be made."""
    encode = bpe.by_index(bpe.vocabulary(PATH)) if own else records.library_encoder(PATH)
    for texts in ([" \u00a0", " \u00a0 \u00a0"], [" \u00a0 \u00a0 \u00a0", " \u00a0", "\u00a0 x", " \n", "  "], ["  x  ", "   y", " a\n", "  b", "c d\n", "e f"], [], [""], [None], ["one"]):
        ids, at = bpe.encode_all(pa.array(texts, pa.string()), encode)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_white_space_of_all_kinds(tok):
    rng = np.random.default_rng(2)
    letters = [*"ab. ", " ", " ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b", "\u180e", "é", "7", "<|endoftext|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(800)]
    for encode in (bpe.by_index(bpe.vocabulary(PATH)), records.library_encoder(PATH)):
        ids, at = bpe.encode_all(pa.array(texts, pa.string()), encode)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_text_is_cut_beside_odd_white_space():
    """A double space doesn't make one unit of the whole text."""
    chunks, counts = bpe.at_single_spaces(pa.array([" a b  c\n d e ", "x" + " y" * 1000 + "  ", ""]))
    assert chunks.to_pylist()[:3] == [" a", "b  c\n d", "e "] and counts.tolist() == [3, 1001, 1]


def test_random_bytes_merge_as_the_library(tok):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abté .\n'"), 300)) for _ in range(60)]
    ids, at = bpe.encode_all(pa.array(texts), bpe.by_index(bpe.vocabulary(PATH)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_decode_equals_the_library(tok, texts):
    v = bpe.vocabulary(PATH)
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert bpe.decode(v, np.array(ids, np.int64)) == tok.decode(ids, skip_special_tokens=False) == (t or "")


def test_frames_find_every_flipped_byte():
    record = records.framed(b"payload")
    assert records.unframed(record) == b"payload"
    for i in range(len(record)):
        bad = bytearray(record)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad))


def test_files_round_trip_in_any_order(spark, tok, tmp_path):
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(HARD)] + [(3, "again", "x"), (3, "again", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    folder, manifest = records.write_tokens(docs, PATH, parts=3, folder=f"file://{tmp_path}/rec")
    assert not [f for f in os.listdir(f"{tmp_path}/rec") if f.endswith(".tmp")]
    want = sorted(((-1 if d is None else d), [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    got = []
    for part, n, _ in sorted(manifest):
        index = records.read_index(f"{folder}/part-{part:06d}.idx")
        assert len(index) == n
        mixed = np.random.default_rng(0).permutation(len(index))
        back = list(records.read_records(f"{folder}/part-{part:06d}.rec", index[mixed]))
        got += [(-1 if back[k][0] is None else back[k][0], back[k][1].tolist()) for k in np.argsort(mixed)]
    assert [x[0] for x in got] == [x[0] for x in want]
    assert sorted(got) == want
    assert records.write_tokens(docs.limit(0), PATH, parts=3)[1] == []


def test_hot_and_null_ids_are_split(spark, tok, tmp_path):
    rows = [(None, f"no id {i}") for i in range(300)] + [(5, f"five {i}") for i in range(300)] + [(-(2**63), "least"), (2**63 - 1, None)] + [(i, "w " * i) for i in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for part in (docs, docs.where("doc_id is null")):
        folder, manifest = records.write_tokens(part, PATH, parts=8)
        assert len(manifest) >= 7 and max(n for _, n, _ in manifest) < 200
        got, last = [], (False, 0)
        for p, _, _ in sorted(manifest):
            for d, ids in records.read_records(f"{folder}/part-{p:06d}.rec", records.read_index(f"{folder}/part-{p:06d}.idx")):
                assert last <= (d is not None, d or 0)
                last = (d is not None, d or 0)
                got.append((str(d), ids.tolist()))
        want = [(str(r.doc_id), [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in part.collect()]
        assert sorted(got) == sorted(want)


def test_number_of_files_follows_the_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(records, "PART_BYTES", 10_000)
    monkeypatch.setattr(records, "EDGE_ROWS", 150)
    assert 30 <= len(records.edges_of(docs)) <= 40
    assert records.edges_of(docs.limit(0)) == [] == records.edges_of(docs.limit(3))


def test_settings_that_chunks_would_not_heed_are_refused():
    with open(PATH) as f:
        d = json.load(f)
    bpe.check_settings(d)
    for path, value in ((("normalizer",), {"type": "NFC"}), (("pre_tokenizer", "add_prefix_space"), True), (("pre_tokenizer",), None), (("model", "byte_fallback"), True), (("model", "dropout"), 0.1), (("model", "type"), "Unigram")):
        own = json.loads(json.dumps({k: v for k, v in d.items() if k != "model"} | {"model": {k: v for k, v in d["model"].items() if k not in ("vocab", "merges")}}))
        at = own
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        with pytest.raises(ValueError):
            bpe.check_settings(own)
    for change in ({"lstrip": True}, {"normalized": True}, {"content": "two words"}):
        with pytest.raises(ValueError):
            bpe.check_settings({**d, "added_tokens": [{**d["added_tokens"][0], **change}]})


def test_op3_and_op9_rows(spark, sf, tok):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    rows = sorted(QUERIES["op3_token_records"](spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    for r in rows:
        ids = np.array([*tok.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = QUERIES["op9_bpe_round_trip"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        t = docs[r.doc_id] or ""
        ids = np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
