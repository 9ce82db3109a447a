"""Inflected forms that keep an e after their stem are not the word without it."""

import math

import pyarrow as pa
import pyarrow.parquet as pq

from quarry.functions.stemmer import stem
from quarry.queries import QUERIES


def test_forms_of_a_closed_syllable_keep_their_e():
    # As hoping is hope and not hop: an e is put after one consonant, vowel, consonant, and not taken off again.
    assert [stem(w) for w in "hop hops hopes hoping hoped".split()] == ["hop", "hop", "hope", "hope", "hope"]
    assert [stem(w) for w in "from froms fromes froming fromed".split()] == ["from", "from", "frome", "frome", "frome"]
    assert {stem(w) for w in "thing things thinges thinging thinged".split()} == {"thing"}
    assert {stem(w) for w in "tion tions tioned tioning tiones".split()} == {"tion"}


def test_text_bm25_counts_no_other_stem(spark, tmp_path):
    texts = ["from here", "fromed there", "froming it", "froms a b", "from fromed fromes", "none"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["score"] for r in QUERIES["text_bm25"](spark, str(tmp_path)).collect()}
    mean = sum(len(t.split()) for t in texts) / len(texts)
    idf = math.log(1 + (len(texts) - 3 + 0.5) / 3.5)
    want = {i: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(texts[i].split()) / mean)) for i in (0, 3, 4)}
    assert got.keys() == want.keys() and all(abs(got[i] - s) < 1e-6 for i, s in want.items())
