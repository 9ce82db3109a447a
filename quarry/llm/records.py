"""Token ids as length-delimited binary records with an offset index.

A record file holds one record per document, in ascending order of id over the
files: 8 bytes of length, 4 of the masked checksum of those, the payload, and 4
of the payload's masked checksum (CRC-32, rotated and shifted by a constant, so
that a checksum of data that hold checksums stays useful). The payload is the
document's id, the number of tokens, a code and the ids: 16-bit numbers where
the vocabulary allows, else 32-bit, compressed by Zstandard. Beside each file
lies an index of fixed-size entries (id, offset, length, tokens), so readers can
fetch records in any order by range.

Texts are encoded where they are read; what is shuffled are payloads, dealt to
files by ranges of (id, row) with about as many bytes each, so the number of files
grows with the input and an id of very many rows has several. A file is one task's, written under another name and
renamed when whole.

Defined results: null text counts as empty, which is the end id alone; repeated
rows are repeated records, in order of their rows; a null id comes first; an empty table gives no file
and no rows. Extra columns are not looked at."""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Encoded, gather, grouped, vocabulary
from quarry.llm.files import Ranges, Whole
from quarry.llm.shared import shared_dir, small_batches, written

_HEAD = struct.Struct("<QI")
_SUM = struct.Struct("<I")
_BODY = struct.Struct("<?qQB")
ENTRY = np.dtype([("null", "<u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
WIDE, NARROW = 4, 2
READ_BYTES = 8 << 20
#: Chunks that the library encodes at a time; longer strings cost it more a byte.
CHUNKS = 1 << 10
#: Bytes of text expected in a file; on little data a file for each core has at least LEAST_BYTES.
PART_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
#: Rows sampled for the edges between files, about; a few MB on the driver.
EDGE_ROWS = 100_000


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits plus a constant."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + _SUM.pack(masked(head)) + payload + _SUM.pack(masked(payload))


def unframed(record: bytes) -> bytes:
    """The payload of a record; ValueError where a length or checksum is wrong."""
    n, check = _HEAD.unpack_from(record)
    if masked(record[:8]) != check or len(record) != n + 16:
        raise ValueError("bad length of a record")
    payload = record[12 : 12 + n]
    if masked(payload) != _SUM.unpack_from(record, 12 + n)[0]:
        raise ValueError("bad checksum of a record")
    return payload


def packed(doc_id: int | None, ids: np.ndarray, wide: bool, press: zstandard.ZstdCompressor) -> bytes:
    return _BODY.pack(doc_id is None, doc_id or 0, len(ids), WIDE if wide else NARROW) + press.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, n, code = _BODY.unpack_from(payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[_BODY.size :], max_output_size=max(1, n * code))
    return None if null else doc_id, np.frombuffer(raw, "<u4" if code == WIDE else "<u2").astype("<u4")


class LibraryEncoder:
    """Encodes distinct chunks of texts with the tokenizers library. Files whose
    settings would make a chunk's tokens depend on its neighbours are refused.

    Chunks after a space are put together to strings, as they would stand in a text;
    where each one's ids end follows from the tokens' lengths in bytes. The first ones
    of texts, which may begin with any white space, are encoded alone."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        v = vocabulary(path)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.size = np.array([len(b) for b in v.bytes])
        self.wide = v.size > 65536
        self.kind = np.dtype("<u4" if self.wide else "<u2")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, strings: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner, outer = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        found: list[np.ndarray] = [np.zeros(0, self.kind)]
        counts = [np.zeros(0, np.int64)]
        own = strings.take(pa.array(inner))
        bytes_of = pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # with the space
        edges = np.append(np.arange(0, len(inner), CHUNKS), len(inner)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), own), " ") if len(inner) else []
        for i, j, text in zip(edges[:-1].tolist(), edges[1:].tolist(), joined, strict=False):
            ids = self.ids([" " + text.as_py()])[0]
            at, ends = np.cumsum(self.size[ids]), np.cumsum(bytes_of[i:j])
            cut = np.searchsorted(at, ends) + 1
            if (at[cut - 1] != ends).any():
                raise ValueError("a token reaches over the end of a chunk")
            counts.append(np.diff(cut, prepend=0))
            found.append(ids)
        alone = strings.take(pa.array(outer)).to_pylist()
        for i in range(0, len(alone), CHUNKS):
            some = self.ids(alone[i : i + CHUNKS])
            counts.append(np.array([len(x) for x in some], np.int64))
            found += some
        # Back to the order of the chunks.
        n, order = np.concatenate(counts), np.concatenate([inner, outer])
        lengths, starts = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        lengths[order], starts[order] = n, np.cumsum(n) - n
        return gather(np.concatenate(found), starts, lengths, np.arange(len(n)))[0], lengths


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker."""
    return LibraryEncoder(path)


#: A place in the order of records: whether the id is there, the id, and the row's number.
Place = tuple[bool, int, int]


def token_payloads(docs: DataFrame, path: str, end_id: int, edges: list[Place]) -> DataFrame:
    """docs(doc_id, text) to (part, doc_id, row, n, payload); part is the range between the edges that a row lies in."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, encoder = zstandard.ZstdCompressor(level=3), library_encoder(path)
        for t in grouped(batches):
            doc_ids, rows = t.column("doc_id").to_pylist(), t.column("row").to_numpy()
            for which, ids, at in Encoded(t.column("text"), encoder).parts():
                own, row = [doc_ids[k] for k in which.tolist()], rows[which]
                payloads = [packed(d, np.append(ids[s:e], ids.dtype.type(end_id)), encoder.wide, press) for d, s, e in zip(own, at.tolist(), at[1:].tolist(), strict=False)]
                part = [bisect.bisect_right(edges, (d is not None, d or 0, r)) for d, r in zip(own, row.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(own, pa.int64()), pa.array(row), pa.array(np.diff(at) + 1, pa.int64()), pa.array(payloads, pa.binary())], ["part", "doc_id", "row", "n", "payload"])

    return docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "part int, doc_id long, row long, n long, payload binary")


def write_records(payloads: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes each part as a file with its index: (part, rows, tokens), in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, entries, part, rows, tokens = None, None, None, 0, 0
        try:
            for b in batches:
                for p, d, n, payload in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "payload")), strict=True):
                    if out is None:
                        part = p
                        out, entries = Whole(f"{folder}/part-{p:06d}.rec"), Whole(f"{folder}/part-{p:06d}.idx")
                    assert p == part, "a task has two parts"
                    record = framed(payload)
                    at = out.write(record)
                    entries.write(np.array([(d is None, d or 0, at, len(record), n)], ENTRY).tobytes())
                    rows, tokens = rows + 1, tokens + n
        except BaseException as e:
            for f in (out, entries):
                if f is not None:
                    f.__exit__(type(e))
            raise
        if out is not None:
            out.__exit__(None)
            entries.__exit__(None)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "rows": pa.array([rows], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    dealt = payloads.repartitionById(parts, "part").sortWithinPartitions(F.asc_nulls_first("doc_id"), "row")
    return written(dealt.mapInArrow(run, "part int, rows long, tokens long"))


def read_index(uri: str) -> np.ndarray:
    f = Ranges(uri)
    try:
        return np.frombuffer(f.read(0, f.size), ENTRY)
    finally:
        f.close()


def read_records(uri: str, entries: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the entries, in their order; neighbours are fetched together."""
    f = Ranges(uri)
    try:
        i = 0
        while i < len(entries):
            first, j, end = int(entries["offset"][i]), i, int(entries["offset"][i])
            while j < len(entries) and int(entries["offset"][j]) == end and (j == i or end - first < READ_BYTES):
                end += int(entries["length"][j])
                j += 1
            data = f.read(first, end - first)
            for k in range(i, j):
                s = int(entries["offset"][k]) - first
                yield unpacked(unframed(data[s : s + int(entries["length"][k])]))
            i = j
    finally:
        f.close()


def read_back(spark, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, from the files.

    manifest: (part, rows, tokens), one a file; what it says is checked."""
    starts, at = [], 0
    for part, rows, tokens in sorted(manifest):
        starts.append((part, at, rows, tokens))
        at += tokens
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, rows, tokens in zip(*(b.column(c).to_pylist() for c in ("part", "start", "rows", "tokens")), strict=True):
                index = read_index(f"{folder}/part-{part:06d}.idx")
                if len(index) != rows or int(index["tokens"].sum()) != tokens:
                    raise ValueError(f"part {part} is not whole")
                out = []
                for d, ids in read_records(f"{folder}/part-{part:06d}.rec", index):
                    out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    files = spark.createDataFrame(starts, "part int, start long, rows long, tokens long").repartition(len(starts))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})


def edges_of(docs: DataFrame, parts: int | None = None) -> list[Place]:
    """Edges between ranges of (id, row) with about as many bytes of text: as many
    ranges as PART_BYTES ask for, and on little data one for each core.

    They come from at most some EDGE_ROWS sampled rows and only decide how even the
    files are. An id that very many rows have, the null id too, is split by row."""
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).withColumn("row", F.monotonically_increasing_id())
    rows, total = sizes.agg(F.count(F.lit(1)), F.sum("n")).first()
    if parts is None:
        least = min(docs.sparkSession.sparkContext.defaultParallelism, (total or 0) // LEAST_BYTES + 1)
        parts = max(least, -(-(total or 0) // PART_BYTES))
    if parts < 2 or not rows:
        return []
    if rows > EDGE_ROWS:
        sizes = sizes.where(F.pmod(F.xxhash64("row"), F.lit(-(-rows // EDGE_ROWS))) == 0)
    t = sizes.toArrow()
    places = sorted((d is not None, d or 0, r, n) for d, r, n in zip(*(t.column(c).to_pylist() for c in ("doc_id", "row", "n")), strict=True))
    at = np.cumsum([n + 1 for *_, n in places])
    cut = np.searchsorted(at, np.arange(1, parts) * (at[-1] / parts)) if len(at) else []
    return sorted({places[k][:3] for k in np.minimum(cut, len(places) - 1).tolist()})


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, parts: int | None = None, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Writes docs(doc_id, text) as records; returns the folder and a line per file."""
    edges = edges_of(docs, parts)
    folder = folder or shared_dir(docs.sparkSession)
    manifest = write_records(token_payloads(docs, path, end_id, edges), folder, len(edges) + 1)
    return folder, [tuple(r) for r in manifest.select("part", "rows", "tokens").collect()]  # one row per file
