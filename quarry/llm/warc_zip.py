"""WARC records in ZIP packages, written by tasks and read by range.

A package is a ZIP file whose members are all stored: WARC members of gzip
records (archive/data-N.warc.gz) and an index (indexes/index.cdxj) with a line
per record: its number, member, offset and length in the member. Members are
written in one pass with sizes after the data, and with ZIP64 fields where a
size, an offset or the number of members asks for it.

The reader never extracts: it finds the end record (and the ZIP64 one), reads the
central directory, the index, and then ranges of the members. It takes packages
of other writers too, as long as the members are stored.

Of records with equal payloads the one with the largest page id is the response,
the others are revisits without payload, whose headers hold the full payload's
digest and length. Defined results: null html is an empty payload, and empty
payloads count as equal; repeated rows are records of their own, one of them the
response; a row with a null page id is
always a response, as nothing could refer to it by number; an empty table gives no
package."""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.files import Ranges, Whole, opened
from quarry.llm.shared import shared_dir, small_batches, written

MEMBER_BYTES = 64 << 20
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF
#: Fixed values of the format: signatures and layouts of ZIP structures.
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\7\x08", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_LOCATOR = struct.Struct("<4sIQI")
DATE = (0, 0x21)  # 1980-01-01: packages of equal records are equal


class ZipWriter:
    """Writes stored members in one pass. small: sizes from which ZIP64 is used."""

    def __init__(self, out: Whole, small: int = MAX32) -> None:
        self.out, self.small = out, small
        self.members: list[tuple[bytes, int, int, int]] = []
        self.open: tuple[bytes, int] | None = None

    def begin(self, name: str) -> None:
        raw = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        at = self.out.write(_LOCAL.pack(LOCAL, 45, 0x808, 0, *DATE, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        self.open, self.crc, self.size = (raw, at), 0, 0

    def write(self, data: bytes) -> int:
        at, self.size = self.size, self.size + len(data)
        self.crc = zlib.crc32(data, self.crc)
        self.out.write(data)
        return at

    def end(self) -> None:
        raw, at = self.open
        self.out.write(DESCRIPTOR + struct.pack("<IQQ", self.crc, self.size, self.size))
        self.members.append((raw, at, self.size, self.crc))
        self.open = None

    def close(self) -> None:
        start = self.out.at
        for raw, at, size, crc in self.members:
            wide = [x for x in (size, size, at) if x >= self.small]
            s, o = (MAX32 if size >= self.small else size), (MAX32 if at >= self.small else at)
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            self.out.write(_CENTRAL.pack(CENTRAL, 45, 45, 0x808, 0, *DATE, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, n = self.out.at - start, len(self.members)
        if start >= self.small or size >= self.small or n >= MAX16:
            at = self.out.write(_END64.pack(END64, 44, 45, 45, 0, 0, n, n, size, start))
            self.out.write(_LOCATOR.pack(LOCATOR, 0, at, 1))
        self.out.write(_END.pack(END, 0, 0, min(n, MAX16), min(n, MAX16), MAX32 if size >= self.small else size, MAX32 if start >= self.small else start, 0))


def directory(file: Ranges) -> dict[str, tuple[int, int]]:
    """Where each stored member's data begin, and their size."""
    tail_at = max(0, file.size - 65536 - _END.size - _LOCATOR.size)
    tail = file.read(tail_at, file.size - tail_at)
    i = tail.rfind(END)
    while i >= 0:
        if i + _END.size <= len(tail) and i + _END.size + _END.unpack_from(tail, i)[7] == len(tail):
            break
        i = tail.rfind(END, 0, i)
    if i < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, size, start, _ = _END.unpack_from(tail, i)
    if (n == MAX16 or size == MAX32 or start == MAX32) and tail[i - _LOCATOR.size : i - _LOCATOR.size + 4] == LOCATOR:
        at64 = _LOCATOR.unpack_from(tail, i - _LOCATOR.size)[2]
        end64 = _END64.unpack(file.read(at64, _END64.size))
        if end64[0] != END64:
            raise ValueError("no ZIP64 end record")
        n, size, start = end64[7:10]
    raw, at, found = file.read(start, size), 0, {}
    for _ in range(n):
        e = _CENTRAL.unpack_from(raw, at)
        if e[0] != CENTRAL:
            raise ValueError("bad central directory")
        stored, size, full, name_n, extra_n, comment_n, offset = e[4], e[8], e[9], e[10], e[11], e[12], e[16]
        name = raw[at + _CENTRAL.size : at + _CENTRAL.size + name_n]
        extra, x = raw[at + _CENTRAL.size + name_n : at + _CENTRAL.size + name_n + extra_n], 0
        while x + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, x)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, x + 4))
                full = next(wide) if full == MAX32 else full
                size = next(wide) if size == MAX32 else size
                offset = next(wide) if offset == MAX32 else offset
            x += 4 + k
        at += _CENTRAL.size + name_n + extra_n + comment_n
        if stored == 0:
            local = _LOCAL.unpack(file.read(offset, _LOCAL.size))
            if local[0] != LOCAL:
                raise ValueError("bad local header")
            found[name.decode()] = (offset + _LOCAL.size + local[9] + local[10], size)
    return found


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A gzip member with one response, or a revisit where refers_to is set."""
    name = lambda x: f"<urn:quarry:page:{'none' if x is None else x}>"
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c not in "\r\n"), "WARC-Date: 1980-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parsed(data: bytes) -> dict:
    """Headers of a WARC record by lower-case name, with kind, page_id, refers_to, size and payload (None for a revisit)."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    number = lambda x: None if x is None or x.endswith("none>") else int(x.rpartition(":")[2][:-1])
    revisit = h["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or h["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise ValueError("a record's payload is not what its headers say")
    return h | {"kind": h["warc-type"], "page_id": number(h["warc-record-id"]), "refers_to": number(h.get("warc-refers-to")), "size": size, "payload": None if revisit else payload}


class Packer:
    """Collects records into one package."""

    def __init__(self, uri: str, member_bytes: int = MEMBER_BYTES, small: int = MAX32) -> None:
        self.whole = Whole(uri)
        self.zip = ZipWriter(self.whole, small)
        self.most, self.lines, self.members = member_bytes, [], 0

    def add(self, data: bytes) -> None:
        if self.zip.open and self.zip.size >= self.most:
            self.zip.end()
        if not self.zip.open:
            self.zip.begin(f"archive/data-{self.members}.warc.gz")
            self.members += 1
        self.lines.append(b"%d %d %d %d\n" % (len(self.lines), self.members - 1, self.zip.write(data), len(data)))

    def close(self, error: type | None = None) -> None:
        if error is None:
            if self.zip.open:
                self.zip.end()
            self.zip.begin("indexes/index.cdxj")
            for i in range(0, len(self.lines), 4096):
                self.zip.write(b"".join(self.lines[i : i + 4096]))
            self.zip.end()
            self.zip.close()
        self.whole.__exit__(error)


def records_of(uri: str, numbers: list[int] | None = None) -> Iterator[dict]:
    """The records of a package, or those with the given numbers, by range reads."""
    file = Ranges(uri)
    try:
        members = directory(file)
        lines = file.read(*members["indexes/index.cdxj"]).split(b"\n")[:-1]
        for line in lines if numbers is None else (lines[i] for i in numbers):
            _, member, at, n = map(int, line.split())
            start, size = members[f"archive/data-{member}.warc.gz"]
            if at + n > size:
                raise ValueError("an index line points beyond its member")
            yield parsed(file.read(start + at, n))
    finally:
        file.close()


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")


def _numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and row: the partition's number and the row's in it."""
    return pages.select("page_id", "url", _payload("html").alias("payload")).withColumn("row", F.monotonically_increasing_id())


def revisits(pages: DataFrame) -> DataFrame:
    """Which rows of pages(page_id, url, html) are revisits, and of which page: (row, sha1, refers_to).

    Only row numbers, digests and ids are written and shuffled. Digests are summed
    map-side to those that occur twice or more, with the row of the largest id (of
    several such rows, the first); the join of these with the rows is between two
    written tables, so adaptive execution splits a digest that very many rows have."""
    rows = written(_numbered(pages).select("page_id", "row", F.unhex(F.sha1("payload")).alias("sha1")).where("page_id is not null"))
    top = F.max(F.struct("page_id", (-F.col("row")).alias("row"))).alias("top")
    tops = written(rows.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), top).where("n > 1").select("sha1", F.col("top.page_id").alias("top_id"), (-F.col("top.row")).alias("top_row")))
    return rows.join(tops.hint("merge"), "sha1").where("row <> top_row").select("row", "sha1", F.col("top_id").alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None) -> tuple[str, list[int]]:
    """Writes a package per partition of pages; returns the folder and the packages' numbers.

    The revisits are written to the shared folder by partition, and the task that
    writes a partition's package reads its own, so no payload is shuffled or joined.
    pages is read twice and must have the same rows in the same partitions then, as
    files have; each revisit is held against its row's digest, and a difference
    raises an error."""
    spark = pages.sparkSession
    small_batches(spark, 512)
    folder = folder or shared_dir(spark)
    flags = shared_dir(spark)
    by_part = revisits(pages).withColumn("part", F.shiftrightunsigned("row", 33))
    by_part.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, packer, n, known = TaskContext.get().partitionId(), None, 0, None
        try:
            for b in batches:
                for p, url, payload, row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "row")), strict=True):
                    if known is None:
                        part, known = row >> 33, _flags(flags, row >> 33)
                    packer = packer or Packer(f"{folder}/pages-{part:06d}.zip")
                    sha1 = hashlib.sha1(payload).digest()
                    own, top = known.pop(row, (sha1, None))
                    if own != sha1:
                        raise ValueError("pages has other rows than when its digests were taken")
                    packer.add(record(p, url, b"" if top is not None else payload, len(payload), base64.b32encode(sha1).decode(), top))
                    n += 1
            if known:
                raise ValueError("pages has fewer rows than when its digests were taken")
        except BaseException as e:
            if packer:
                packer.close(type(e))
            raise
        if packer:
            packer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64())})

    made = written(_numbered(pages).mapInArrow(run, "part int, n long"))
    return folder, sorted(r.part for r in made.select("part").collect())  # one row per package


def _flags(folder: str, part: int) -> dict[int, tuple[bytes, int]]:
    """The revisits of one partition: row to its digest and the page that it refers to."""
    store, path = opened(f"{folder}/part={part}")
    out: dict[int, tuple[bytes, int]] = {}
    if store.get_file_info(path).type.name == "NotFound":
        return out
    for info in store.get_file_info(fs.FileSelector(path)):
        if info.base_name.endswith(".parquet"):
            t = pq.read_table(store.open_input_file(info.path), columns=["row", "sha1", "refers_to"])
            out |= {r: (h, x) for r, h, x in zip(*(t.column(c).to_pylist() for c in ("row", "sha1", "refers_to")), strict=True)}
    return out


def read_packages(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the packages."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column("part").to_pylist():
                out = []
                for r in records_of(f"{folder}/pages-{part:06d}.zip"):
                    out.append((r["page_id"], r["size"], r["warc-payload-digest"].removeprefix("sha1:"), r["kind"], r["refers_to"]))
                    if len(out) == 10_000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return spark.createDataFrame([(p,) for p in parts], "part int").repartition(len(parts)).mapInArrow(run, schema)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds)})
