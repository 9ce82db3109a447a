"""Jaccard join of word shingles by parity sketches.

A document's set is its distinct 5-word shingles, hashed to 64 bits under a key
drawn for the run, so that no text can be written to make words meet. Two sets of
sizes a <= b with a Jaccard similarity of at least t have b <= a / t, and their
symmetric difference has at most (a + b)(1 - t) / (1 + t) members.

Candidates. Sets fall into size bands of a factor of four. In a band, members are
dealt by hash into parts, and a part's parity fingerprint is the exclusive or of
its members' hashes: members of the symmetric difference change at most one part
each, so of two similar sets all but d parts agree (pigeonhole). Parts are put in
one order for all documents; the first that agrees has at most d before it, on
either side, and the third at most d + 2. So each document emits the fingerprints
of its first d + 3 filled parts, d being the most that a partner in the band
allows, and pairs that share three of them are compared. Documents near the
lower edge of a band do the same in the band below. In the order, fuller parts
come first, and parts made of very frequent shingles alone last, so common
passages make keys only where a document has little else. A document with too few filled parts emits empty ones
too, under keys of their own.

Verification. Bit sketches (a shingle flips one bit) give a lower bound of the
symmetric difference for every candidate pair; the pairs that it doesn't refute
are verified on the sets themselves.

Hot keys. Equal sets are one class from the start. In each key's list, documents
are first compared with the list's first document alone; what these links
connect needs no further comparison. Turns of comparisons between neighbours in
the lists that are still apart, each in another order, bring large groups
together. Only pairs of one list that are still apart then follow: from short
lists by a join, from long ones in blocks of a bounded size.
Keys that very many documents have, known from a sample of documents or from their
frequent shingles, are salted, so their lists lie in no one task.
No list is cut, and no list is held in memory as a whole.

Defined results: null text and texts without words have no set (size 0) and are
alone; fewer than five words are one shingle; rows of one id are one document
whose links are those of all its texts; null ids get null components and link
nothing; an empty table gives no rows. Extra columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import components, fresh_key, mix, shingle_sets, small_batches, written

PERCENT = 75
SHINGLE = 5
#: Keys that two documents must share to be compared; each document emits so many beyond the most that can differ.
SHARED = 3
#: Most frequent shingles that are put last; a fixed bound on what is broadcast.
FREQUENT = 1 << 16
#: Shingles counted at a time in a task, and the least count that is reported.
COUNTED, LEAST_COUNT = 2 << 20, 4
#: Lists up to this length are joined pair by pair, longer ones by blocks of BLOCK documents.
SHORT, BLOCK = 48, 2048
#: Turns in which neighbours in lists of more than FEW documents are compared before all pairs that are left.
TURNS, FEW = 4, 48
#: Tasks over which the rows of a key are spread that very many documents may have.
SALTS = 64
#: One of so many documents is asked, by a hash of its id, for keys that very many documents have: those that
#: HOT_SEEN of the asked have, at most HOT of them. They are spread over tasks; nothing else depends on them.
ASKED, HOT_SEEN, HOT = 64, 8, 1 << 16
#: Bits of the map of ids whose texts are verified: 8 MB, whatever their number.
ID_BITS = 1 << 26


def band(n: int) -> int:
    return (n.bit_length() - 1) // 2


def parts_of(k: int) -> int:
    return int(0.45 * 4 ** (k + 1)) + 30


def roles(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, most members of a symmetric difference) for which a set of n members emits keys."""
    k = band(n)
    out = [(k, n * (100 - percent) // percent)]
    if k and -(-percent * n // 100) < 4**k:
        out.append((k - 1, 2 * n * (100 - percent) // (100 + percent)))
    return out


def keys(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of sorted distinct hashes, of which similar sets share at
    least SHARED, and which of them very many documents may have."""
    out, hot = [], []
    common = np.zeros(len(s), bool)
    if len(frequent) and len(s):
        common = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    for k, d in roles(len(s), percent):
        if not d:
            continue  # only an equal set is similar, and equal sets are a class already
        p = parts_of(k)
        # Small sets can't share many parts: there one is enough, and its key is emitted as often as keys must be shared.
        need, tags = (1, SHARED) if k < 2 else (SHARED, 1)
        part = ((mix(s + np.uint64(k + 1)) >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        parity = np.bitwise_xor.reduceat(s[order], starts)
        number = part[starts]
        space = np.uint64(k << 32)
        last = np.logical_and.reduceat(common[order], starts)
        # Fuller parts agree by chance less often, so they come first.
        fill = np.minimum(np.diff(np.append(starts, len(s))), 255)
        first = np.argsort(last * 256 - fill, kind="stable")[: d + need]
        every = np.zeros(p, np.uint64)
        every[number.astype(np.int64)] = parity
        n = min(p, d + need)
        for tag in range(tags):
            mark = space | np.uint64(tag << 50)
            out.append(mix(parity[first] ^ mix(number[first] | mark)))
            hot.append(last[first])
            if len(starts) >= d + need:
                continue
            # Too few filled parts to be sure that so many agree: the first parts, empty or not, under keys of their own.
            out.append(mix(every[:n] ^ mix(np.arange(n, dtype=np.uint64) | mark | np.uint64(1 << 60))))
            hot.append(np.ones(n, bool))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, bool), *hot])


def sketch(s: np.ndarray) -> bytes:
    """Bits that the members of a set flip: 4 to 16 a member, so few meet on a bit
    and the distance of two sketches is close to the symmetric difference."""
    bits = max(256, 4 ** (band(len(s)) + 2))
    at = (mix(s ^ np.uint64(0x5BF03635)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, at most the size of the symmetric
    difference. The longer one is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def may_link(a: int, b: int, x: bytes, y: bytes, percent: int = PERCENT) -> bool:
    return 100 * min(a, b) >= percent * max(a, b) and distance(x, y) <= most_apart(a, b, percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _summaries(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """A row per document: size, 128-bit digest and sketch; and rows with the
    frequent shingles of every so many (kind 1: digest_1 the shingle, n its documents)."""
    names = ["kind", "doc_id", "n", "digest_1", "digest_2", "sketch"]
    held, size, seen = [], 0, set()

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= LEAST_COUNT
        v, c = values[often].view(np.int64), counts[often]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(v), np.int8)), pa.nulls(len(v), pa.int64()), pa.array(c, pa.int64()), pa.array(v), pa.nulls(len(v), pa.int64()), pa.nulls(len(v), pa.binary())], names)

    for b in batches:
        n, d1, d2, sk = [], [], [], []
        for s in shingle_sets(b.column("text"), SHINGLE, key):
            n.append(len(s))
            one = np.bitwise_xor.reduce(s) if len(s) else np.uint64(0)
            with np.errstate(over="ignore"):
                two = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
            d1.append(one)
            d2.append(two)
            sk.append(sketch(s) if len(s) else b"")
            if len(s) and (one, two) not in seen:
                seen.add((one, two))
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield counted()
                    held, size, seen = [], 0, set()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(n), np.int8)), b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.array(sk, pa.binary())], names
        )
    if held:
        yield counted()


def emitted(docs: DataFrame, frequent: np.ndarray, hot: np.ndarray, percent: int, key: int) -> DataFrame:
    """(key, doc_id, salt) of every document; of equal sets a task emits one, as
    long as it remembers them. Keys that very many may have are salted from 1 on."""
    common = docs.sparkSession.sparkContext.broadcast((frequent, hot))  # at most FREQUENT and HOT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        frequent, hot = common.value
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out, who, salt, size = [], [], [], 0
            for d, s in zip(ids, shingle_sets(b.column("text"), SHINGLE, key), strict=True):
                if not len(s) or d is None:
                    continue
                digest = (len(s), np.bitwise_xor.reduce(s), s[0], s[-1])
                if digest in seen:
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(digest)
                own, many = keys(s, frequent, percent)
                if len(hot) and len(own):
                    many = many | (hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own)
                out.append(own)
                who.append(np.full(len(own), d, np.int64))
                salt.append(many * (1 + (d * 0x9E3779B1 >> 8) % SALTS))
                size += len(own)
                if size > 1 << 19:
                    yield _keyed(out, who, salt)
                    out, who, salt, size = [], [], [], 0
            if out:
                yield _keyed(out, who, salt)

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, salt int")


def _keyed(out: list, who: list, salt: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(salt).astype(np.int32))], ["key", "doc_id", "salt"])


def _sorted(df: DataFrame) -> np.ndarray:
    """A column of a bounded number of hashes, sorted as unsigned numbers."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _often(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that occur SHARED times or more; counted map-side first."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= SHARED).select("a", "b")


class Join:
    """The stages of one join, each on tables in the shared folder."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT) -> None:
        self.docs, self.percent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.key = key = fresh_key()
        found = written(self.docs.mapInArrow(lambda x: _summaries(x, key), "kind byte, doc_id long, n long, digest_1 long, digest_2 long, sketch binary"))
        self.rows = found.where("kind = 0").drop("kind")
        top = found.where("kind = 1").groupBy("digest_1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest_1").limit(FREQUENT)
        self.frequent = _sorted(top.select("digest_1"))
        asked = emitted(self.docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ASKED)) == 0), self.frequent, np.zeros(0, np.uint64), percent, key)
        many = asked.groupBy("key").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= HOT_SEEN).orderBy(F.desc("n"), "key").limit(HOT)
        self.hot = _sorted(many.select("key"))

    def classes(self) -> DataFrame:
        """Edges from documents with equal sets to the smallest id among them."""
        some = self.rows.where("n > 0 and doc_id is not null")
        least = some.groupBy("n", "digest_1", "digest_2").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("many")).where("many > 1")
        return some.join(written(least.drop("many")), ["n", "digest_1", "digest_2"]).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()

    def lists(self) -> DataFrame:
        """(key, doc_id, first) of the keys that two documents or more have."""
        w = Window.partitionBy("key", "salt").orderBy("doc_id")
        listed = emitted(self.docs, self.frequent, self.hot, self.percent, self.key).select("key", "salt", "doc_id", F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lead("doc_id").over(w).alias("next"))
        kept = written(listed.where("salt > 0 or doc_id <> first or next is not null").drop("next"))
        # Rows of salted keys are few; their lists' first documents come from a sum by key, and adaptive execution splits the join.
        salted = kept.where("salt > 0").select("key", "doc_id")
        tops = written(salted.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        return written(kept.where("salt = 0").select("key", "doc_id", "first").unionByName(salted.join(tops.hint("merge"), "key")))

    def unrefuted(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches allow a link."""
        sk = self.rows.where("n > 0").groupBy("doc_id", "n", "sketch").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
        side = lambda x: sk.toDF(x, f"n_{x}", f"s_{x}")
        wide = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = (b.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array([may_link(*x, percent) for x in zip(*cols, strict=True)], pa.bool_()))

        return wide.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, from the sets of their texts."""
        left = written(self.unrefuted(pairs))
        at = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
        bits = left.select(F.explode(F.array("a", "b")).alias("i")).select(at("i").alias("at"))
        groups = bits.groupBy(F.expr("cast(at div 32 as int)").alias("g")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("m")).toArrow()
        some = np.zeros(ID_BITS // 32, np.uint32)
        some[groups.column("g").to_numpy()] = groups.column("m").to_numpy().astype(np.uint32)
        some = self.spark.sparkContext.broadcast(some)
        key, percent = self.key, self.percent

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column("at").to_numpy()
                b = b.filter(pa.array((some.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in shingle_sets(b.column("text"), SHINGLE, key)], pa.large_binary())], ["doc_id", "members"])

        # Where a bit of the map is another id's, a set too many is made; the joins leave it out. No text is shuffled.
        sets = written(self.docs.where("doc_id is not null").select("doc_id", "text", at("doc_id").alias("at")).mapInArrow(hashed, "doc_id long, members binary"))
        side = lambda x: sets.toDF(x, f"m_{x}")
        wide = left.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column("m_a"), b.column("m_b"), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return written(wide.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long").distinct())

    def apart(self, lists: DataFrame, found: DataFrame) -> DataFrame:
        """Rows of the lists whose documents found(node, root) doesn't all connect: (key, doc_id, root)."""
        rooted = lists.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        rooted = written(rooted)
        mixed = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "m")
        return written(rooted.join(written(mixed).hint("merge"), "key"))

    def neighbours(self, apart: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) that are next to each other in an order of their list that
        depends on the turn, where they are still apart: as many as rows. A large
        group of similar documents comes together by a few of these."""
        some = apart.where(F.col("m") > FEW).withColumn("place", F.xxhash64("doc_id", F.lit(turn)))
        block = F.pmod(F.col("place"), F.ceil(F.col("m") / F.lit(BLOCK)))
        w = Window.partitionBy("key", "block").orderBy("place", "doc_id")
        beside = some.withColumn("block", block).select("doc_id", "root", F.lead("doc_id").over(w).alias("other"), F.lead("root").over(w).alias("root_2"))
        return beside.where("other is not null and root <> root_2").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()

    def across(self, apart: DataFrame) -> DataFrame:
        """Pairs (a, b) of documents with different roots that share SHARED lists."""
        few, many = apart.where(F.col("m") <= SHORT), apart.where(F.col("m") > SHORT)
        x, y = few.select("key", F.col("doc_id").alias("a"), F.col("root").alias("ra")), few.select("key", F.col("doc_id").alias("b"), F.col("root").alias("rb"))
        pairs = x.join(y, "key").where("a < b and ra <> rb").select("a", "b")
        return _often(pairs if many.isEmpty() else pairs.union(self.blocked(many)))

    def blocked(self, many: DataFrame) -> DataFrame:
        """Pairs of long lists that sketches allow, once a list: every two blocks of a list
        are compared in one task of about 2 * BLOCK rows; a hash deals the blocks."""
        numbered = many.withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        sk = self.rows.where("n > 0").select("doc_id", "n", "sketch").dropDuplicates(["doc_id", "n", "sketch"])
        sent = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "root")
        wide = sent.join(sk.hint("merge"), "doc_id")
        percent = self.percent

        def run(key: tuple, t: pa.Table) -> pa.Table:
            i, j = key[1].as_py(), key[2].as_py()
            block, ids, roots, n = (t.column(c).to_numpy() for c in ("block", "doc_id", "root", "n"))
            bits = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("sketch")]
            a_all, b_all = [], []
            right_all = np.flatnonzero(block == j)
            by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for k in right_all:
                by_len.setdefault(len(bits[k]), []).append(k)  # type: ignore[arg-type]
            stacked = {length: (np.array(rows), np.stack([bits[k] for k in rows])) for length, rows in by_len.items()}
            for k in np.flatnonzero(block == i):
                x = bits[k]
                for length, (rows, sketches) in stacked.items():
                    if length >= len(x):
                        folded, own = np.bitwise_xor.reduce(sketches.reshape(len(rows), -1, len(x)), axis=1), x
                    else:
                        folded, own = sketches, np.bitwise_xor.reduce(x.reshape(-1, length), axis=0)
                    far = np.bitwise_count(folded ^ own).sum(axis=1)
                    fits = (rows != k if i != j else rows > k) & (far <= (n[rows] + n[k]) * (100 - percent) // (100 + percent)) & (100 * np.minimum(n[rows], n[k]) >= percent * np.maximum(n[rows], n[k])) & (roots[rows] != roots[k]) & (ids[rows] != ids[k])
                    a_all.append(np.minimum(ids[rows][fits], ids[k]))
                    b_all.append(np.maximum(ids[rows][fits], ids[k]))
            none = np.zeros(0, np.int64)
            return pa.table({"a": pa.array(np.concatenate([none, *a_all])), "b": pa.array(np.concatenate([none, *b_all]))})

        return wide.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links between documents, enough to connect all that are similar, and the components (node, root)."""
        lists = self.lists()
        stars = written(_often(lists.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))))
        edges = self.classes().union(self.verified(stars))
        edges = written(edges)
        found = components(edges)
        apart = self.apart(lists, found)
        for turn in range(TURNS):
            if apart.where(F.col("m") > FEW).isEmpty():
                break
            near = written(self.neighbours(apart, turn))
            more = self.verified(near)
            gained = more.count()
            if not gained:
                break
            edges = edges.union(more)
            found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
            apart = self.apart(lists, found)
            if gained * 20 < near.count():
                break  # what is left is hardly similar
        if apart.isEmpty():
            return edges, found
        pairs = self.across(apart).join(stars, ["a", "b"], "left_anti")
        more = self.verified(written(pairs))
        if more.isEmpty():
            return edges, found
        both = written(edges.union(more))
        return both, components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        _, found = self.links()
        return self.rows.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("doc_id"), "root").hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles and component_id, the smallest id
    that links of at least percent/100 Jaccard similarity reach."""
    return Join(docs, percent).documents()
