"""Best-fit packing into bins of several permitted sequence lengths.

Pieces are dealt into groups of bounded size by a hash of their row and place;
each group is packed on its own. Pieces, longest first, go to the open bin that
they fill best (the least room left). Where none has room, a bin opens: of the
lengths that hold the piece, the one whose cost per token expected in it is least,
given how much there is still to place in the group. At the end every bin is cut
down to the smallest permitted length that holds its contents.

Which lengths should open at all depends on the pieces, so the lengths are chosen
together: a group is packed once for every mix of permitted lengths (of very many,
as many mixes as MIXES), downsized to any permitted length, and the packing that
costs least is kept. One of the mixes is all of them, so this never costs more than
that rule alone.

The cost of a bin is its length plus a fixed overhead and a share that grows with
the square of the length, so longer bins pay only where they are filled.

A document longer than the largest length is cut into full pieces and a rest.
Defined results: null and empty texts have length 1 (their end mark); repeated
rows are pieces of their own; a null id, or one that very many rows have, is dealt
like any other; an empty table gives no bins."""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written
from quarry.shipping import ship

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD, SQUARE = 16.0, 1 / 65536
#: Pieces expected in a group; the number of groups grows with the table.
GROUP_DOCS = 20_000
#: Mixes of lengths that a group is packed with, at most: all of up to five lengths.
MIXES = 31


def cost(capacity: int) -> float:
    return capacity + OVERHEAD + SQUARE * capacity * capacity


def word_length(text: str = "text") -> Column:
    """Words of a text and its end mark: the length that bins hold by default."""
    return (F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def mixes(capacities: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Sets of the lengths that hold the largest one, all lengths first, then those that leave out least."""
    caps, out = sorted(capacities), []
    for left in range(len(caps)):
        out += [tuple(c for c in caps if c not in gone) for gone in itertools.islice(itertools.combinations(caps[:-1], left), MIXES - len(out))]
    return out


def joint(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """best_fit() with the mix of lengths whose bins cost least together (of equal ones, the first)."""
    found = (best_fit(lengths, mix, capacities, split) for mix in mixes(capacities) for split in (False, True))
    return min(found, key=lambda x: sum(map(cost, x[2])))


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, downsized: tuple[int, ...] | None = None, whole: bool = False) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset in the bin, final length of each bin).

    Pieces keep their numbers; none may be longer than the largest capacity. Bins
    open with one of the capacities and end with one of `downsized` (the same ones
    if None). whole: a piece that fills a permitted length to 15/16 gets a bin of
    that length for itself."""
    caps, final = sorted(capacities), sorted(downsized or capacities)
    left = sum(lengths)
    open_at: dict[int, list[int]] = {}  # room left to the bins that have it
    rooms: list[int] = []  # sorted
    where, offset, used = [0] * len(lengths), [0] * len(lengths), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if whole:
            size = final[bisect.bisect_left(final, n)]
            if 16 * n >= 15 * size:
                where[i], left = len(used), left - n
                used.append(n)
                continue
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            room = rooms[k]
            b = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop(k)
        else:
            size = min((c for c in caps if c >= n), key=lambda c: (cost(c) / min(c, left), c))
            b, room = len(used), size
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        left -= n
        room -= n
        if room:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append(b)
    return where, offset, [final[bisect.bisect_left(final, u)] for u in used]


def pack(docs: DataFrame, length: str, capacities: tuple[int, ...] = CAPACITIES, group_docs: int = GROUP_DOCS) -> DataFrame:
    """docs(doc_id, length) to a row per piece: doc_id, piece, start (in the
    document), length, bin_id, offset (in the bin), capacity.

    bin_id is the group's number times 2**32 plus the bin's in the group. Only ids
    and lengths are shuffled. Rows are numbered in a written table, and a piece's group
    comes from a hash of its row's number and its place in the row, so no id makes a
    group large, nor do the many pieces of a long text."""
    ship(docs.sparkSession)
    top = max(capacities)
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.col(length), F.lit(1)).cast("long").alias("n")).withColumn("row", F.monotonically_increasing_id()))
    many = rows.agg(F.sum(F.expr(f"(n - 1) div {top} + 1"))).first()[0] or 0
    groups = max(1, math.ceil(many / group_docs))
    # A piece per full bin and one for the rest; a very long document's pieces may lie in several groups.
    pieces = rows.select("doc_id", "row", F.expr(f"explode(transform(sequence(0L, (n - 1) div {top}), i -> named_struct('piece', cast(i as int), 'start', i * {top}, 'length', least({top}L, n - i * {top}))))").alias("p")).select("doc_id", "row", "p.*")
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        where, offset, sizes = joint(table.column("length").to_pylist(), capacities)
        bins = np.array(where, np.int64)
        return pa.table(
            {
                "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"),
                "bin_id": pa.array(bins + (key[0].as_py() << 32)), "offset": pa.array(offset, pa.int64()), "capacity": pa.array(np.array(sizes, np.int64)[bins]),
            }
        )

    return dealt.groupBy("grp").applyInArrow(run, "doc_id long, piece int, start long, length long, bin_id long, offset long, capacity long")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows of pack() by bin, for writers that want whole bins at a time."""
    return packed.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "start"))).alias("pieces"))  # at most `capacity` pieces
