"""Secret scan with corpus-wide ownership frequency.

Patterns find candidate values and where they stand. Each candidate's hash is
counted over the whole corpus by distinct repositories and distinct owners. A value
that both several owners and several repositories carry is a widely copied example;
one that few owners carry, in however many repositories of theirs, or that many
people share in few repositories, is specific to them, and taken for a live
credential if it looks random. Base kinds
(assign, access, hex) are always reported; candidates of the wider kinds
(token, pem, url) are reported as added spans where they are owner-specific.

Everything is DataFrame operations: no Python runs on the executors.

Defined results: null text counts as empty and has no spans; a null repository
or owner is one value of its own; repeated rows are separate rows with equal
results; very long texts are scanned whole; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

#: Kind, pattern, group of the value, least length of that group.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
#: Wider kinds, whose matches are reported only when their ownership says so.
WIDER = (
    ("token", r"((?:gh[pousr]_|xox[abprs]-|sk-|glpat-|eyJ)[A-Za-z0-9_.-]{16,})", 1, 20),
    ("pem", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,})", 1, 40),
    ("url", r"([a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{6,}@)", 1, 10),
)
KINDS = tuple(k for k, *_ in (*BASE, *WIDER))
#: From so many distinct owners and so many distinct repositories on, a value is a widely copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 3
#: Elements whose running sum is taken in one go, and levels of such runs.
RUN, LEVELS = 64, 3
#: Rows of one hot value are spread over so many keys when its verdict is joined.
SALTS = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _slice(a: Column, i: Column, n: Column) -> Column:
    return F.slice(a, (i + 1).cast("int"), n.cast("int"))


def running(values: Column, add: Callable[[Column, Column], Column], zero: Column, levels: int = LEVELS) -> Column:
    """Of an array of longs, what those before each one come to; linear in its
    length, as no array is copied but runs of RUN, and runs of these on LEVELS levels.
    add is associative, as + and greatest are, and zero its neutral element."""
    fold = lambda a: F.aggregate(a, zero, add)

    def within(a: Column, before: Column | None) -> Column:
        def at(x: Column, i: Column) -> Column:
            if before is None:
                return fold(_slice(a, F.lit(0), i))
            first = i - F.pmod(i, F.lit(RUN))
            return add(F.get(before, (first / RUN).cast("int")), fold(_slice(a, first, i - first)))

        return F.transform(a, at)

    def from_level(a: Column, level: int) -> Column:
        if not level:
            return within(a, None)
        count = F.ceil(F.size(a) / F.lit(RUN)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), count - 1), lambda k: fold(_slice(a, k * RUN, F.least(F.lit(RUN), F.size(a) - k * RUN))))
        return let(runs, lambda r: let(from_level(r, level - 1), lambda before: within(a, before)))

    return F.when(F.size(values) > 0, let(values, lambda a: from_level(a, levels))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _found(kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: array of (start, end, kind, value), in code points.

    The pieces between matches and the matches themselves, both in order, give
    the starts as running sums; only texts with a match pay for the split."""
    t, p = F.col("_t"), F.lit(pattern)
    matches, values, pieces = F.regexp_extract_all(t, p, F.lit(0)), F.regexp_extract_all(t, p, F.lit(group)), F.split(t, pattern, -1)

    def spans(ms: Column, ps: Column) -> Column:
        steps = F.zip_with(F.slice(ps, 1, F.size(ms)), ms, lambda x, m: (F.length(x) + F.length(m)).cast("long"))
        starts = F.zip_with(F.slice(ps, 1, F.size(ms)), running(steps, lambda a, x: a + x, F.lit(0).cast("long")), lambda x, before: F.length(x) + before)
        ends = F.zip_with(starts, ms, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end")))
        made = F.zip_with(ends, values, lambda x, v: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value")))
        return F.filter(made, lambda x: F.length(x["value"]) >= least)

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: string, value: string>>)")
    return F.when(t.rlike(pattern), let(matches, lambda ms: let(pieces, lambda ps: spans(ms, ps)))).otherwise(none)


def _digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in order of start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda x: F.struct(x["start"], F.array_position(order, x["kind"]).alias("o"), x["end"], x["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def live_looking(value: Column) -> Column:
    """Random-looking: both letters and digits, and at least eight different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _base and _wider, arrays of spans with the hash of the value and its look."""
    df = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({f"_k_{k[0]}": _found(*k) for k in (*BASE, *WIDER)})
    slim = lambda x: F.struct(x["start"], x["end"], x["kind"], F.unhex(F.sha2(x["value"], 256)).alias("hash"), live_looking(x["value"]).alias("live"))
    for name, kinds in (("_base", BASE), ("_wider", WIDER)):
        df = df.withColumn(name, F.transform(F.concat(*[F.col(f"_k_{k[0]}") for k in kinds]), slim))
    return df.drop("_t", *[f"_k_{k}" for k in KINDS])


def ownership(found: DataFrame) -> DataFrame:
    """found(hash, repo, owner) to (hash, repos, owners): distinct counts, summed map-side first.

    Distinct (hash, repo, owner) come first, so a value in very many rows is a
    few rows by the time that it is counted."""
    triples = found.select("hash", "repo", "owner").distinct()
    few = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))
    return triples.groupBy("hash").agg(few("repo").alias("repos"), few("owner").alias("owners"))


def scan(docs: DataFrame, repo: str = "source", owner: str = "source", carry: list[str] = (), owners: int = COPIED_OWNERS, repos: int = COPIED_REPOS) -> DataFrame:
    """A row per row of docs(doc_id, text, ...): doc_id, spans as arrays (base,
    added), counts by kind, how many of all candidates are widely copied,
    owner-specific, and owner-specific and live-looking, and the columns named in
    carry as the struct `carried`.

    Texts are scanned once; candidates go to the shared folder. Only rows that
    have any are joined with what ownership says of them: a value that at least so many
    `owners` and `repos` carry is widely copied."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    named = docs.select("doc_id", *carried, F.col("text").alias("_text"), F.col(repo).cast("string").alias("_repo"), F.col(owner).cast("string").alias("_owner"))
    rows = written(candidates(named, "_text").drop("_text").withColumn("_row", F.monotonically_increasing_id()))
    some = F.size("_base") + F.size("_wider") > 0
    spans = rows.select("_row", "_repo", "_owner", F.explode(F.concat(F.transform("_base", lambda x: F.struct(F.lit(False).alias("wider"), x.alias("x"))), F.transform("_wider", lambda x: F.struct(F.lit(True).alias("wider"), x.alias("x"))))).alias("s"))
    spans = spans.select("_row", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), "s.wider", "s.x.*")
    owned = ownership(spans).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = spans.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(owned.hint("merge"), ["hash", "_salt"])
    wide = (F.col("owners") >= owners) & (F.col("repos") >= repos)
    added = judged.groupBy("_row").agg(
        F.count_if(wide).alias("n_copied"), F.count_if(~wide).alias("n_owned"), F.count_if(~wide & F.col("live")).alias("n_live"),
        F.collect_list(F.when(F.col("wider") & ~wide & F.col("live"), F.struct("start", "end", "kind"))).alias("added"),
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: string>>)")
    zero = F.lit(0).cast("long")
    empty = rows.where(~some).withColumns({"n_copied": zero, "n_owned": zero, "n_live": zero, "added": none})
    df = rows.where(some).join(added.hint("merge"), "_row").unionByName(empty)
    base = F.transform("_base", lambda x: F.struct(x["start"], x["end"], x["kind"]))
    counted = {f"n_{k}": F.expr(f"size(filter(_base, x -> x.kind = '{k}'))").cast("long") for k, *_ in BASE}
    df = df.withColumns({"base": base, **counted})
    return df.select("doc_id", *counted, "n_copied", "n_owned", "n_live", "base", "added", *(["carried"] if carry else []))


def digests(found: DataFrame) -> DataFrame:
    """scan()'s rows with base_sha256 and spans as text."""
    return found.withColumns({"base_sha256": F.sha2(_digest(F.col("base")), 256), "spans": _digest(F.concat("base", "added"))})


#: Code points of a text that are looked for at a time when its spans are replaced.
BLOCK = 1024


def redact(text: Column, spans: Column) -> Column:
    """text with each span (possibly overlapping) replaced by [SECRET].

    The text is cut once into blocks of BLOCK code points, and what stands between
    spans is put together from these, so the work grows with the text and the number
    of spans, not with their product."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(b: Column, start: Column, end: Column) -> Column:
        def part(k: Column) -> Column:
            here = k * BLOCK
            first = F.greatest(start - here, F.lit(0).cast("long"))
            return F.substr(F.get(b, k.cast("int")), (first + 1).cast("int"), (F.least(end - here, F.lit(BLOCK).cast("long")) - first).cast("int"))

        found = F.transform(F.sequence(F.expr("0L") + F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)), part)
        return F.when(start < end, F.array_join(found, "")).otherwise(F.lit(""))

    def replaced(x: Column, b: Column) -> Column:
        before = running(F.transform(x, lambda s: s["end"]), lambda a, e: F.greatest(a, e), F.lit(0).cast("long"))
        kept = F.filter(F.zip_with(x, before, lambda s, e: F.struct(s["start"].alias("start"), s["end"].alias("end"), e.alias("before"))), lambda s: s["end"] > s["before"])
        out = F.transform(kept, lambda s: F.concat(between(b, s["before"], s["start"]), F.lit("[SECRET]")))
        return F.concat(F.array_join(out, ""), between(b, F.array_max(F.transform(x, lambda s: s["end"])), F.length(text).cast("long")))

    return F.when(F.size(spans) > 0, let(ordered, lambda x: let(blocks, lambda b: replaced(x, b)))).otherwise(text)
