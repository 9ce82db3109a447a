"""Quality rules with risk-controlled cutoffs.

Counts of each text feed rules "ratio above cutoff: reject". Labelled documents
are the holdout: for each stratum, rule and cutoff, an exact binomial test asks
whether the rule rejects more than a share `risk / rules` of good documents; the
tests together keep the error `delta` (Bonferroni over all strata, rules and
cutoffs). Of the cutoffs that pass, the one with the best balance of bad
documents caught and good ones lost is used, so a stratum loses at most the
share `risk` of its good documents with confidence `1 - delta`. A stratum with
too few labelled documents gets no cutoff, and its documents pass.

Everything is DataFrame operations: no Python runs on the executors.

Defined results: null text counts as empty; empty text has zero counts and fails
the base rule (under 50 words); null stratum is a stratum of its own; repeated
rows give repeated results; a document with several labels is good only if all
say so; labels that are null are no labels; empty tables give empty results.
Columns of the input beside the id, text and stratum are not looked at."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Ratio of two counts that each rule looks at; above the cutoff it rejects.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "windows": ("n_repeat_words", "n_words"),
    "runs": ("n_runs", "n_words"),
}
GRID = tuple(i / 50 for i in range(1, 50))
RISK, DELTA = 0.05, 0.05
#: A good document lost counts as so many bad ones caught.
LOSS_WEIGHT = 20.0
#: Strata up to this number are broadcast with their cutoffs; more are joined by shuffle.
BROADCAST_STRATA = 10_000

#: Bits of the hashes that bring equal windows together; texts too long for all of them have fewer.
HASH_BITS = 64
_SPACES = r"[\x20\x09-\x0D]+"


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules need, one project after another so
    that each intermediate is computed once."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn("_t", t)
    df = df.withColumns(
        {
            "_words": F.filter(F.split("_t", _SPACES), lambda w: w != ""),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_plain": F.regexp_replace("_t", r"[#*$%&|<>]+", ""),
            "_low": F.regexp_replace("_t", r"\p{Lu}+", ""),
        }
    )
    df = df.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_chars_all": F.length("_t").cast("long")})
    df = df.withColumns(
        {
            "n_symbols": F.col("n_chars_all") - F.length("_plain"),
            "n_upper": F.col("n_chars_all") - F.length("_low"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_bits": F.greatest(F.ceil(F.log2(F.col("n_words") + F.lit(2))).cast("int"), F.lit(64 - HASH_BITS)),
        }
    )
    # A long for each window: bits of the hash above, its position below. Sorted, equal windows are neighbours.
    windows = F.when(
        F.col("n_words") >= 3,
        F.expr("sort_array(transform(slice(_words, 1, size(_words) - 2), (w, i) -> shiftleft(xxhash64(w, _words[i + 1], _words[i + 2]), _bits) | cast(i as bigint)))"),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    df = df.withColumn("_windows", windows)
    same = "shiftrightunsigned(x, _bits) = shiftrightunsigned({y}, _bits) and {words}"
    equal = " and ".join(f"_words[cast(x & (shiftleft(1L, _bits) - 1) as int) + {i}] = _words[cast({{y}} & (shiftleft(1L, _bits) - 1) as int) + {i}]" for i in range(3))
    beside = [same.format(y=f"_windows[j {d} 1]", words=equal.format(y=f"_windows[j {d} 1]")) for d in "-+"]
    # Where windows with equal hashes differ, equal ones may not be neighbours: such a text, a rare one, is sorted by the words themselves.
    before = same.format(y="_windows[j - 1]", words=f"not ({equal.format(y='_windows[j - 1]')})").replace("(x,", "(_windows[j],").replace("cast(x &", "cast(_windows[j] &")
    df = df.withColumn("_mixed", F.expr(f"size(_windows) > 1 and exists(sequence(1, size(_windows) - 1), j -> {before})"))
    by_words = "sort_array(transform(slice(_words, 1, size(_words) - 2), (w, i) -> named_struct('g', concat_ws(' ', w, _words[i + 1], _words[i + 2]), 'i', cast(i as bigint))))"
    by_words = f"transform(array({by_words}), e -> transform(filter(e, (x, j) -> (j > 0 and x.g = e[j - 1].g) or (j < size(e) - 1 and x.g = e[j + 1].g)), x -> x.i))[0]"
    by_hash = f"transform(filter(_windows, (x, j) -> (j > 0 and {beside[0]}) or (j < size(_windows) - 1 and {beside[1]})), x -> x & (shiftleft(1L, _bits) - 1))"
    df = df.withColumn("_again", F.expr(f"sort_array(case when _mixed then {by_words} else {by_hash} end)"))
    df = df.withColumns(
        {
            "n_repeat_words": F.expr("aggregate(_again, named_struct('p', -3L, 'n', 0L), (s, x) -> named_struct('p', x, 'n', s.n + least(3L, x - s.p)), s -> s.n)"),
            "n_runs": F.expr("size(filter(_words, (w, i) -> i > 0 and w = _words[i - 1]))").cast("long"),
        }
    )
    return df.drop("_t", "_words", "_lines", "_plain", "_low", "_bits", "_windows", "_mixed", "_again", "n_chars_all")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(rule: str) -> Column:
    over, under = RULES[rule]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


def _log_tail(n: str, k: str, share: float) -> Column:
    """log P(Bin(n, share) <= k), by adding the terms in logarithms."""
    return F.expr(
        f"aggregate(if({k} > 0, sequence(1L, {k}), cast(array() as array<bigint>)),"
        f" named_struct('t', {n} * ln(1 - {share!r}D), 's', {n} * ln(1 - {share!r}D)),"
        f" (a, i) -> named_struct('t', a.t + ln(({n} - i + 1) / i) + ln({share!r}D / (1 - {share!r}D)),"
        f" 's', greatest(a.s, a.t + ln(({n} - i + 1) / i) + ln({share!r}D / (1 - {share!r}D)))"
        f" + log1p(exp(-abs(a.s - (a.t + ln(({n} - i + 1) / i) + ln({share!r}D / (1 - {share!r}D))))))),"
        f" a -> a.s)"
    )


def cutoffs(held: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff for each rule (null: none passed).

    held: a row per labelled document with its stratum, good (boolean) and the
    counts. Sums by stratum and cutoff are taken map-side before the shuffle."""
    share = risk / len(RULES)
    # A histogram of each ratio keeps the row narrow: the cell of the grid that it falls in.
    cell = {r: sum(((ratio(r) > c).cast("int") for c in GRID), F.lit(0)) for r in RULES}
    cells = held.select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("cell")) for r, c in cell.items()])).alias("x")).select("stratum", "good", "x.*")
    sums = written(cells.groupBy("stratum", "rule", "cell").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("cutoff")) for i, c in enumerate(GRID)])
    lists = sums.groupBy("stratum", "rule").agg(F.sum("g").alias("n"), F.sum("b").alias("bad"), F.collect_list(F.struct("cell", "g", "b")).alias("h"))  # at most one entry per cell of the grid
    tests = lists.select("stratum", "rule", "n", "bad", "h", F.explode(grid).alias("c")).select(
        "stratum", "rule", "n", "bad", F.col("c.cutoff").alias("cutoff"),
        F.expr("aggregate(filter(h, x -> x.cell >= c.i), 0L, (a, x) -> a + x.g)").alias("k"),
        F.expr("aggregate(filter(h, x -> x.cell >= c.i), 0L, (a, x) -> a + x.b)").alias("caught"),
    )
    n_tests = sums.select("stratum").distinct().count() * len(RULES) * len(GRID)
    passed = tests.where("n > 0").where(_log_tail("n", "k", share) <= F.lit(math.log(delta / max(1, n_tests))))
    gain = F.coalesce(F.try_divide(F.col("caught"), F.col("bad")), F.lit(0.0)) - LOSS_WEIGHT * F.col("k") / F.col("n")
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain.alias("gain"), "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).toDF("stratum", *[f"c_{r}" for r in RULES])


def judged(features: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """features with base_failed and kept."""
    rules = cuts.withColumnRenamed("stratum", "_stratum")
    if cuts.count() <= BROADCAST_STRATA:
        rules = F.broadcast(rules)
    df = features.join(rules, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(ratio(r) > F.col(f"c_{r}"), F.lit(False))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"c_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, carry: list[str] = ()) -> DataFrame:
    """docs(doc_id, text, lang) judged with labels(doc_id, quality): doc_id, lang,
    the counts, base_failed, kept, and the columns named in carry as the struct
    `carried`, whatever their names.

    The texts are read once; the counts, a narrow table, are written to the
    shared folder and used for the holdout and for the verdict."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    features = written(counts(docs.select("doc_id", F.col("text").alias("_text"), "lang", *carried), "_text").drop("_text"))
    marked = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    held = features.drop("carried").join(marked, "doc_id").withColumnRenamed("lang", "stratum")
    return judged(features, written(cutoffs(held)))
