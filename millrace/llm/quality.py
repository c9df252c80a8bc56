"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Words are runs of characters other than space and U+0009-U+000D. Base rules reject texts of few words or of many words
in repeated five-word windows. Beyond them, each rule rejects documents of which a ratio exceeds a cutoff, and the
cutoffs are chosen on labelled documents (quality 1: good, 0: bad) so that false rejection stays limited:

* Labelled documents that pass the base rules are split by a hash of their id into a tuning and a holdout half.
* On the tuning half, each stratum (by default, a language) gets a path: the candidate cutoffs of all rules in the order
  of their lift (how much oftener they reject bad documents than good ones), each rule's from the largest down, and
  none below ``lift``. The first t cutoffs of a path, used together, are its step t; each step rejects what the one
  before rejects, and more.
* On the holdout half, steps are tested in that order, each by the exact binomial probability P(X <= k | n, risk) that at
  most k of the n good documents were rejected if the step rejected the share ``risk`` of good ones. A step is
  certified while this is at most ``delta`` / strata; the first failure ends the path (fixed-sequence testing, which
  needs no correction within a path; strata are corrected by Bonferroni). Only strata with enough good holdout
  documents to certify a step that rejects none of them are tested, so the others cost nothing.
* The last certified step's cutoffs are used. With probability 1 - delta, they reject at most the share ``risk`` of good
  documents in every stratum. A stratum with too few labels rejects by the base rules alone.

A certified stratum has over ln(1 / delta) / risk good labelled documents, and their table of cutoffs is broadcast while
it has at most ``broadcast_strata`` rows (counted); beyond that it is joined by an exchange. Five-word windows are
compared by 64-bit hashes of their words within a text.

Rows: null text counts as having no words (base rules reject it); null stratum is a stratum of its own; repeated
label rows of a document count once, with the lowest quality; null labels are ignored; repeated document rows are
judged alike; an empty table gives an empty result; without labels only base rules apply.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import scratch

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Each rule's ratio, and the candidate cutoffs above which it may reject.
RULES: dict[str, tuple[tuple[str, str], tuple[float, ...]]] = {
    "symbols_per_word": (("n_symbols", "n_words"), (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0)),
    "dup_line_share": (("n_dup_lines", "n_lines"), (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "repeat_word_share": (("n_repeat_words", "n_words"), (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18)),
    "upper_share": (("n_upper", "word_chars"), (0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "mean_word_chars": (("word_chars", "n_words"), (7.0, 8.0, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0, 30.0, 50.0)),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(words: Column) -> Column:
    """A hash for each run of five words."""

    def grams(hashes: Column) -> Column:
        def gram(first: Column, at: Column) -> Column:
            return F.xxhash64(first, *(F.get(hashes, at + k) for k in range(1, WINDOW)))

        return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), gram)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def repeated(ordered: Column) -> Column:
        def start(entry: Column, k: Column) -> Column:
            beside = (F.get(ordered, k - 1)["g"] == entry["g"]) | (F.get(ordered, k + 1)["g"] == entry["g"])
            return F.when(beside, entry["i"])

        starts = F.sort_array(F.filter(F.transform(ordered, start), lambda x: x.isNotNull()))
        return _let(starts, covered)

    def count(grams: Column) -> Column:
        entries = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_let(entries, repeated))

    return _let(_window_hashes(words), count)


def text_counts(text: Column) -> Column:
    """A struct of the counts of a whole text, each a bigint; see :data:`COUNTS`."""
    whole = F.coalesce(text, F.lit(""))

    def words_of(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            F.char_length(F.array_join(words, "")).alias("word_chars"),
            _repeated_words(words).alias("n_repeat_words"),
        )

    def lines_of(found: Column) -> Column:
        return F.struct(F.size(found).alias("n_lines"), (F.size(found) - F.size(F.array_distinct(found))).alias("n_dup_lines"))

    with_word = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.struct(
        _let(F.array_remove(F.split(whole, WHITE), ""), words_of).alias("w"),
        _let(with_word, lines_of).alias("l"),
        F.char_length(F.regexp_replace(whole, SYMBOLS, "")).alias("n_symbols"),
        F.char_length(F.regexp_replace(whole, "[^A-Z]+", "")).alias("n_upper"),
    )

    def flat(p: Column) -> Column:
        at = {n: p["w"][n] for n in ("n_words", "word_chars", "n_repeat_words")}
        at |= {n: p["l"][n] for n in ("n_lines", "n_dup_lines")} | {n: p[n] for n in ("n_symbols", "n_upper")}
        return F.struct(*(at[n].cast("bigint").alias(n) for n in COUNTS))

    return _let(parts, flat)


def document_counts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every document."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), text_counts(F.col(text)).alias("_counts")
    )
    return rows.select("doc_id", "stratum", *(F.col(f"_counts.{n}").alias(n) for n in COUNTS))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _ratio(rule: str, at: Callable[[str], Column]) -> Column:
    above, below = RULES[rule][0]
    return F.coalesce(F.try_divide(at(above), at(below)), F.lit(0.0))


def binomial_tail_log(n: Column, k: Column, p: float) -> Column:
    """Logarithm of P(X <= k) for X binomial (n, p), summed term by term."""
    odds = math.log(p) - math.log1p(-p)
    first = n.cast("double") * math.log1p(-p)

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
        top, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda state: state["total"])


def _rule_steps(labelled: DataFrame, lift: float) -> DataFrame:
    """(stratum, rule, step, at): the path of each stratum, of cutoff ``step`` (from 1) of a rule at place ``at`` (from 0)."""
    passed = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"_{r}").alias("exceeds")) for r in RULES)))
    tally = labelled.select("stratum", "good", "n", passed.alias("p")).groupBy("stratum", "p.rule", "p.exceeds")
    tally = tally.agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("bad"))
    # From here on there are at most as many rows for each stratum and rule as the rule has cutoffs, and one.
    all_of = Window.partitionBy("stratum", "rule")
    down = all_of.orderBy(F.desc("exceeds"))
    smoothed = lambda k, n: (k + 0.5) / (n + 1)
    k_good, k_bad = F.sum("good").over(down), F.sum("bad").over(down)
    ratio = smoothed(k_bad, F.sum("bad").over(all_of)) / smoothed(k_good, F.sum("good").over(all_of))
    # A rule's smaller cutoff can't come before its larger one, so its lift is at most that one's.
    steps = tally.select("stratum", "rule", "exceeds", "bad", ratio.alias("ratio")).withColumn("ratio", F.min("ratio").over(down))
    steps = steps.filter((F.col("exceeds") > 0) & (F.col("bad") > 0) & (F.col("ratio") >= lift))
    order = Window.partitionBy("stratum").orderBy(F.desc("ratio"), "rule", F.desc("exceeds"))
    return steps.select("stratum", "rule", F.col("exceeds").alias("step"), (F.row_number().over(order) - 1).alias("at"))


def certified_cutoffs(counts: DataFrame, labels: DataFrame, *, risk: float = 0.02, delta: float = 0.05, lift: float = 5.0) -> DataFrame:
    """One row per stratum with a certified step: stratum and a cutoff, or null, for each rule."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    known = counts.join(marked, F.col("doc_id") == F.col("_id")).filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))

    def exceeded(rule: str, cuts: tuple[float, ...]) -> Column:
        ratio = _ratio(rule, F.col)
        return sum((F.when(ratio > cut, 1).otherwise(0) for cut in cuts), F.lit(0))

    held = (F.pmod(F.xxhash64(F.lit("holdout"), "_id"), F.lit(2)) == 1).alias("held")
    levels = [exceeded(rule, cuts).alias(f"_{rule}") for rule, (_, cuts) in RULES.items()]
    alike = known.select("stratum", held, (F.col("_quality") >= 1).alias("good"), *levels)
    # One row for documents of a stratum that no cutoff tells apart: what follows does not grow with the labels.
    alike = alike.groupBy(*alike.columns).agg(F.count(F.lit(1)).alias("n"))
    alike = scratch.written(alike, "quality-labels")
    path = scratch.written(_rule_steps(alike.filter("not held"), lift), "quality-path")
    holdout = alike.filter("held and good")
    totals = holdout.groupBy("stratum").agg(F.sum("n").alias("n_good"))
    testable = totals.filter(F.col("n_good") * math.log1p(-risk) <= math.log(delta))
    testable = scratch.written(testable, "quality-strata")
    strata = testable.count()
    entries = path.groupBy("stratum").agg(F.collect_list(F.struct("at", "rule", "step")).alias("path"))  # cutoffs of all rules at most
    entries = entries.select(F.col("stratum").alias("_s"), "path")
    joined = holdout.join(entries, F.col("stratum").eqNullSafe(F.col("_s")))
    level = F.create_map(*(x for rule in RULES for x in (F.lit(rule), F.col(f"_{rule}"))))
    hits = _let(level, lambda of: F.array_min(F.transform(F.filter("path", lambda e: of[e["rule"]] >= e["step"]), lambda e: e["at"])))
    first = joined.select("stratum", "n", hits.alias("first")).filter("first IS NOT NULL")
    first = first.groupBy("stratum", "first").agg(F.sum("n").alias("rejected"))
    first = first.select(F.col("stratum").alias("_f"), F.col("first"), "rejected")
    steps = path.join(first, F.col("stratum").eqNullSafe(F.col("_f")) & (F.col("at") == F.col("first")), "left")
    k = F.sum(F.coalesce("rejected", F.lit(0))).over(Window.partitionBy("stratum").orderBy("at"))  # of one path
    steps = steps.select("stratum", "rule", "step", "at", k.alias("k_good"))
    tested = steps.join(testable.withColumnRenamed("stratum", "_t"), F.col("stratum").eqNullSafe(F.col("_t")))
    within = F.col("k_good") <= F.col("n_good") * risk  # beyond the mean the tail is never small enough
    log_p = F.when(within, binomial_tail_log(F.col("n_good"), F.col("k_good"), risk))
    # k grows along a path, and so does its probability: all steps before the last that passes pass too.
    sure = tested.filter(log_p <= math.log(delta / max(1, strata)))
    cuts_of = F.create_map(*(x for rule, (_, cuts) in RULES.items() for x in (F.lit(rule), F.lit(list(cuts)))))
    sure = sure.select("stratum", "rule", F.element_at(F.element_at(cuts_of, F.col("rule")), F.col("step")).alias("cutoff"))
    return sure.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in RULES))


def _kept(at: Callable[[str], Column], cutoff: Callable[[str], Column]) -> Column:
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_ratio(rule, at) > cutoff(rule), F.lit(False))
    return ~base_failed(at("n_words"), at("n_repeat_words")) & ~rejected


def _cutoff_table(cutoffs: DataFrame, broadcast_strata: int = 100_000) -> DataFrame:
    """The written cutoffs; broadcast if they are few, else left to a join by exchange."""
    table = cutoffs.select(F.col("stratum").alias("_cut_stratum"), F.struct(*RULES).alias("_cutoffs"))
    return F.broadcast(table) if cutoffs.count() <= broadcast_strata else table


def judge(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with base_failed and kept."""
    joined = counts.join(_cutoff_table(cutoffs), F.col("stratum").eqNullSafe(F.col("_cut_stratum")), "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = _kept(F.col, lambda rule: F.col(f"_cutoffs.{rule}"))
    return joined.select(*counts.columns, failed.alias("base_failed"), kept.alias("kept"))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", stratum: str = "lang", **control: float
) -> DataFrame:
    """One row per document: doc_id, stratum, its counts, base_failed and kept. ``control``: risk, delta, lift."""
    counts = scratch.written(document_counts(docs, text=text, key=key, stratum=stratum), "quality-counts")
    return judge(counts, scratch.written(certified_cutoffs(counts, labels, **control), "quality-cutoffs"))


def drop_rejected(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", stratum: str = "lang", **control: float
) -> DataFrame:
    """The documents that the rules keep, with all their columns and without moving their texts."""
    # Written first: a filter on counts would else be pushed below them and count every text again.
    counts = scratch.written(document_counts(docs, text=text, key=key, stratum=stratum), "quality-counts")
    cutoffs = scratch.written(certified_cutoffs(counts, labels, **control), "quality-cutoffs")
    columns = docs.columns
    renamed = docs.toDF(*(f"_in_{k}" for k in range(len(columns))))
    names = dict(zip(columns, renamed.columns, strict=True))
    joined = renamed.join(_cutoff_table(cutoffs), F.col(names[stratum]).cast("string").eqNullSafe(F.col("_cut_stratum")), "left")

    def passes(counts: Column) -> Column:
        return _kept(lambda n: counts[n], lambda rule: F.col(f"_cutoffs.{rule}"))

    # One expression: as a column and a filter on it, Spark would count words once for each mention of a count.
    kept = joined.filter(_let(text_counts(F.col(names[text])), passes))
    return kept.select(*(F.col(names[c]).alias(c) for c in columns))
