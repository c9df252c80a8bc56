"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

Lines are a text's parts between line feeds; those without a word (a character other than space and U+0009-U+000D) are
kept and take no part. A line is deleted if it lies in a run of ``run`` lines that also starts earlier: in a document of
smaller doc_id, or earlier in the same one. Runs are judged on the input.

* Fingerprints: hashes of lines; of every window of ``run`` lines the leftmost least one is selected, which guarantees
  that equal runs select the same line at the same place in them. With ``run`` of one, windows have ``window`` lines:
  matches of so many lines or more share a fingerprint.
* Positions: those of a fingerprint are joined by its hash; a fingerprint with one position in the corpus drops out.
* Extension: from the fingerprint's line a match goes on to both sides, line by line, as far as the windows that
  selected it reach. Lines are compared one by one, by two 64-bit hashes each. Positions that agree with an earlier one
  to both sides are a class, and its first position is joined to all the others: one row for each and no pairs. With
  ``run`` of one, each position is matched with its fingerprint's first, and the match goes on for as many lines as agree,
  up to the next windows' fingerprints on both sides.
* Rest: with ``run`` of one, lines in no such match may still occur earlier (alone, in matches shorter than a window, or in
  the surroundings of another position). A line's first occurrence is in no match, so these lines alone are compared with
  each other, one by one, and every later copy of a line is found.
* Deletion: later runs go; runs that overlap make longer ones.

Hot lines: classes are aggregated before the exchange, and their first place is joined to runs salted ``salts`` ways.

Rows: null text counts as empty; rows that repeat a doc_id and text are one document, and each is returned; rows that
share a doc_id with other texts are ordered by text hash; a null doc_id comes before all others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.quality import _let
from millrace.llm.salting import salted_join

WORD = r"[^\x20\x09-\x0D]"


def _numbered_lines(text: Column) -> Column:
    """(number, line) of the lines with a word."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(WORD))


def _windows(text: Column, run: int) -> Column:
    """Of each ``run`` lines: its start s, the hash h of its fingerprint, how many lines stand left of that, and all its lines."""

    def windows(one: Column, two: Column) -> Column:
        def window(first: Column, start: Column) -> Column:
            best = F.struct(first.alias("h"), F.lit(0).alias("left"))
            for k in range(1, run):
                best = F.least(best, F.struct(F.get(one, start + k).alias("h"), F.lit(k).alias("left")))
            lines = F.array(*(F.get(hashes, start + k) for hashes in (one, two) for k in range(run)))
            return _let(best, lambda b: F.struct(start.alias("s"), b["h"].alias("h"), b["left"].alias("left"), lines.alias("lines")))

        return F.transform(F.slice(one, 1, F.greatest(F.size(one) - (run - 1), F.lit(0))), window)

    def both(lines: Column) -> Column:
        one = F.transform(lines, lambda x: F.xxhash64(x["line"]))
        two = F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x["line"]))
        return _let(one, lambda first: _let(two, lambda second: windows(first, second)))

    return _let(_numbered_lines(text), both)


def _fingerprints(text: Column, window: int) -> Column:
    """The winnowed lines of a text: place p, two hashes, and the hashes of up to ``window`` - 1 lines before (nearest first) and after."""

    def chosen(one: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(one) - window, F.lit(0)))
        least = lambda s: F.array_min(F.transform(F.slice(one, s + 1, window), lambda h, k: F.struct(h.alias("h"), (s + k).alias("p"))))
        return F.filter(F.array_distinct(F.transform(starts, lambda s: least(s)["p"])), lambda p: p.isNotNull())

    def around(one: Column, two: Column) -> Column:
        def row(p: Column) -> Column:
            before = F.reverse(F.slice(one, F.greatest(p - (window - 1), F.lit(0)) + 1, F.least(p, F.lit(window - 1))))
            after = F.slice(one, p + 2, window - 1)
            return F.struct(p.alias("p"), F.get(one, p).alias("h"), F.get(two, p).alias("h2"), before.alias("before"), after.alias("after"))

        return F.transform(chosen(one), row)

    def both(lines: Column) -> Column:
        one = F.transform(lines, lambda x: F.xxhash64(x["line"]))
        two = F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x["line"]))
        return _let(one, lambda first: _let(two, lambda second: around(first, second)))

    return _let(_numbered_lines(text), both)


def _agreeing(left: Column, right: Column, most: int) -> Column:
    """How many leading elements of two arrays are equal, up to ``most``."""
    out = F.lit(0)
    for k in reversed(range(most)):
        out = F.when(F.get(left, F.lit(k)) == F.get(right, F.lit(k)), out + 1).otherwise(0)
    return out


def matched_lines(documents: DataFrame, window: int) -> DataFrame:
    """(_key, _tag, s): lines in matches of winnowed fingerprints with their first positions, extended to both sides."""
    found = documents.select("_key", "_tag", F.explode(_fingerprints(F.col("_text"), window)).alias("f")).select("_key", "_tag", "f.*")
    first = F.min(F.struct("_key", "_tag", "p", "before", "after")).alias("first")
    most = F.max(F.struct("_key", "_tag", "p")).alias("most")
    classes = found.groupBy(F.col("h").alias("_h"), F.col("h2").alias("_h2")).agg(first, most)
    place = F.struct(*(F.col("first")[c].alias(c) for c in ("_key", "_tag", "p")))
    classes = classes.filter(place != F.col("most")).select("_h", "_h2", "first", place.alias("at"))
    same = (F.col("h") == F.col("_h")) & (F.col("h2") == F.col("_h2"))
    later = salted_join(found, same, F.struct("_key", "_tag"), classes).filter(F.struct("_key", "_tag", "p") > F.col("at"))
    left, right = (_agreeing(F.col(c), F.col("first")[c], window - 1) for c in ("before", "after"))
    return later.select("_key", "_tag", F.explode(F.sequence(F.col("p") - left, F.col("p") + right)).alias("s")).distinct()


def later_runs(documents: DataFrame, run: int, salts: int, window: int = 3) -> DataFrame:
    """(_key, _tag, s): starts of the runs that occur earlier."""
    if run > 1:
        found = documents.select("_key", "_tag", F.explode(_windows(F.col("_text"), run)).alias("w")).select("_key", "_tag", "w.*")
        return _later(found, run, salts)
    matched = scratch.written(matched_lines(documents, window), "line-matches")
    gone = matched.groupBy(F.col("_key").alias("_k"), F.col("_tag").alias("_t")).agg(F.collect_set("s").alias("gone"))
    lines = documents.select("_key", "_tag", _windows(F.col("_text"), 1).alias("w"))
    lines = lines.join(gone, (F.col("_key") == F.col("_k")) & (F.col("_tag") == F.col("_t")), "left")
    rest = F.when(F.col("gone").isNull(), F.col("w")).otherwise(F.filter("w", lambda x: ~F.array_contains("gone", x["s"])))
    rest = scratch.written(lines.select("_key", "_tag", F.explode(rest).alias("w")).select("_key", "_tag", "w.*"), "unmatched-lines")
    return matched.union(_later(rest, 1, salts))


def _later(found: DataFrame, run: int, salts: int) -> DataFrame:
    """(_key, _tag, s) of those windows of :func:`_windows` that occur earlier."""
    salted = F.pmod(F.xxhash64("_key", "_tag"), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    found = found.withColumn("salt", salted)
    if run > 1:  # a line that no fingerprint matches is compared for itself
        # Each fingerprint counts once for its position, whichever windows select it.
        positions = found.groupBy("h", "_key", "_tag", (F.col("s") + F.col("left")).alias("p")).agg(F.lit(1).alias("one"))
        shared = positions.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = shared.select(F.col("h").alias("_h"), F.explode(every).alias("_salt"))
        found = found.join(shared, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt")), "left_semi")
    place = F.struct("_key", "_tag", "s")
    classes = found.groupBy("h", "left", "lines").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    classes = classes.filter(F.col("first") != F.col("last")).select(
        F.col("h").alias("_h"), F.col("left").alias("_left"), F.col("lines").alias("_lines"), "first", F.explode(every).alias("_salt")
    )
    same = (F.col("h") == F.col("_h")) & (F.col("left") == F.col("_left")) & (F.col("lines") == F.col("_lines"))
    later = found.join(classes, same & (F.col("salt") == F.col("_salt")))
    return later.filter(place > F.col("first")).select("_key", "_tag", "s")


def drop_repeated_lines(
    docs: DataFrame, *, run: int = 1, text: str = "text", key: str = "doc_id", salts: int = 32, window: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_removed, kept_text. ``window`` is for runs of one line; all windows give the same rows."""
    if run < 1 or window < 2:
        raise ValueError("run must be 1 or more, and window 2 or more")
    documents = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("_key"),
        F.col(key).isNull().alias("_null"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_tag", F.xxhash64("_text"))
    starts = later_runs(documents, run, salts, window).groupBy(F.col("_key").alias("_k"), F.col("_tag").alias("_t"))
    starts = starts.agg(F.collect_set("s").alias("starts"))  # of one document
    joined = documents.join(starts, (F.col("_key") == F.col("_k")) & (F.col("_tag") == F.col("_t")), "left")

    def cut(lines: Column) -> Column:
        held = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())

        def without(numbers: Column) -> Column:
            runs = F.transform(F.coalesce(F.col("starts"), F.array().cast("array<int>")), lambda s: F.sequence(s, s + (run - 1)))
            gone = F.transform(F.array_distinct(F.flatten(runs)), lambda j: F.get(numbers, j))

            def kept(removed: Column) -> Column:
                rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
                return F.struct(
                    F.size(numbers).cast("bigint").alias("n_lines"),
                    F.size(removed).cast("bigint").alias("n_removed"),
                    F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n").alias("kept_text"),
                )

            return _let(gone, kept)

        return _let(held, without)

    made = joined.select(F.when(~F.col("_null"), F.col("_key")).alias("doc_id"), _let(F.split("_text", "\n"), cut).alias("c"))
    return made.select("doc_id", "c.n_lines", "c.n_removed", "c.kept_text")
