"""Exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Every stage groups by the whole normalised text beside
its SHA-256 digest, so that content is compared in full and no digest decides alone:

1. within each input task, Spark's partial aggregation folds equal texts that share a salt;
2. digest groups meet: texts are exchanged here, once. Digests of over ``hot`` of all rows (fewer than 1 / hot of them,
   found by counting digests without texts) are dealt over ``salts`` groups each, others have one;
3. the salt winners of the hot digests, ``salts`` rows for each text, are combined globally.

Documents then find their group by digest. That is exact where a digest stands for one text, since every document's
own text was compared in stages 1 to 3; documents of a digest that stands for several texts are joined by the text
itself. Hot digests' results are repeated for each salt there, and their documents dealt over the salts.

Results for odd rows: null text counts as empty; a null doc_id never wins unless a group has no other (then the
group's keep_id is null and all its rows are kept); rows repeating the winner's doc_id are all marked kept; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import scratch
from millrace.llm.names import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the built-in, which does the same there and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def exact_groups(
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    salts: int = 64,
    hot: float = 1e-4,
    digest: Callable[[Column], Column] = text_digest,
) -> DataFrame:
    """One row per document: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    ``digest`` may map several texts to one value; results don't depend on it.
    """
    rows = docs.select(F.col(key).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_norm"))
    rows = rows.withColumn("_digest", digest(F.col("_norm")))
    # Rows without id are told apart by their place in the input, so that they spread over the salts too.
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.lit(salts)).cast("int")
    rows = rows.withColumn("_row_salt", salt)
    marks = rows.select("doc_id", "_digest", "_row_salt", F.sha2("_norm", 256).alias("text_sha256"))
    marks = scratch.written(marks, "exact-digests")
    many = max(1000.0, hot * marks.count())
    frequent = marks.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > many)
    frequent = scratch.written(frequent.select(F.col("_digest").alias("_f")), "hot-digests")

    def salted(frame: DataFrame) -> DataFrame:
        # Fewer than 1 / hot digests hold more than that share each, whatever the input's size.
        joined = frame.join(F.broadcast(frequent), F.col("_digest") == F.col("_f"), "left")
        return joined.withColumn("_hot", F.col("_f").isNotNull()).withColumn("_salt", F.when(F.col("_hot"), F.col("_row_salt")).otherwise(0))

    folded = salted(rows).groupBy("_digest", "_norm", "_salt")
    # _hot is aggregated, though constant in a group: a filter on it then stays above, and texts are exchanged once.
    folded = folded.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.bool_or("_hot").alias("_hot"))
    winners = folded.filter("_hot").groupBy("_digest", "_norm")
    winners = winners.agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.lit(True).alias("_hot"))
    winners = folded.filter("not _hot").select(*winners.columns).union(winners).drop("_norm")
    winners = scratch.written(winners, "exact-winners")
    several = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("_digest").alias("_s"))
    several = scratch.written(several, "shared-digests")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    by_digest = winners.select(F.col("_digest").alias("_w"), "keep_id", "group_size", F.explode(every).alias("_w_salt"))
    members = salted(marks)
    found = None
    if not several.isEmpty():  # documents whose digest stands for several texts find their group by the text
        whole = rows.withColumn("text_sha256", F.sha2("_norm", 256)).join(several, F.col("_digest") == F.col("_s"), "left_semi")
        groups = whole.groupBy(F.col("_digest").alias("_w"), F.col("_norm").alias("_w_norm"))
        groups = groups.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = whole.join(groups, (F.col("_digest") == F.col("_w")) & (F.col("_norm") == F.col("_w_norm")))
        members = members.join(several, F.col("_digest") == F.col("_s"), "left_anti")
        by_digest = by_digest.join(several, F.col("_w") == F.col("_s"), "left_anti")
    plain = members.join(by_digest, (F.col("_digest") == F.col("_w")) & (F.col("_salt") == F.col("_w_salt")))
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    plain = plain.select(*columns) if found is None else plain.select(*columns).union(found.select(*columns))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return plain.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", salts: int = 64) -> DataFrame:
    """The documents that stay, with all their columns; rows without doc_id stay.

    Rows are dropped by doc_id and text, so a doc_id that repeats with several texts loses those alone that have a winner elsewhere.
    """
    groups = exact_groups(docs, text=text, key=key, salts=salts)
    dropped = groups.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text_sha256")).distinct()
    names = [unused(docs.columns, "_dropped"), unused(docs.columns, "_sha")]
    gone = scratch.written(dropped.toDF(*names), "exact-dropped")
    sha = F.xxhash64(F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))), 256))  # tells apart texts of one doc_id
    return docs.join(gone, (docs[key] == gone[names[0]]) & (sha == gone[names[1]]), "left_anti")
