"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, line_dedup, packing, pieces, quality, scratch, simhash, suffix_dedup, token_files, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
        start = scratch.mark()
        result = run(spark, sf_dir)
        scratch.discard_unread(result, start)
        return result

    QUERIES[run.__name__] = tidy
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page by the rules, and by its host's templates where no rule fits."""
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"), urls.RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query
def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document's pieces into sequences of 4096 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer, capacity=4096, end_id=1)


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids in the token-file format, and read the files back."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer, end_id=0)
    return token_files.read_token_files(files, with_ids=False)


@_query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group every document with its exact copies."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


ORACLES["op9_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte covered by a 100-byte string that starts earlier."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


@_query
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and name its near-duplicate class."""
    return simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


@_query
def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document into pieces and decode the ids."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), model, full=False)


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete every line that occurs earlier."""
    cut = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), run=1)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op6_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
n AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k
  FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_removed FROM n GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t
  FROM l ANTI JOIN (SELECT doc_id, i FROM n WHERE k > 1) USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; learn from the labels that are not held out."""
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, and judge every document by base rules and certified cutoffs."""
    verdicts = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
