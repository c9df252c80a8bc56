"""A corpus pipeline of five stages over the table documents.

Each stage is a function of (spark, docs, sf_dir): docs is what the stage before kept, read back from Parquet, and all
stages but the last return the columns of documents. Texts are only rewritten by suffix-array dedup, which also
brings n_chars up to date; the last stage returns the pieces of documents with their places in packed sequences.

Rows: as each operator states for its own input. A null doc_id is never dropped by a deduplication stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, packing, quality, scratch, simhash, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that base rules or certified cutoffs reject."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of largest doc_id of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each class of similar texts (five-word shingles, 0.8)."""
    return simhash.drop_similar(docs, width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte covered by a 100-byte string that starts earlier."""
    cut = suffix_dedup.strip_repeats(docs, length=100)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in cut.columns else cut


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the pieces of every document, with their ids, into sequences of 4096 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, tokenizer, capacity=4096, end_id=1, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packed_sequences", packed_sequences),
]

#: Byte spans, fingerprints, tokens and packing can't be expressed in SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list[str] = []
    for name, stage in STAGES[:-1]:
        start = scratch.mark()
        kept = stage(spark, docs, sf_dir)
        folders = scratch.since(start)
        start = scratch.mark()
        docs = scratch.written(kept, f"stage-{name}")
        del kept
        scratch.discard(spark, [*folders, *done])  # the stage's own tables and its input: its result reads neither
        done = scratch.since(start)
    start = scratch.mark()
    packed = STAGES[-1][1](spark, docs, sf_dir)
    scratch.discard_unread(packed, start)
    return packed
