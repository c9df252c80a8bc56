"""The pipeline against brute force, stage by stage, and its registration."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from millrace.llm import quality, scratch
from tests.llm.conftest import SCHEMA, make_rows
from tests.llm.test_dedup import ASCII_LOWER, brute_repeats
from tests.llm.test_filters import brute_counts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(make_rows(3), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            counts = {k: brute_counts(t) for k, t in texts.items()}
            want = {k: t for k, t in texts.items() if counts[k][0] >= 10 and 100 * counts[k][4] <= 20 * counts[k][0]}
        elif name == "exact_copies":
            last = {(t or "").translate(ASCII_LOWER): k for k, t in sorted(texts.items())}
            want = {k: texts[k] for k in last.values()}
        elif name == "near_copies":
            assert set(got) <= set(texts)
            for k in set(texts) - set(got):  # of what goes, something alike stays, by chains of alike texts
                best = max(len(shingles(texts[k]) & shingles(texts[j])) / len(shingles(texts[k]) | shingles(texts[j])) for j in texts if j != k)
                assert best > 0.6
            want = {k: texts[k] for k in got}
            assert len(texts) - len(got) >= 5  # the planted near copies
        else:
            order = sorted(texts)
            gone = brute_repeats([texts[k].encode() for k in order], 100)
            want = {k: bytes(b for b, g in zip(texts[k].encode(), mask, strict=True) if not g).decode("utf-8", "ignore") for k, mask in zip(order, gone, strict=True)}
            assert {r.doc_id: r.n_chars for r in docs.collect()} == {k: len(t) for k, t in want.items()}
        assert got == want, name
        texts = got
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    assert {(r.doc_id, r.piece): list(r.ids) for r in rows} == {(k, p): x[p * 4096 : p * 4096 + 4096] for k, x in ids.items() for p in range(-(-len(x) // 4096))}
    total = sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) == -(-total // 4096)
    whole = {(r.doc_id, r.piece, r.sequence_id >= 0, r.offset >= 0) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {(r.doc_id, r.piece, True, True) for r in rows}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    queries = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([q for q in queries if re.match(rf"op{n}_", q)]) == 1
    assert "pipeline" in queries
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "repeated_passages", "packed_sequences"]


@pytest.mark.parametrize("name", ["op6_line_dedup", "op9_exact_dedup"])
def test_oracles(spark, name, small_dir):
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    frame = __spark_entry__.queries()[name](spark, small_dir)
    want = connection.sql(__spark_entry__.oracle_sql()[name])
    at = [want.columns.index(c) for c in frame.columns]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_rule_has_rising_cutoffs():
    assert all(np.all(np.diff(cuts) > 0) for _, cuts in quality.RULES.values())
