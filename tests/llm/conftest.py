"""Fixtures of odd documents: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def phrase(rng: random.Random, words: int) -> str:
    syllables = ["the", "er", "on", "ing", "ré", "stä", "ñ", "of", "and", "ti"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words))


def make_rows(seed: int = 1) -> list[tuple]:
    """Some 60 documents with exact, case and near copies, shared passages and lines, and every odd case."""
    rng = random.Random(seed)
    texts: list[str | None] = [phrase(rng, rng.randint(1, 120)) for _ in range(25)]
    base = phrase(rng, 300)
    for _ in range(6):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = phrase(rng, 70)
    texts += [f"{phrase(rng, 20)} {shared} {phrase(rng, 15)}" for _ in range(5)]
    lines = [phrase(rng, 6) for _ in range(5)]
    texts += ["\n".join([phrase(rng, 3), *lines[:k], "", phrase(rng, 4)]) for k in (2, 3, 4, 5, 5)]
    texts += [base, base.upper(), base, None, "", None, "   \n\t ", "a", "A", "a b", "x" * 3000, "ab " * 2500, "\x0b\x0c\r\n", "# $ %\n# $ %\n# $ %"]
    texts += ["one two three four five " * 6, "É é ß ½ 中文 😀 ▁   　 end", "<|endoftext|> <s> </s> [CLS]"]
    rows = [(k, t, rng.choice(["en", "de", None]), "s", len(t or "")) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return make_rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The documents beside extra columns that bear names which operators use."""
    clashing = {n: F.lit(7) for n in ("_text", "_key", "kept", "fp", "component_id", "_dropped", "stratum", "ids", "label", "task")}
    return spark.createDataFrame(odd_rows, SCHEMA).withColumns(clashing).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def awkward_docs(spark, odd_rows):
    """The documents with repeated rows, and ids that are null or shared."""
    more = [odd_rows[3], odd_rows[3], (None, "no id", "en", "s", 5), (None, None, None, None, None), (3, "same id, other text", "en", "s", 19)]
    return spark.createDataFrame([*odd_rows, *more], SCHEMA).repartition(2).cache()
