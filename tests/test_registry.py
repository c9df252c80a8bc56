"""Every operator id of the blueprint is covered by a registered query or listed as not a query operator."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.registry import REGISTRY, Registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Ids without a query: actions and session parts that return no rows, and tooling.
EXEMPT = {
    "S09": "test_arrow_scalars_and_duck_typed_frames", "S14": "test_session", "S15": "test_session", "K03": "test_export",
    "R12": "test_getitem_of_other_types_raises", "C16": "",
}

IDS = {
    *(f"S{n:02d}" for n in range(1, 16)),
    *(f"K{n:02d}" for n in range(1, 9)),
    *(f"R{n:02d}" for n in range(1, 15)),
    *(f"C{n:02d}" for n in range(1, 17)),
    *(f"J{n:02d}" for n in range(1, 14)),
    *(f"A{n:02d}" for n in range(1, 15)),
    *(f"W{n:02d}" for n in range(1, 9)),
    *(f"O{n:02d}" for n in range(1, 9)),
    *(f"F{n:02d}" for n in range(1, 22)),
    *(f"T{n:02d}" for n in range(1, 6)),
}


def test_every_id_is_covered():
    covered = {i for entry in REGISTRY.entries.values() for i in entry.covers}
    assert IDS - covered - set(EXEMPT) == set()
    assert covered <= IDS


def test_exempt_ids_name_tests_that_exist():
    source = Path(__file__).with_name("test_operators.py").read_text()
    assert [name for name in EXEMPT.values() if name and f"def {name}(" not in source] == []


def test_every_registered_query_has_an_oracle():
    assert [name for name, entry in REGISTRY.entries.items() if entry.oracle is None] == []


def test_names_are_unique():
    registry = Registry()
    registry.query("a")(lambda spark, folder: None)
    with pytest.raises(ValueError):
        registry.query("a")(lambda spark, folder: None)


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if value is None or isinstance(value, (bool, str)):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(REGISTRY.entries))
def test_rows_equal_the_oracle(spark, duck, small_dir, name):
    entry = REGISTRY.entries[name]
    frame = entry.run(spark, small_dir)
    expected = duck.sql(entry.oracle)
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(_plain(row[c]) for c in columns) for row in frame.collect()), key=key)
    want = sorted((tuple(_plain(row[i]) for i in at) for row in expected.fetchall()), key=key)
    assert got == want


SORTED = [name for name in REGISTRY.entries if name.startswith("sort_")]


@pytest.mark.parametrize("name", SORTED)
def test_sorted_rows_come_in_the_oracle_s_order(spark, duck, small_dir, name):
    entry = REGISTRY.entries[name]
    # Small partitions on purpose: without the sort, rows would come in the order of files.
    frame = entry.run(spark, small_dir)
    got = [tuple(row) for row in frame.collect()]
    assert got == duck.sql(entry.oracle).fetchall()
    assert len(set(got)) == len(got) > 2


@pytest.mark.parametrize("blocked", ["public_tokenizers", "xxhash", "millrace.llm", "corpus_pipeline"])
def test_entry_works_without_the_optional_parts(blocked):
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == {blocked!r}: raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), 'pipeline' in e.queries(), 'join_inner' in e.queries())\n"
    )
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True)
    assert done.stdout.split()[1:] == ["False", "True"]


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
