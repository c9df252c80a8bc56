"""Intermediate tables in the folder that driver and executors share.

Cutting lineage with a written table survives lost executors: a later stage that is run again reads files, not
blocks of an executor. The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's bound on the bytes of a batch that goes to a Python worker.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: list[str] = []
_tables: set[str] = set()
_local: list[str] = []
_sessions: dict[int, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder; nothing is created yet."""
    path = f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    if not _sessions:
        atexit.register(_discard_all)
    _sessions[id(spark)] = spark
    _made.append(path)
    return path


def _discard_all() -> None:
    """Delete what is left when the driver ends; a session that is gone by then keeps its own."""
    for spark in _sessions.values():
        with contextlib.suppress(Exception):
            discard(spark, list(_made))


def written(df: DataFrame, label: str, *, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Spark deletes the shuffle files behind the table once it is written, as nothing reads them again. Batches for Python
    workers have some ``batch_bytes`` at most, or what the session allows.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    _tables.add(path)
    settings = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a missing one is no error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def mark() -> int:
    """A position in the list of folders made so far, for :func:`since`."""
    return len(_made)


def since(start: int) -> list[str]:
    """The folders made since :func:`mark` gave ``start``."""
    return _made[start:]


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that no DataFrame will read again."""
    for path in folders:
        remove(spark, path)
        if path in _made:
            _made.remove(path)
        _tables.discard(path)


def discard_unread(result: DataFrame, start: int) -> None:
    """Delete the tables written since :func:`mark` gave ``start`` that ``result`` does not read."""
    leaves = result._jdf.queryExecution().analyzed().collectLeaves()
    read = " ".join(str(leaves.apply(k).toString()) + _roots(leaves.apply(k)) for k in range(leaves.size()))
    named = set(re.findall(r"[0-9a-f]{32}", read))
    discard(result.sparkSession, [path for path in since(start) if path in _tables and path[-32:] not in named])


def _roots(leaf) -> str:
    """The folders that a leaf of a plan reads, if it reads files."""
    try:
        return leaf.relation().location().rootPaths().mkString(" ")
    except Exception:  # a leaf of another kind
        return ""

