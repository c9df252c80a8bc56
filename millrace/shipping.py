"""Sends this package to the executors of a session that was started without it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path
from weakref import WeakSet

from pyspark import SparkContext
from pyspark.sql import SparkSession

_served: WeakSet[SparkContext] = WeakSet()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; Spark's own file server distributes the archive."""
    context = spark.sparkContext
    if context in _served:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as staging:
        copy = Path(staging, "tree", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        folder = tempfile.mkdtemp(prefix="millrace-package-")  # on the driver only, which serves the archive until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(str(Path(folder, package.name)), "zip", copy.parent)
    context.addPyFile(archive)
    _served.add(context)
