"""Session construction with the settings the library is written for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Semantics the queries rely on: UTC wall clock, ANSI errors, adaptive re-planning.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "millrace", master: str | None = None, conf: Mapping[str, str] | None = None
) -> SparkSession:
    """Return the active session, or start one with :data:`BASE_CONF` plus ``conf``.

    ``master`` is left to the launcher when omitted, so the same code runs under ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
