"""Registry pairing each runnable query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A registered query: its function, optional oracle SQL and the operator ids it covers."""

    name: str
    run: QueryFunction
    oracle: str | None = None
    covers: tuple[str, ...] = ()


@dataclass
class Registry:
    """An ordered collection of queries with unique names."""

    entries: dict[str, Query] = field(default_factory=dict)

    def query(
        self, name: str, oracle: str | None = None, covers: str = ""
    ) -> Callable[[QueryFunction], QueryFunction]:
        """Register the decorated ``(spark, sf_dir) -> DataFrame`` function under ``name``."""

        def register(run: QueryFunction) -> QueryFunction:
            if name in self.entries:
                raise ValueError(f"query {name!r} is registered twice")
            self.entries[name] = Query(name, run, oracle, tuple(covers.split()))
            return run

        return register

    def functions(self) -> dict[str, QueryFunction]:
        return {name: entry.run for name, entry in self.entries.items()}

    def oracles(self) -> dict[str, str]:
        return {name: entry.oracle for name, entry in self.entries.items() if entry.oracle is not None}


REGISTRY = Registry()
query = REGISTRY.query
