"""Column names that don't clash with those of an input."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], base: str) -> str:
    """``base``, with underscores behind it until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
