"""Imports every plan module so that their queries are registered."""

from __future__ import annotations

import importlib

MODULES = ("flagship", "projection", "expressions", "joins", "aggregation", "ordering", "scalars", "ingestion")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"millrace.plans.{name}")
