"""Millrace: a Spark-first analytics library of lazy DataFrame transformations and Column expressions."""

from millrace.session import build_session

__version__ = "0.1.0"
__all__ = ["__version__", "build_session"]
