"""Every registered query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, choice, codes, encoding, events, extraction, frequency, lookup, matching, routing, spans, tables, text

MODULES = (frequency, analytics, tables, text, lookup, spans, routing, events, codes, matching, choice, extraction, encoding)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
