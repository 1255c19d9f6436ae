"""All queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from . import notes, records, scoring

MODULES: tuple[ModuleType, ...] = (records, notes, scoring)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for m in MODULES:
        found |= m.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for m in MODULES:
        found |= m.oracle_sql()
    return found


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.note_relationships(spark, sf_dir)
