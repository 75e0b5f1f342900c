"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import general, pipeline, star

MODULES = (general, star, pipeline)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return star.skill_popularity(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}
