"""Registry of the engine's queries and of the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meltemi.plans import daily, downscaling, learning, mapping, places, projections, scalars, skill, terrain, zonal

MODULES = (scalars, daily, skill, mapping, projections, zonal, downscaling, places, terrain, learning)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skill.flagship(spark, sf_dir)
