"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model_plans, text_plans

PLANS = (text_plans, model_plans)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_plans.lang_identify(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for plan in PLANS for f in plan.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
