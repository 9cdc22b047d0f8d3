"""Registry of named queries: a DataFrame plan over the given tables and, where SQL can say it, a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpuscope.plans.bindings import Tables, with_bindings


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(tables)``; ``sql`` may use every name of ``bindings.SQL`` as a table."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, plan, with_bindings(sql) if sql else None)
        return plan

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REGISTRY[name].plan(Tables(spark, sf_dir))

    run.__name__ = name
    return run
