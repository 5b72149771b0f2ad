"""Name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillcheck.sources.tables import Tables


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        return self.build(Tables(spark, root))


PLANS: dict[str, Plan] = {}


def plan(name: str, oracle: str | None = None):
    """Register the decorated ``Tables -> DataFrame`` function under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = Plan(name, build, oracle)
        return build

    return register
