"""Registry of the catalogue: one Spark plan and (when SQL can say it) one
oracle SQL text per SURVEY section-2 key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixture, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
SECTIONS: dict[str, str] = {}


def register(key: str, oracle: str | None = None, section: str = ""):
    """Register ``fn(fx: Fixture) -> DataFrame`` under ``key``."""

    def deco(fn: Callable[[Fixture], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixture(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        SECTIONS[key] = section
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return deco
