"""Named queries: ``name -> callable(spark, data_folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skuloom.sources import sample_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(*views: str, name: str | None = None):
    """Register ``fn(df, ...)``; every named view or table becomes one argument."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[source(spark, sf_dir, v) for v in views])

        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        return fn

    return register


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in sample_views.VIEWS:
        return sample_views.view(spark, sf_dir, name)
    return sample_views.table(spark, sf_dir, name)


def all_queries() -> dict[str, Query]:
    from skuloom.plans import load

    load()
    return dict(QUERIES)
