"""Run-log reports and section planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuloom.functions.text import norm_text


def run_stats(log: DataFrame) -> DataFrame:
    """Entries and mean seconds by path and status."""
    return log.groupBy("path_no", "status").agg(
        F.count("*").alias("entries"), F.round(F.avg("seconds"), 6).alias("mean_seconds")
    )


def most_common(log: DataFrame, column: str) -> DataFrame:
    """Counts, most frequent first (ties by text)."""
    return log.groupBy(column).agg(F.count("*").alias("times")).sort(F.desc("times"), column)


def missing_sections(needed: DataFrame, existing: DataFrame) -> DataFrame:
    """Sections that must be created: needed names without a match on the normalised name."""
    want = (
        needed.filter(norm_text(F.col("section")) != "")
        .groupBy(norm_text(F.col("section")).alias("key"))
        .agg(F.min("section").alias("section"))
    )
    have = existing.select(norm_text(F.col("section")).alias("key")).distinct()
    return want.join(have, "key", "left_anti")
