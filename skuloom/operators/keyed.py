"""Building blocks for per-key work that stay flat when one key is very large.

* ``attach``: per-key results are aggregated first (map-side partial), then joined
  back; AQE splits the large partitions of such a join.  Keyless rows get a key
  of their own, so they never meet in one partition.
* ``first_per`` and ``top_per``: ``row_number() <= k`` filters, which Spark turns into a
  group limit *before* the shuffle, so each task sends at most k rows per key.
* ``number_within``: running numbers inside a key without one task seeing the
  whole key: rows are counted per (key, slice of the order column), the small
  count table gets running sums, and each slice numbers its own rows.
* ``carry_down``: last filled value above a row, by the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 20


def own_key(key: Column, ordinal: Column) -> Column:
    """Key for joins and groups; keyless rows are keyed by their own ordinal."""
    return F.coalesce(key, F.concat(F.lit("~"), ordinal.cast("string")))


def attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a table that is unique on ``keys``."""
    return rows.join(per_key, keys, "left")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1, "_first").drop("_first")


def number_within(
    df: DataFrame, keys: list[str], order: str, name: str = "n", slice_rows: int = SLICE
) -> DataFrame:
    """1, 2, 3... inside ``keys`` by the whole-number column ``order`` (unique per key)."""
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(slice_rows)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_in_slice"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_in_slice").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("int"))
        .drop("_slice", "_before")
    )


def carry_down(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, slice_rows: int = SLICE
) -> DataFrame:
    """Last non-null ``value`` strictly above each row, inside ``keys`` by ``order``."""
    sliced = df.withColumn("_slice", F.floor(F.col(order) / F.lit(slice_rows)))
    # A slice without a value has a null, so one pass over the rows finds both the slices and their last values.
    last_in = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_in.select(
        *keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(carried, [*keys, "_slice"])
        .withColumn(
            name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried"))
        )
        .drop("_slice", "_carried")
    )
