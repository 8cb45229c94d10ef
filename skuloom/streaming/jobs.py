"""Streaming forms of the source-memory merge and the run-log report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skuloom.operators.memory import MEMORY_KEYS, fold_memory
from skuloom.session import work_dir


def run_log_windows(log: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Entries per status and tumbling window; late entries beyond ``delay`` are dropped by the watermark."""
    rows = log.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    return (
        rows.groupBy(F.window("timestamp", width), "status")
        .agg(F.count("*").alias("entries"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "status", "entries")
    )


def drain(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an aggregated stream over what is available now; the newest row per key, open windows included.

    Every batch writes the rows it changed under its own number, so a batch that is run again replaces its own rows.
    """
    spark = stream.sparkSession
    folder = work_dir(spark, name)
    schema, rest = stream.schema, [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    # Batch -1 is empty: a stream without input has a table as well.
    spark.createDataFrame([], schema).write.parquet(f"{folder}/rows/batch=-1")
    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("newest"))
    return newest.select(*keys, *[F.col(f"newest.{c}").alias(c) for c in rest])


class MemoryLog:
    """A keyed table kept as a base and the changes of each batch.

    Batch n writes only the records of the keys it touches, below its own number.  Every ``compact``-th batch also writes a new base, so
    a reader sees one base and at most ``compact`` batches.  What batch n reads is below its number and never written again, so a
    batch that is run again after a failure writes the same records.  Base and changes lie in ``folder``, which executors share.
    """

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame, order: list[str], compact: int = 16):
        self.spark, self.folder, self.order, self.compact = spark, folder, order, compact
        self.schema = start.schema
        start.write.mode("ignore").parquet(f"{folder}/base/upto=-1")
        # Batch -2 is empty: a log without batches can be read as well.
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{folder}/changes/batch=-2")

    def base_of(self, number: int) -> int:
        """The last batch inside the base that batch ``number`` reads."""
        return number // self.compact * self.compact - 1

    def _log(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("batch", LongType())])).parquet(f"{self.folder}/changes")

    def table(self, upto: int, through: int, keys: DataFrame | None = None) -> DataFrame:
        """The base of batch ``upto`` with the changes behind it up to batch ``through``; of the given keys only, if any."""
        base = self.spark.read.schema(self.schema).parquet(f"{self.folder}/base/upto={upto}").withColumn("batch", F.lit(-1).cast("long"))
        rows = base.unionByName(self._log().filter((F.col("batch") > max(upto, -1)) & (F.col("batch") <= through)))
        if keys is not None:
            rows = rows.join(keys, MEMORY_KEYS, "left_semi")
        rest = [f.name for f in self.schema if f.name not in MEMORY_KEYS]
        newest = rows.groupBy(*MEMORY_KEYS).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
        return newest.select(*MEMORY_KEYS, "r.*").select(*self.schema.names)

    def write(self, batch: DataFrame, number: int) -> None:
        """Function for ``foreachBatch``."""
        old = self.table(self.base_of(number), number - 1, batch.select(*MEMORY_KEYS).distinct())
        new = fold_memory(old, batch, self.order).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        new.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        if (number + 1) % self.compact == 0:
            self.table(self.base_of(number), number).write.mode("overwrite").parquet(f"{self.folder}/base/upto={number}")

    def now(self) -> DataFrame:
        """The table behind the last batch."""
        last = self._log().agg(F.max("batch").alias("n")).first()["n"]
        last = -1 if last is None else last
        return self.table(self.base_of(last + 1), last)


def run_memory_stream(outcomes: DataFrame, start: DataFrame, folder: str, order: list[str], compact: int = 16) -> DataFrame:
    """Fold a stream of enrichment outcomes, one by one per key in ``order``, into the memory table kept under ``folder``.

    A folder that has a table already goes on from it.
    """
    log = MemoryLog(start.sparkSession, folder, start, order, compact)
    query = (
        outcomes.writeStream.foreachBatch(log.write)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log.now()
