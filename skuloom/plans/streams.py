"""Streaming queries, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuloom.registry import QUERIES, source
from skuloom.session import work_dir
from skuloom.sources.sample_views import VIEWS
from skuloom.streaming import jobs

def run_log_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = events.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("status"))
    out = jobs.drain(jobs.run_log_windows(log), "run-log", ["window_start", "window_end", "status"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})

QUERIES["run_log_stream"] = run_log_stream

def memory_stream(spark, sf_dir):
    """The increments of ``memory_delta``, read from the given file as a stream, folded into the memory."""
    memory = source(spark, sf_dir, "source_memory")
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    part = spark.readStream.schema(schema).option("pathGlobFilter", "part.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    part.createOrReplaceTempView("part_stream")
    outcomes = spark.sql(VIEWS["memory_delta"].replace("FROM part", "FROM part_stream"))
    return jobs.run_memory_stream(outcomes, memory, work_dir(spark, "memory-stream"), ["product_page_url"])


QUERIES["memory_stream"] = memory_stream
