"""Structured Streaming jobs: lookups against a static bank, resumable scoring, running coverage.

Each micro-batch is written under its own batch id, so a replayed batch replaces itself. The
reference behaviour has no event time; none of these drops late rows.
"""

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table as a file stream, read in micro-batches with its stored schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # the bracket makes it a pattern, which serves a single file and a folder of parts alike
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], DataFrame], output: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Apply ``step`` to every available micro-batch and return everything written, also by earlier runs on the same ``checkpoint``."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    running = (stream.writeStream.outputMode(mode).foreachBatch(write)
               .option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.option("basePath", output).parquet(f"{output}/batch=*")


def window_lookup(stream: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Range-join every micro-batch against a bank held static across batches."""
    return run_batches(stream, lambda batch, _: lookup(batch), scratch(stream.sparkSession, "lookup")).drop("batch")


def incremental_scores(stream: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], done_path: str, order: list[str] | None = None) -> DataFrame:
    """Score only rows whose key is not yet in ``done_path``; returns everything scored so far.

    The stream's checkpoint belongs to one run, and so do its folders: a replayed batch replaces itself, never what an
    earlier run has written. Of rows that repeat a key in a batch the first by ``order`` (all columns if none) is scored.
    """
    spark, run = stream.sparkSession, uuid.uuid4().hex

    def step(batch: DataFrame, batch_id: int) -> None:
        own = f"{run}-{batch_id}"
        names = order or batch.columns
        first = batch.groupBy(key).agg(F.min(F.struct(*names, *[c for c in batch.columns if c not in names])).alias("_row")).select("_row.*")
        done = _scored(spark, done_path)
        fresh = first if done is None else first.join(done.filter(F.col("batch") != own).select(key), key, "left_anti")
        score(fresh.select(batch.columns)).write.mode("overwrite").parquet(f"{done_path}/batch={own}")

    running = (stream.writeStream.foreachBatch(step).option("checkpointLocation", scratch(spark, "stream"))
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.parquet(done_path).drop("batch")


def _scored(spark: SparkSession, path: str) -> DataFrame | None:
    """What is written under ``path``; None only where nothing is there yet."""
    try:
        return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
