"""Exclusive, verified writes."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import permutation_report
from ..session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """zstd Parquet, never over an existing path, then a one-row report of the re-read against the input."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return permutation_report(df, df.sparkSession.read.parquet(path))


def write_exclusive(df: DataFrame, path: str) -> bool:
    """Write unless the path exists; False when it was refused."""
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            return False
        raise


def number_text(value: Column) -> Column:
    """Shortest text that reads back to the same double; undefined becomes NULL (an empty field)."""
    return F.when(value.isNotNull() & ~F.isnan(value), value.cast("string"))


def write_pairs_csv(df: DataFrame, path: str, doubles: list[str]) -> None:
    """Gzip CSV with round-trip doubles and empty fields for undefined ratios."""
    columns = [number_text(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    df.select(*columns).write.mode("errorifexists").option("header", True).option("compression", "gzip").option("nullValue", "").option(
        "emptyValue", "").csv(path)


def ranked_submission(roster: DataFrame, ranked: DataFrame, query: str, item: str, rank: str, size: int = 25) -> DataFrame:
    """One row per roster query, its first ``size`` items joined by ``;`` (empty when there are none)."""
    kept = ranked.filter(F.col(rank) <= size).groupBy(query).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).cast("string").alias("i")))), lambda x: x["i"]), ";").alias("items"))
    return roster.join(kept, query, "left").withColumn("items", F.coalesce("items", F.lit("")))


def write_submission(df: DataFrame, path: str, position: str) -> None:
    """CSV parts in roster order: range-partitioned and sorted, so the parts concatenate in order."""
    df.repartitionByRange(F.col(position)).sortWithinPartitions(position).write.mode("errorifexists").option("header", True).csv(path)
