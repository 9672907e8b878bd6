"""Key joins: lookups, strict alignments, coverage, anti and semi joins, and mapping over distinct keys."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_key_lookup(queries: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every query row kept, ``matched`` telling a stored zero from an absent key."""
    marked = values.withColumn("_hit", F.lit(True))
    return queries.join(marked, key, "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def one_to_one_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys on both sides, on one side only, and keys held by several rows."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, keys, "full_outer")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))

    out = both.agg(
        total(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        total(F.col("_r").isNull()).alias("left_only"), total(F.col("_l").isNull()).alias("right_only"),
        total(F.coalesce(F.col("_l") > 1, F.lit(False))).alias("left_repeated"),
        total(F.coalesce(F.col("_r") > 1, F.lit(False))).alias("right_repeated"))
    clean = F.lit(True)
    for name in ("left_only", "right_only", "left_repeated", "right_repeated"):
        clean = clean & (F.col(name) == 0)
    return out.withColumn("one_to_one", clean)


def ordered_row_report(left: DataFrame, right: DataFrame, row: str, ident: str) -> DataFrame:
    """One row: do both sides hold the same unique, nonempty ids at the same positions?"""
    joined = left.select(row, F.col(ident).alias("_a")).join(right.select(row, F.col(ident).alias("_b")), row, "full_outer")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    ids = left.groupBy(ident).agg(F.count(F.lit(1)).alias("_n"))
    repeated = ids.agg(F.coalesce(F.sum((F.col("_n") > 1).cast("bigint")), F.lit(0)).alias("repeated_ids"))
    out = joined.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.coalesce(F.sum((~same).cast("bigint")), F.lit(0)).alias("mismatches"))
    # both sides are one-row aggregates
    return out.join(F.broadcast(repeated)).withColumn(
        "aligned", (F.col("n_rows") > 0) & (F.col("mismatches") == 0) & (F.col("repeated_ids") == 0))


CHUNK, BROADCAST_CHUNKS = 4096, 16


def missing_combinations(present: DataFrame, group: str, view: str, chunk: int = CHUNK) -> DataFrame:
    """(group, view) combinations that are absent.

    Views are dealt into chunks of about ``chunk``; each group meets each chunk once, as an array, and keeps what it
    lacks. The groups are never crossed with each other, and no row holds more than a chunk. A few chunks are broadcast,
    more are joined by a shuffle.
    """
    pairs = present.select(group, view).distinct()
    views = pairs.select(view).distinct()
    chunks = max(1, -(-views.count() // chunk))
    own = F.pmod(F.xxhash64(view), F.lit(chunks)).cast("int").alias("_chunk")
    every = views.groupBy(own).agg(F.collect_set(view).alias("_views"))
    have = pairs.groupBy(group, own).agg(F.collect_set(view).alias("_have"))
    wanted = pairs.select(group).distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    joined = wanted.join(have, [group, "_chunk"], "left").join(F.broadcast(every) if chunks <= BROADCAST_CHUNKS else every, "_chunk")
    none = F.array().cast(f"array<{present.schema[view].dataType.simpleString()}>")
    return joined.select(group, F.explode(F.array_except("_views", F.coalesce("_have", none))).alias(view))


def new_only(catalogue: DataFrame, bank: DataFrame, key: str) -> DataFrame:
    """Catalogue rows whose key the bank does not hold."""
    return catalogue.join(bank.select(key), key, "left_anti")


def members_only(rows: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other catalogue holds."""
    return rows.join(catalogue.select(key), key, "left_semi")


def overlap_labels(queries: DataFrame, key: str, optimizer: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Label queries by membership of their group in two other sets."""
    a = optimizer.select(key).distinct().withColumn("_opt", F.lit(True))
    b = checkpoint.select(key).distinct().withColumn("_chk", F.lit(True))
    joined = queries.join(a, key, "left").join(b, key, "left")
    opt, chk = F.col("_opt").isNotNull(), F.col("_chk").isNotNull()
    label = (F.when(opt & chk, "both").when(opt, "optimizer").when(chk, "checkpoint").otherwise("disjoint"))
    return joined.withColumn("overlap", label).drop("_opt", "_chk")


def map_via_distinct(df: DataFrame, column: str, mapper: Callable[[str], str | None] | Callable[[Column], Column], name: str, native: bool = False) -> DataFrame:
    """Apply a costly string mapper once per distinct value and join the result back.

    With ``native`` the mapper makes a column expression; only one that Spark cannot express runs in Python.
    """
    distinct = df.select(column).distinct()
    if native:
        return df.join(distinct.withColumn(name, mapper(F.col(column))), column, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            mapped = pa.array([None if v is None else mapper(v) for v in values.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([values, mapped], names=[column, name])

    mapping = distinct.mapInArrow(run, f"`{column}` string, `{name}` string")
    return df.join(mapping, column, "left")
