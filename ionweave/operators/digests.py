"""Digests of whole columns, hash orders and licence dispositions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_ordered(df: DataFrame, ident: str, tag: str, size: int) -> DataFrame:
    """The first ``size`` ids in the order of ``sha256(tag || id)`` (the bound is the feature)."""
    keyed = df.withColumn("_h", F.sha2(F.concat(F.lit(tag), F.col(ident).cast("string")), 256))
    first = keyed.orderBy("_h", ident).limit(size)  # per-task top-k, then one merge of size rows per task
    order = Window.partitionBy(F.lit(0)).orderBy("_h", ident)
    return first.withColumn("pos", F.row_number().over(order).cast("bigint")).drop("_h")


def license_disposition(licence: Column, allowed: str, source: Column, held_pattern: str) -> Column:
    """Why a record is left out, or ``kept``: licence first, then a blank or held source."""
    return (F.when(licence.isNull() | (licence != allowed), "license")
            .when(source.isNull() | (F.trim(source) == "") | F.lower(source).rlike(held_pattern), "source")
            .otherwise("kept"))


def sequence_digest(df: DataFrame, keys: list[str], position: str, text: str, fan_out: int = 4096) -> DataFrame:
    """Order-sensitive, length-delimited digest of a text column per group, as a tree of sha256.

    Blocks of ``fan_out`` (a power of two) consecutive positions are hashed first, then blocks of blocks, so no task
    holds more than one block however long the group is. There are as many levels as any 63-bit position needs: the
    upper ones hold one block a group, and the digest does not depend on how far positions go.
    """
    bits = fan_out.bit_length() - 1
    if fan_out != 1 << bits or bits < 1:
        raise ValueError("fan_out must be a power of two")
    levels = -(-63 // bits)
    # each text is hashed where it is read, so a block holds digests and lengths, not texts
    level = df.select(*keys, F.col(position).alias("_pos"), F.concat(
        F.octet_length(text).cast("string"), F.lit(":"), F.sha2(text, 256)).alias("_part"))
    for depth in range(levels):
        last = depth == levels - 1
        block = keys if last else [*keys, "_block"]
        if not last:
            level = level.withColumn("_block", F.floor(F.col("_pos") / fan_out))
        parts = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_part"))), lambda p: p["_part"])
        level = level.groupBy(*block).agg(F.sha2(F.array_join(parts, ""), 256).alias("_digest"))
        if last:
            return level.select(*keys, F.col("_digest").alias("sequence_digest"))
        level = level.select(*keys, F.col("_block").alias("_pos"), F.concat(F.lit("64:"), F.col("_digest")).alias("_part"))
    return level


def multiset_digest(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Order-insensitive digest: the sum of 60-bit sha256 heads, as text."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.sum(head).cast("string").alias("multiset_digest"))
