"""Readers with fixed schemas that refuse anything unexpected, and lookups by position."""

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """Fail before any action when a column is absent or has another type; keeps only the required ones."""
    have = dict(df.dtypes)
    problems = [f"{name}: need {kind}, have {have.get(name, 'nothing')}" for name, kind in required.items() if have.get(name) != kind]
    if problems:
        raise ValueError("; ".join(problems))
    return df.select(*required)


def scan_spectra(spark: SparkSession, path: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """Parquet with a declared schema and an explicit column list."""
    return spark.read.schema(schema).parquet(path).select(*columns)


def scan_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = ",") -> DataFrame:
    """Delimited text with exactly this header, every value a string, nothing turned into NULL by its spelling."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
            .option("sep", separator).option("multiLine", False).option("escape", '"').csv(path))


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a malformed line fails the read and a blank line fails the check."""
    blank = spark.read.text(path).filter(F.trim("value") == "")
    if not blank.isEmpty():
        raise ValueError("blank line in JSON lines input")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _refuse_constant(name: str):
    raise ValueError(f"constant {name}")


def _unique(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ValueError("repeated key")
    return dict(pairs)


def _strict(text: str | None) -> str:
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse_constant)
        return "ok" if isinstance(value, dict) else "not_object"
    except (TypeError, ValueError) as error:
        return str(error) if str(error).startswith(("repeated", "constant")) else "malformed"


def strict_json_status(text: Column) -> Column:
    """``ok``, or why a strict parser refuses the document (repeated keys and NaN constants included)."""

    @F.pandas_udf("string")
    def check(values: pd.Series) -> pd.Series:
        return values.map(_strict)

    return check(text)


def inflate(payload: Column) -> Column:
    """zlib-inflate a binary column."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else zlib.decompress(b))

    return run(payload)


def scan_roles(blocks: DataFrame, block: str, payload: str, size: int) -> DataFrame:
    """Two-bit roles per structure from base64 zlib blocks; position = block * size + offset, four roles per byte, high bits first."""
    raw = blocks.select(block, inflate(F.unbase64(payload)).alias("_b"))
    text = raw.select(block, F.hex("_b").alias("_h"))
    nibbles = text.select(block, F.posexplode(F.split("_h", "")).alias("_i", "_c")).filter(F.col("_c") != "")
    value = F.conv("_c", 16, 10).cast("int")
    roles = nibbles.select((F.col(block) * size + F.col("_i") * 2).alias("_p"),
                           F.posexplode(F.array(F.floor(value / 4), value % 4)).alias("_k", "role"))
    return roles.select((F.col("_p") + F.col("_k")).alias("position"), F.col("role").cast("int").alias("role"))


def encode_roles(df: DataFrame, position: str, role: str, size: int) -> DataFrame:
    """The inverse of ``scan_roles``: one row per block of ``size`` positions (a multiple of four)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import base64

        import numpy as np

        values = np.zeros(size, np.uint8)
        values[pdf["_at"].to_numpy()] = pdf["_role"].to_numpy()
        quads = values.reshape(-1, 4)
        packed = (quads << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
        return pd.DataFrame({"block": [int(pdf["_block"].iloc[0])], "payload": [base64.b64encode(zlib.compress(packed.tobytes())).decode()]})

    rows = df.select(F.floor(F.col(position) / size).alias("_block"), (F.col(position) % size).cast("int").alias("_at"), F.col(role).cast("int").alias("_role"))
    return rows.groupBy("_block").applyInPandas(pack, "block bigint, payload string")  # at most `size` rows per block


def rows_at(df: DataFrame, position: str, requests: DataFrame) -> DataFrame:
    """Rows at the requested positions, by the explicit position column."""
    return df.join(requests.select(position), position, "left_semi")


def manifest_audit(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Every file of either side with what is wrong: missing, unlisted, size or digest."""
    a, b = found.alias("f"), listed.alias("l")
    joined = a.join(b, F.col("f.name") == F.col("l.name"), "full_outer")
    status = (F.when(F.col("f.name").isNull(), "missing").when(F.col("l.name").isNull(), "unlisted")
              .when(F.col("f.bytes") != F.col("l.bytes"), "size").when(F.col("f.sha256") != F.col("l.sha256"), "digest").otherwise("ok"))
    return joined.select(F.coalesce("f.name", "l.name").alias("name"), status.alias("status"))
