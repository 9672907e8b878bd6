"""Coverage counters over a stream of observations, with the facts behind them held as state.

A fact is a row (identity, direct, proxy type, energy). The state is the set of all facts seen, kept by Spark's own
deduplication; a micro-batch emits a fact only the first time it is delivered, and the counters are one aggregate over
what was emitted. The set is dealt by whole facts, so an identity with very many rows meets in no single task. A run that
starts again on the same checkpoint goes on where it stopped.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import coverage_counters
from ..sources.sinks import scratch
from .streams import run_batches

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different row of a batch once, so that an identity with very many rows sends few."""
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).select(batch.schema.names).to_batches()


def coverage_facts(stream: DataFrame, identity: str, adduct: str, signature: str, direct: str, proxies: dict[str, str]) -> DataFrame:
    """(identity, direct, proxy, sig), each the first time it is delivered; rows without identity are left out, and an energy
    that is null or empty is none."""
    proxy = F.lit(None).cast("string")
    for label, kind in proxies.items():
        proxy = F.when(F.col(adduct) == label, kind).otherwise(proxy)
    sig = F.col(signature).cast("string")
    usable = proxy.isNotNull() & (sig != "")
    rows = stream.filter(F.col(identity).isNotNull() & (F.col(identity) != "")).select(
        F.col(identity).cast("string").alias("identity"), F.coalesce(F.col(adduct) == direct, F.lit(False)).alias("direct"),
        F.when(usable, proxy).alias("proxy"), F.when(usable, sig).alias("sig"))
    return rows.mapInArrow(_distinct, "identity string, direct boolean, proxy string, sig string").dropDuplicates()


def incremental_coverage(stream: DataFrame, identity: str, adduct: str, signature: str, direct: str, proxies: dict[str, str],
                         output: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``identity_coverage`` gives for all rows that the stream has delivered so far on this ``checkpoint``."""
    spark, kinds = stream.sparkSession, sorted(set(proxies.values()))
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)  # the set of facts is larger than a heap
    try:
        facts = run_batches(coverage_facts(stream, identity, adduct, signature, direct, proxies), lambda batch, _: batch,
                            output or scratch(spark, "coverage"), checkpoint=checkpoint)
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    energy = lambda k: F.when(F.col("proxy") == k, F.col("sig"))
    # a type has two energies if its lowest and its highest differ
    now = facts.groupBy("identity").agg(F.max("direct").alias("_direct"), *[f(energy(k)).alias(f"_{n}_{k}") for k in kinds for n, f in (("low", F.min), ("high", F.max))])
    has = lambda k: F.col(f"_low_{k}").isNotNull().cast("int")
    per_identity = now.select(
        "_direct", sum((has(k) for k in kinds), F.lit(0)).alias("_types"), *[has(k).alias(f"_has_{k}") for k in kinds],
        *[F.coalesce((F.col(f"_low_{k}") < F.col(f"_high_{k}")).cast("int"), F.lit(0)).alias(f"_multi_{k}") for k in kinds])
    return coverage_counters(per_identity, kinds)
