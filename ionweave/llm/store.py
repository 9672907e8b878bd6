"""Tables written to the cluster's shared folder to cut lineage, and runs of equal keys inside sorted partitions."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # rows of this subpackage's own tables can be long (texts, sets), and a batch is held on both sides


def stored(frame: DataFrame) -> DataFrame:
    """Write once as Parquet under ``spark.checkpoint.dir`` and read back: computed once, kept if an executor is lost."""
    spark = frame.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(frame.schema).parquet(folder)


BYTES = 16 << 20  # of rows held at a time, unless one run is larger


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, run bounds) pieces of a partition sorted by integer ``keys``, made of whole runs.

    A piece has about ``most`` rows or ``BYTES`` bytes, whichever comes first; more only where one run has more.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    room = 1  # doubled while a run goes on, so that a long one is not looked through for each batch

    def split(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for key in keys:
            values = table.column(key).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(batch.num_rows, BYTES // 4 * batch.num_rows // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):  # a batch may hold many large rows
            held.append(batch.slice(at, step))
            rows += held[-1].num_rows
            size += held[-1].nbytes
            if rows < room * most and size < room * BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            bounds = split(table)
            cut = int(bounds[-2])
            if cut:
                yield table.slice(0, cut), bounds[:-1]
                rest = table.slice(cut)
                held = rest.take(np.arange(rest.num_rows)).to_batches()  # a copy, so that the piece can go
                rows, size, room = rest.num_rows, rest.nbytes, 1
            else:
                held, room = table.to_batches(), 2 * room
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, split(table)


def map_runs(frame: DataFrame, keys: list[str], schema: str, run: Callable[[pa.Table, np.ndarray], pa.Table], most: int = 1 << 14,
             order: list[str] | None = None) -> DataFrame:
    """Bring rows of equal keys together, sort them, and map pieces made of whole runs; small runs share a piece.

    Runs must be bounded.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, keys, most):
            out = run(table, bounds).select(names)
            yield from out.to_batches(max_chunksize=1 << 14)

    return frame.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(go, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges ``(a, b)``: the smallest node it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014); each is a grouped minimum and a join, so a hub is never
    collected. Every round is written to the shared folder, and the rounds end when only stars are left.
    """
    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(current.select("b", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").limit(1).count():
            break  # every node has one smaller neighbour, which has none: stars
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        current = stored(small.filter("a <> b").distinct())
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct().toDF("node", "component"))
