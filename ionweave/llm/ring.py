"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``POINTS`` virtual nodes. A document lies on the ring by a hash of its doc_id, length and checksum, and
belongs to the next node clockwise; documents that overflow a full shard continue clockwise to the next shard with
room. Documents between two nodes share one order of shards, so the overflow is settled on the counts of the arcs (one
row for each node, whatever the input), and a document follows from its rank in its arc. Capacities are the exact
share, the odd rows going to the first shards, so counts differ by one at most: the law ``rows``. With ``slack`` above
0 shards may hold that much more than their share, and fewer documents move.

Defined results: a null text has size 1 and the checksum of nothing; rows without doc_id lie by the rest of their key;
equal rows take neighbouring slots in any order; an empty table gives no rows. Other columns are ignored.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 256


def ring(shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted node positions and their shards. A shard's nodes do not depend on how many others there are."""
    at = [(int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(points)]
    at.sort()
    return np.array([p for p, _ in at]), np.array([s for _, s in at])


def clockwise(owner: np.ndarray, arc: int) -> list[int]:
    """The distinct shards met from an arc on."""
    return list(dict.fromkeys(np.roll(owner, -arc).tolist()))


def settle(counts: dict[int, int], owner: np.ndarray, room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank + 1, shard, first slot): nearer shards are filled first, the rest continues clockwise."""
    orders = {arc: clockwise(owner, arc) for arc in counts}
    left, taken, used, out = dict(counts), dict.fromkeys(counts, 0), [0] * len(room), []
    for turn in range(len(room)):
        for arc in sorted(counts):
            shard = orders[arc][turn]
            n = min(left[arc], room[shard] - used[shard])
            if n > 0:
                out.append((arc, taken[arc], taken[arc] + n, shard, used[shard]))
                used[shard] += n
                taken[arc] += n
                left[arc] -= n
    return out


def shard(docs: DataFrame, shards: int = 8, points: int = POINTS, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    spark = docs.sparkSession
    position, owner = ring(shards, points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arc = np.searchsorted(position, batch.column("place").to_numpy()) % position.size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(arc, pa.int32())], [*batch.schema.names, "arc"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = keyed.withColumn("place", F.xxhash64("doc_id", "size", "text_crc32")).mapInArrow(run, "doc_id long, size long, text_crc32 long, place long, arc int")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each node
    total = sum(counts.values())
    if slack:
        room = [math.ceil((1 + slack) * total / shards)] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    table = spark.createDataFrame(settle(counts, owner, room), "arc int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size")) - 1
    ranked = keyed.withColumn("_rank", rank).join(F.broadcast(table), "arc").filter("_rank >= _from and _rank < _to")  # the table is bounded by nodes and shards
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
