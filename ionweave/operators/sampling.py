"""Samples from windows that are never listed.

A window is a range of positions in the bank's mass order. Distinct members are drawn by a keyed permutation of the range:
a four-round Feistel network over the smallest domain of 4^h numbers that holds it, walked again while it leads outside
the range. The draws of a query depend on its own id alone, cost the same whatever the window, and may be any number.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew
from .splits import mass_positions, position_ranges

ROUNDS, MULTIPLIER = 4, 2654435761
DRAWS = 1 << 18  # made at a time


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where ``index`` goes in a permutation of ``range(size)`` that ``key`` (under 2^30) chooses; sizes are under 2^52."""
    half = np.maximum((np.frexp((size - 1).astype(np.float64))[1] + 1) // 2, 1).astype(np.int64)
    mask = (np.int64(1) << half) - 1
    out, rows = index.astype(np.int64).copy(), np.arange(index.size)
    while rows.size:
        h, m = half[rows], mask[rows]
        left, right = out[rows] >> h, out[rows] & m
        for turn in range(ROUNDS):
            left, right = right, left ^ ((((right + key[rows] + turn * 40503) * MULTIPLIER) >> 11) & m)
        out[rows] = (left << h) | right
        rows = rows[out[rows] >= size[rows]]
    return out


def sampled_positions(ranges: DataFrame, query_id: str, size: int, tag: str) -> DataFrame:
    """(query, draw, position): up to ``size`` different positions of each range ``[first, last)``, all if it has no more."""
    key = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(tag), F.col(query_id)), 256), 1, 7), 16, 10).cast("bigint")
    kind = ranges.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, keys = (batch.column(c).to_numpy() for c in ("first", "last", "_key"))
            many = np.minimum(last - first, size)
            upto = np.concatenate([[0], np.cumsum(many)])
            for begin in range(0, int(upto[-1]), DRAWS):  # a query's draws may go on in the next piece
                place = np.arange(begin, min(begin + DRAWS, int(upto[-1])))
                row = np.searchsorted(upto, place, side="right") - 1
                draw = place - upto[row]
                position = first[row] + permuted(draw, (last - first)[row], keys[row])
                yield pa.RecordBatch.from_arrays([batch.column(query_id).take(pa.array(row)), pa.array(draw + 1), pa.array(position)], [query_id, "draw", "position"])

    rows = ranges.filter("last > first").select(query_id, F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), key.alias("_key"))
    return rows.mapInArrow(run, f"`{query_id}` {kind}, draw bigint, position bigint")


def sampled_window(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, query_id: str, bank_id: str, half_width: float, size: int, tag: str = "",
                   limit: int = skew.HOT_ROWS) -> DataFrame:
    """Up to ``size`` different bank rows out of each query's window of ``half_width`` on either side, with all columns and ``draw``.

    Query ids are unique; a query or bank row without a finite mass has no window or is in none.
    """
    mass: Column = F.col(query_mass)
    ranges = position_ranges(queries, bank, query_id, (mass - F.lit(half_width), mass + F.lit(half_width)), bank_mass, limit)
    drawn = sampled_positions(ranges, query_id, size, tag)
    placed = mass_positions(bank, bank_mass, bank_id, limit)
    return queries.join(drawn, query_id).join(placed, "position").drop("position")
