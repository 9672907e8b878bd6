"""Tolerance range joins as bucketed equi-joins with an exact re-check.

A plain ``BETWEEN`` join plans a nested loop. Here every bank row gets one bucket, every window
the one or two buckets it touches, and the closed interval is tested again on the matched pairs.
"""

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from . import skew, sweep

GUARD = 1e-6  # far above the rounding of ln(x) / width, far below one bucket


def ppm_bounds(center: Column, ppm: float | Column) -> tuple[Column, Column]:
    """Closed window ``center -/+ center * (ppm / 1e6)``, in that operation order."""
    part = F.lit(ppm / 1e6) if isinstance(ppm, (int, float)) else ppm / F.lit(1e6)
    half = center * part
    return center - half, center + half


def _log_bucket(value: Column, width: float, nudge: float = 0.0) -> Column:
    return F.floor(F.log(value) / F.lit(width) + F.lit(nudge))


def _linear_bucket(value: Column, width: float, nudge: float = 0.0) -> Column:
    return F.floor(value / F.lit(width) + F.lit(nudge))


def window_pairs(queries: DataFrame, bank: DataFrame, mass: str, lo: str = "lo", hi: str = "hi", *,
                 query_id: str, bank_id: str, max_ppm: float | None = None, width: float | None = None,
                 on: tuple[str, ...] = (), limit: int = skew.HOT_ROWS) -> DataFrame:
    """All (query, bank) rows with ``lo <= mass <= hi``.

    ``max_ppm`` bounds the half width of positive windows relative to their centre (log buckets);
    ``width`` is an absolute bucket size instead. Either is only a speed setting: a wider window
    simply touches more buckets. ``on`` names equality columns both sides have; no other column
    name may occur on both sides.
    """
    if max_ppm is not None:
        step, bucket = math.log1p(2.5e-6 * max(max_ppm, 1e-3)), _log_bucket
        bank = bank.filter(F.col(mass) > 0)
        # a bound at or under zero starts at the bank's smallest mass (one row), not at the smallest double
        least = bank.agg(F.coalesce(F.min(mass), F.lit(1.0)).cast("double").alias("_least"))
        queries = queries.filter(F.col(hi) > 0).crossJoin(F.broadcast(least)).filter(F.col(hi) >= F.col("_least"))
        queries = queries.withColumn("_from", bucket(F.greatest(F.col(lo), F.col("_least")), step, -GUARD)).drop("_least")
    else:
        step, bucket = width, _linear_bucket
        queries = queries.withColumn("_from", bucket(F.col(lo), step, -GUARD))
    queries = queries.filter(F.col(lo) <= F.col(hi))
    queries = queries.withColumn("_to", bucket(F.col(hi), step, GUARD))
    queries = queries.withColumn("_bucket", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    bank = bank.withColumn("_bucket", bucket(F.col(mass), step))
    pairs = skew.salted_join(queries, bank, [*on, "_bucket"], F.col(query_id), F.col(bank_id), limit)
    return pairs.filter(F.col(mass).between(F.col(lo), F.col(hi))).drop("_bucket")


def side_bounds(target: Column, lo_ppm: float, hi_ppm: float) -> tuple[Column, Column]:
    """Closed window with its own tolerance on each side: ``target * (1 -/+ ppm / 1e6)``."""
    return target * (1 - F.lit(lo_ppm / 1e6)), target * (1 + F.lit(hi_ppm / 1e6))


def window_union(estimates: DataFrame, baseline: DataFrame, bank: DataFrame, *, query_id: str, estimate: str,
                 bank_mass: str, bank_id: str, ppm: float, limit: int = skew.HOT_ROWS) -> DataFrame:
    """Distinct (query, bank) ids: the baseline plus the window of every finite positive estimate.

    The half width is ``estimate * ppm / 1e6``, in that order.
    """
    value = F.col(estimate)
    usable = estimates.filter(finite(value) & (value > 0))
    half = value * F.lit(float(ppm)) / F.lit(1e6)
    usable = usable.select(query_id, value.alias("_at"), (value - half).alias("lo"), (value + half).alias("hi")).distinct()
    # pairs are counted first, without forming them: they are dealt to as many tasks as that needs
    counted = sweep.window_counts(usable.select("_at"), bank.select(bank_mass), query_mass="_at", bank_mass=bank_mass, ppms=[float(ppm)])
    pairs = counted.agg(F.coalesce(F.sum(counted.columns[-1]), F.lit(0))).first()[0] + baseline.count()  # one number
    found = window_pairs(usable, bank.select(bank_id, bank_mass), bank_mass, query_id=query_id, bank_id=bank_id,
                         max_ppm=ppm, limit=limit)
    both = baseline.select(query_id, bank_id).unionByName(found.select(query_id, bank_id))
    return skew.dealt(both, [query_id, bank_id], pairs).distinct()


def peak_matches(observed: DataFrame, predicted: DataFrame, *, on: tuple[str, ...], observed_mz: str,
                 predicted_mz: str, observed_id: str, predicted_id: str, abs_tol: float, ppm: float = 0.0,
                 limit: int = skew.HOT_ROWS) -> DataFrame:
    """Observed and predicted peaks of the same pair within ``max(abs_tol, ppm * observed)``."""
    tol = F.greatest(F.lit(abs_tol), F.col(observed_mz) * F.lit(ppm * 1e-6))
    widened = (observed.withColumn("_tol", tol)
               .withColumn("lo", F.col(observed_mz) - F.col("_tol") * F.lit(1 + 1e-9))
               .withColumn("hi", F.col(observed_mz) + F.col("_tol") * F.lit(1 + 1e-9)))
    pairs = window_pairs(widened, predicted, predicted_mz, query_id=observed_id, bank_id=predicted_id,
                         width=max(abs_tol * 4, 1e-9), on=on, limit=limit)
    return (pairs.filter(F.abs(F.col(predicted_mz) - F.col(observed_mz)) <= F.col("_tol"))
            .drop("lo", "hi", "_tol"))


def mass_window_join(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, query_id: str,
                     bank_id: str, ppm: float, limit: int = skew.HOT_ROWS) -> DataFrame:
    """Inclusive ppm join with the query mass as denominator; duplicates are kept."""
    lo, hi = ppm_bounds(F.col(query_mass), ppm)
    queries = queries.filter(finite(F.col(query_mass)) & (F.col(query_mass) > 0)).withColumn("lo", lo).withColumn("hi", hi)
    pairs = window_pairs(queries, bank, bank_mass, query_id=query_id, bank_id=bank_id, max_ppm=ppm, limit=limit)
    return pairs.drop("lo", "hi")


@dataclass(frozen=True)
class StoredBank:
    """A bank laid out for lookups: a table bucketed by mass bucket and sorted by mass."""

    table: str
    mass: str
    step: float


def store_bank(bank: DataFrame, mass: str, max_ppm: float, path: str, buckets: int = 64) -> StoredBank:
    """Write the rows of positive finite mass once, for windows of up to about ``max_ppm``, below the shared ``path``."""
    step = math.log1p(2.5e-6 * max(max_ppm, 1e-3))
    name = f"bank_{uuid.uuid4().hex}"
    rows = bank.filter(finite(F.col(mass)) & (F.col(mass) > 0)).withColumn("_bucket", _log_bucket(F.col(mass), step))
    rows.write.bucketBy(buckets, "_bucket").sortBy("_bucket", mass).option("path", path).saveAsTable(name)
    return StoredBank(name, mass, step)


def lookup(queries: DataFrame, stored: StoredBank, query_mass: str, ppm: float) -> DataFrame:
    """Inclusive ppm join of a batch of queries with a stored bank, which is read in place: it is not shuffled, and files
    and row groups outside the batch's masses are skipped."""
    spark = queries.sparkSession
    lo, hi = ppm_bounds(F.col(query_mass), ppm)
    q = queries.filter(finite(F.col(query_mass)) & (F.col(query_mass) > 0)).withColumn("lo", lo).withColumn("hi", hi)
    least, most = q.agg(F.min("lo"), F.max("hi")).first()  # two numbers
    bank = spark.table(stored.table)
    bank = bank.filter(F.col(stored.mass).between(least, most)) if least is not None else bank.limit(0)
    tiny = F.lit(2.0 ** -1000)  # a window that reaches below zero starts here
    q = q.withColumn("_bucket", F.explode(F.sequence(_log_bucket(F.greatest("lo", F.lit(max(least or 0.0, 1e-290)), tiny), stored.step, -GUARD), _log_bucket(F.col("hi"), stored.step, GUARD))))
    return q.join(bank, "_bucket").filter(F.col(stored.mass).between(F.col("lo"), F.col("hi"))).drop("lo", "hi", "_bucket")
