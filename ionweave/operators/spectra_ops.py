"""Operations that combine several spectra of one query."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peaks as pk
from .skew import BOUNDED, find_hot, with_stats


SLICE = 64.0


def merged_views(views: DataFrame, query: str, view: str, peaks: str, gap: float = 0.005, width: float = SLICE) -> DataFrame:
    """(query, mz, intensity) of the peaks of all views of a query, each scaled to its own maximum, that no close neighbour replaces.

    Of two neighbours nearer than ``gap`` the stronger stays, of equals the later one; a chain is judged by its original
    neighbours. Peaks are ordered inside slices of the m/z axis ``width`` (over ``gap``) wide, and the last and first
    peak of a slice cross to the next, so the views of one query are merged by many tasks and never gathered.
    """
    if width <= gap:
        raise ValueError("slices must be wider than the gap")
    scaled = views.select(query, F.col(view).alias("_view"), F.posexplode(pk.base_scaled(F.col(peaks))).alias("_pos", "_p"))
    rows = scaled.select(query, "_view", "_pos", F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity"), F.floor(F.col("_p.mz") / F.lit(width)).alias("_slice"))
    peak = F.struct("mz", "_view", "_pos", "intensity")
    ends = rows.groupBy(query, "_slice").agg(F.min(peak).alias("_first"), F.max(peak).alias("_last"))
    # an empty slice between two peaks is wider than the gap, so only the next slice matters
    near = ends.select(query, (F.col("_slice") + 1).alias("_slice"), F.col("_last").alias("_prior")).join(
        ends.select(query, (F.col("_slice") - 1).alias("_slice"), F.col("_first").alias("_next")), [query, "_slice"], "full_outer")
    inside = Window.partitionBy(query, "_slice").orderBy("mz", "_view", "_pos")
    joined = rows.join(near, [query, "_slice"], "left").withColumn("_before", F.coalesce(F.lag(peak).over(inside), F.col("_prior"))).withColumn(
        "_after", F.coalesce(F.lead(peak).over(inside), F.col("_next")))
    weaker = (F.col("mz") - F.col("_before.mz") < gap) & (F.col("intensity") < F.col("_before.intensity"))
    replaced = (F.col("_after.mz") - F.col("mz") < gap) & (F.col("_after.intensity") >= F.col("intensity"))
    return joined.filter(~F.coalesce(weaker, F.lit(False)) & ~F.coalesce(replaced, F.lit(False))).select(query, "mz", "intensity")


def mass_basis(rows: DataFrame, keys: list[str], mz: str, intensity: str, decimals: int = 4) -> DataFrame:
    """Positive peaks on a rounded m/z grid (half-even), the largest intensity of each grid point."""
    kept = rows.filter((F.col(mz) > 0) & (F.col(intensity) > 0))
    return kept.groupBy(*keys, F.bround(mz, decimals).cast("double").alias(mz)).agg(F.max(intensity).alias(intensity))


def energy_mixture(rows: DataFrame, query: str, energy: str, mz: str, intensity: str, top: int = 100, decimals: int = 4) -> DataFrame:
    """Equal-weight mixture of base-peak-normalised energies, strongest ``top``, scaled to maximum one."""
    hot = find_hot(rows, [query])
    basis = mass_basis(rows, [query, energy], mz, intensity, decimals)
    # a query has a handful of energies
    scaled = with_stats(basis, [query], {"_e": F.collect_set(energy)}, hot).withColumn("_k", F.size("_e")).drop("_e")
    scaled = with_stats(scaled, [query, energy], {"_base": F.max(intensity)}, hot)
    parts = scaled.withColumn("_part", F.col(intensity) / F.col("_base") / F.col("_k"))
    mixed = parts.groupBy(query, mz).agg(F.sum("_part").alias(intensity))
    order = Window.partitionBy(query).orderBy(-F.round(intensity, 12), mz)
    kept = mixed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")
    # at most `top` peaks per query are left
    return with_stats(kept, [query], {"_max": F.max(intensity)}, BOUNDED).withColumn(intensity, F.col(intensity) / F.col("_max")).drop("_max")


def compatible_groups(views: DataFrame, query: str, known: list[str], fallible: list[str], row: str) -> DataFrame:
    """Views of a query grouped by acquisition conditions; a view with an unknown condition stands alone."""
    unknown = F.lit(False)
    for c in fallible:
        unknown = unknown | F.col(c).isNull()
    alone = F.when(unknown, F.col(row)).alias("_alone")
    return views.groupBy(query, *known, *fallible, alone).agg(F.min(row).alias("first_view"), F.count(F.lit(1)).alias("n_views"))
