"""Set operations over catalogues, ranges, roles and lists."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew


def catalogue_union(old: DataFrame, new: DataFrame, key: str, mass: str) -> DataFrame:
    """Old rows (source 0) and new rows whose key is not in the old bank (source 1).

    Write the result with ``repartitionByRange(mass)`` and ``sortWithinPartitions`` so that mass
    windows skip row groups.
    """
    fresh = new.join(old.select(key), key, "left_anti")
    return old.withColumn("source", F.lit(0)).unionByName(fresh.withColumn("source", F.lit(1)))


def range_overlap(df: DataFrame, left_lo: str, left_hi: str, right_lo: str, right_hi: str) -> DataFrame:
    """Sizes of the intersection, union and one-sided parts of two half-open row ranges."""
    a, b, c, d = (F.col(x) for x in (left_lo, left_hi, right_lo, right_hi))
    shared = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    out = df.withColumn("shared", shared).withColumn("union_size", (b - a) + (d - c) - F.col("shared"))
    return (out.withColumn("left_only", (b - a) - F.col("shared")).withColumn("right_only", (d - c) - F.col("shared"))
            .withColumn("jaccard", F.when(F.col("union_size") != 0, F.col("shared") / F.col("union_size"))))


def role_overlaps(df: DataFrame, role: str, member: str) -> DataFrame:
    """Members shared by two roles, for every pair of roles that shares any; empty means disjoint.

    Roles are few, so each member's role set is a short array and no members are ever paired.
    """
    sets = df.select(role, member).distinct().groupBy(member).agg(F.sort_array(F.collect_set(role)).alias("_r"))
    pairs = F.flatten(F.transform("_r", lambda x, i: F.transform(
        F.slice(F.col("_r"), i + 2, F.size("_r")), lambda y: F.struct(x.alias("left_role"), y.alias("right_role")))))
    long = sets.select(F.explode(pairs).alias("p"))
    return long.groupBy("p.left_role", "p.right_role").agg(F.count(F.lit(1)).alias("shared"))


def permutation_report(control: DataFrame, treatment: DataFrame) -> DataFrame:
    """One row: rows (with multiplicity) missing from or added by the treatment."""
    keys = control.columns
    # most keys are single rows: they are dealt before they are summed, as a sum before would hold a whole input split
    signed = control.withColumn("_n", F.lit(1)).unionByName(treatment.select(*keys).withColumn("_n", F.lit(-1)))
    net = skew.dealt(signed, keys).groupBy(*keys).agg(F.sum("_n").alias("_d"))
    out = net.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("missing"),
                  F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("extra"))
    return out.withColumn("is_permutation", (F.col("missing") == 0) & (F.col("extra") == 0))


def common_bins(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bins present in both sparse vectors, one value each."""
    a = left.groupBy(*keys).agg(F.max(value).alias("left_value"))
    b = right.groupBy(*keys).agg(F.max(value).alias("right_value"))
    return a.join(b, keys)
