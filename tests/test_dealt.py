"""Partitions follow the rows, so that no task's share grows with the input."""

import re

import pytest
from pyspark.sql import functions as F

from ionweave.operators import lists, ranking, rangejoin, sets, skew


@pytest.fixture(autouse=True)
def few(monkeypatch):
    monkeypatch.setattr(skew.dealt, "__defaults__", (None, 100))


def partitions(df):
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_windows_and_sums_follow_the_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 500).alias("q"), F.col("id").alias("c"), (F.col("id") % 7).cast("double").alias("s"), (F.col("id") % 3).cast("double").alias("t"))
    assert partitions(ranking.with_midrank(rows, ["q"], "s", "mid")) == [40]
    assert partitions(lists.rrf(rows, "q", ["c"], ["s", "t"])) == [40]
    report = sets.permutation_report(rows.select("q", "c"), rows.select("q", F.when(F.col("c") == 5, -1).otherwise(F.col("c")).alias("c")))
    assert partitions(report) == [80] and tuple(report.first()) == (1, 1, False)
    assert tuple(sets.permutation_report(rows.select("q"), rows.select("q")).first()) == (0, 0, True)


def test_union_of_windows_follows_the_pairs(spark):
    bank = spark.range(300).select(F.col("id").alias("b"), (100 + F.col("id") * 1e-6).alias("m"))
    base = spark.createDataFrame([(1, 7), (1, 900)], "q long, b long")
    asked = spark.createDataFrame([(1, 100.0), (1, 100.00001), (2, 100.0), (2, None), (2, float("nan"))], "q long, e double")
    got = rangejoin.window_union(asked, base, bank, query_id="q", estimate="e", bank_mass="m", bank_id="b", ppm=400.0)
    assert partitions(got) == [10]  # 902 pairs, before equal ones are dropped
    assert got.count() == 601
