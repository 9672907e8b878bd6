"""Hot-key paths must give exactly what the plain plans give; a tiny limit makes keys hot."""

import random

import pytest
from pyspark.sql import functions as F

from ionweave.operators import aggregates, rangejoin, skew, splits


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        q = 0 if i % 3 == 0 else rng.randrange(1, 60)  # one key holds a third of all rows
        rows.append((i, q, float(rng.choice([1, 2, 2, 2, 5, 9]) if q == 0 else rng.randrange(40))))
    return spark.createDataFrame(rows, "id long, q int, s double").repartition(5)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numbered_sliced_equals_window(skewed):
    orders = {"a": [-F.col("s"), F.col("id")], "b": [F.col("s"), -F.col("id")]}
    plain = skew.numbered_many(skewed, ["q"], orders, hot=skew.BOUNDED)
    sliced = skew.numbered_many(skewed, ["q"], orders, limit=50)
    assert collected(plain, "id", "a", "b") == collected(sliced, "id", "a", "b")


def test_numbered_survives_repartition(skewed):
    order = [F.col("s"), F.col("id")]
    one = skew.numbered(skewed.repartition(1), ["q"], order, limit=40)
    many = skew.numbered(skewed.repartition(13), ["q"], order, limit=40)
    assert collected(one, "id", "rn") == collected(many, "id", "rn")


def test_tie_ranks(skewed):
    plain = skew.tie_ranks(skewed, ["q"], "s", hot=skew.BOUNDED)
    hot = skew.tie_ranks(skewed, ["q"], "s", limit=30)
    assert collected(plain, "id", "above", "tied", "n") == collected(hot, "id", "above", "tied", "n")


def test_running_total_hot_and_blocks(skewed):
    plain = skew.running_total(skewed, ["q"], [F.col("id")], F.col("s"), "t", hot=skew.BOUNDED)
    hot = skew.running_total(skewed, ["q"], [F.col("id")], F.col("s"), "t", limit=30)
    assert collected(plain, "id", "t") == collected(hot, "id", "t")
    offsets = skew.block_offsets(skewed, "id", F.col("s").cast("long"), "off", block=100)
    expected, run = [], 0
    for i, s in sorted((r.id, r.s) for r in skewed.collect()):
        expected.append((i, run))
        run += int(s)
    assert collected(offsets, "id", "off") == expected


def test_exact_quantiles(skewed):
    want = {"lo": 0.25, "mid": 0.5}
    for keys in (["q"], []):
        plain = aggregates.exact_quantiles(skewed, keys, "s", want)
        hot = aggregates.exact_quantiles(skewed, keys, "s", want, limit=3)
        assert collected(plain, *keys, "lo", "mid") == collected(hot, *keys, "lo", "mid")


@pytest.mark.parametrize("limit", [20, 10**6])
def test_salted_join(skewed, limit):
    left = skewed.select("q", F.col("id").alias("l"))
    right = skewed.filter("id < 600").select("q", F.col("id").alias("r"))
    got = collected(skew.salted_join(left, right, ["q"], F.col("l"), F.col("r"), limit), "l", "r")
    assert got == collected(left.join(right, "q"), "l", "r")


@pytest.mark.parametrize("limit", [25, 10**6])
def test_window_pairs_against_brute_force(spark, limit):
    rng = random.Random(9)
    masses = [round(rng.uniform(100, 130), 3) for _ in range(250)] + [111.111] * 120
    df = spark.createDataFrame(list(enumerate(masses)), "id long, m double")
    pairs = rangejoin.mass_window_join(df.select(F.col("id").alias("a"), F.col("m").alias("am")), df.select(F.col("id").alias("b"), F.col("m").alias("bm")),
                                       query_mass="am", bank_mass="bm", query_id="a", bank_id="b", ppm=300.0, limit=limit)
    want = sorted((i, j) for i, x in enumerate(masses) for j, y in enumerate(masses) if x - x * (300 / 1e6) <= y <= x + x * (300 / 1e6))
    assert collected(pairs, "a", "b") == want


@pytest.mark.parametrize("limit", [15, 10**6])
def test_window_decoys_positions(spark, limit):
    masses = [100.0 + i * 0.0005 for i in range(60)] + [150.0] * 40 + [999.0]
    bank = spark.createDataFrame(list(enumerate(masses)), "row long, m double")
    q = bank.select(F.col("row").alias("q"), F.col("m").alias("qm"), F.col("row").alias("own"))
    out = splits.window_decoys(q, bank, query_id="q", query_mass="qm", own_row="own", mass="m", row="row", ppm=20.0, draws=5, seed="t", limit=limit)
    rows = out.collect()
    assert len(rows) == 5 * len(masses)
    for r in rows:
        x = masses[r.q]
        inside = [i for i, y in enumerate(masses) if x - x * (20 / 1e6) <= y <= x + x * (20 / 1e6)]
        if len(inside) > 1:
            assert r.decoy_row in inside and r.decoy_row != r.q
    assert collected(out, "q", "draw", "decoy_row") == collected(
        splits.window_decoys(q, bank.repartition(7), query_id="q", query_mass="qm", own_row="own", mass="m", row="row", ppm=20.0, draws=5, seed="t"), "q", "draw", "decoy_row")
