"""Features of whole windows follow where the windows are: no exchange of pairs, the same rows from cells of any size."""

import numpy as np
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL
from ionweave.functions import bits
from ionweave.operators import ranking, sweep

QUERIES = entry_module.queries()


@pytest.mark.parametrize("name", ["W5_rank_features_31", "W6_tie_neutral_transform"])
def test_no_exchange_of_pairs(spark, name):
    above, _ = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above and "Join" not in above


def test_cells_of_any_size_and_a_hot_mass(spark):
    # 70 of 130 rows share a mass, some have no scores
    rows = [(i, 100.0 if i < 70 else 100.0 + i / 500, [((i * 37 + k * 11) % 23 - 11) / 8.0 for k in range(64)] if i != 4 else None, i % 5 / 4.0, i % 7 / 6.0 if i % 9 else None, i % 11 / 10.0 - 0.2)
            for i in range(130)]
    df = spark.createDataFrame(rows, "i long, m double, z array<double>, lv double, fr double, sim double")
    queries = df.selectExpr("i as q", "m as qm", "z", "i % 7 <> 0 as model", "i % 5 <> 0 as fragments")
    bank = df.select(df.i.alias("c"), df.m.alias("cm"), bits.pack_words(spark_bits(df), 64).alias("w"), "lv", "fr", "sim")
    got = {}
    for size in (20, 10**6):
        out = ranking.window_features(queries, bank, query="q", cand="c", query_mass="qm", bank_mass="cm", ppm=500.0, logits="z", words="w", n_bits=64, lib="lv", frag="fr", sim="sim",
                                      model="model", fragments="fragments", digits=4, neutral=True, cell_rows=size)
        got[size] = sorted(map(tuple, out.collect()), key=lambda r: r[:2])
    assert got[20] == got[10**6]
    assert len(got[20]) == sum(a[1] - a[1] * 500e-6 <= b[1] <= a[1] + a[1] * 500e-6 for a in rows for b in rows)
    model = {r[0] for r in got[20] if any(r[2 + ranking.FEATURES.index("fp_model_is_max")] == 1 for r in [r])}
    assert 7 not in model and 4 not in model and 8 in model


def spark_bits(df):
    from pyspark.sql import functions as F
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ((df.i * 13 + k * 7) % 5 < 2).cast("int"))


def test_windows_of_pairs_are_dealt_to_many_tasks(spark):
    """Work is a cell's rows times a window, so cells of pairs are small."""
    masses = spark.range(20_000).selectExpr("id as q", "500 + id / 100 as qm", "array_repeat(1.0D, 64) as z")
    bank = masses.selectExpr("q as c", "qm as cm", "array(1L) as w")
    out = sweep.window_scores(masses, bank, query_mass="qm", bank_mass="cm", ppm=2000.0, logits="z", words="w", n_bits=64, blocks={"s": (0, 64)})
    assert out.rdd.getNumPartitions() >= 16


def test_copies_of_a_row_do_not_grow_with_the_rows(spark):
    """A window of many cells makes the cells larger, so that what is copied is about the same for each row at any size."""
    sizes = {}
    for n in (20_000, 80_000):
        masses = spark.range(n).selectExpr("500 + pmod(xxhash64(id), 1000003) / 1000003 * 100 as _m")
        cuts = sweep._cut_points(masses, masses, sweep.PAIR_ROWS, 20_000.0)
        middle = cuts[len(cuts) // 2]
        sizes[n] = sum(middle - middle * 0.02 <= c <= middle + middle * 0.02 for c in cuts)
    assert all(4 <= k <= sweep.COPIES + 1 for k in sizes.values())


@pytest.mark.parametrize("name", ["B8_logit_dot", "B8_wide_logit_dot", "B11_logit_blend", "B10_block_balanced_score"])
def test_pairs_leave_their_task_with_what_is_returned(spark, name):
    """Scores are finished and rounded where the pair is made."""
    df = QUERIES[name](spark, SMALL)
    above, below = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)
    assert "round" not in above and "array<double>" not in below.split("Exchange", 1)[0]
    made = below.split("[", 1)[1].split("]", 1)[0]
    assert len(made.split(",")) == len(df.columns)


@pytest.mark.parametrize("words", [1, 3])
def test_long_windows_against_analogs(monkeypatch, words):
    """Analogs one at a time say what they say in blocks."""
    rng = np.random.default_rng(5)
    mine = rng.integers(0, 2**62, (300, words)).astype(np.uint64)
    mine[7] = 0
    weight, on = np.sort(rng.random(9))[::-1], np.bitwise_count(mine).sum(axis=1, dtype=np.int64)
    short = ranking._against_analogs(mine, on, mine[:9], weight, 3.0)
    monkeypatch.setattr(ranking, "LONG_ROWS", 1)
    monkeypatch.setattr(ranking, "CACHED_ROWS", 64)
    long = ranking._against_analogs(mine, on, mine[:9], weight, 3.0)
    assert np.allclose(short, long, rtol=1e-14, atol=1e-14) and (short[[0, 1, 2, 3, 5]] == long[[0, 1, 2, 3, 5]]).all()
