"""The sweep against listing every pair, with hot masses, cells of a few rows, nulls, infinities and shared groups."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ionweave.operators import ranking, skew, sweep
from ionweave.operators.fingerprints import block_balanced


def brute(queries, bank, ppm, grouped):
    out = {}
    for k, m, g in queries:
        if m is None or not math.isfinite(m) or m <= 0:
            out[k] = None
            continue
        half = m * (ppm / 1e6)
        out[k] = [(i, h) for i, x, h in bank if x is not None and math.isfinite(x) and x > 0 and m - half <= x <= m + half and (not grouped or (g is not None and h is not None and g != h))]
    return out


def sides(seed, n=400):
    rng = random.Random(seed)
    masses = [round(rng.uniform(100, 101), 3) for _ in range(n)] + [100.5] * (n // 2) + [7.0] * 30 + [None, float("nan"), float("inf"), 0.0, -3.0]
    rows = [(k, m, rng.choice(["a", "b", "c", "d", None]) if m != 7.0 else "a") for k, m in enumerate(masses)]
    return rows, rows + [(10_000, 7.0000001, "b")]


@pytest.mark.parametrize("cell_rows", [10, 60, 10**6])
@pytest.mark.parametrize("grouped", [False, True])
def test_window_counts(spark, cell_rows, grouped):
    queries, bank = sides(3)
    q = spark.createDataFrame(queries, "id long, m double, grp string").repartition(3)
    b = spark.createDataFrame(bank, "row long, mass double, grp string").repartition(4)
    got = sweep.window_counts(q, b, query_mass="m", bank_mass="mass", ppms=[50.0, 2000.0], group="grp" if grouped else None, cell_rows=cell_rows).collect()
    assert len(got) == len(queries)
    for ppm in (50.0, 2000.0):
        want = brute(queries, bank, ppm, grouped)
        for r in got:
            rows = want[r.id]
            assert r[f"rows_{ppm:g}"] == (None if rows is None else len(rows)), r
            if grouped:
                assert r[f"groups_{ppm:g}"] == (None if rows is None else len({h for _, h in rows})), r


@pytest.mark.parametrize("cell_rows", [10, 60, 10**6])
@pytest.mark.parametrize("cap", [5, 40, 10**6])
def test_selected_pairs(spark, cell_rows, cap):
    queries, bank = sides(4, 120)
    q = spark.createDataFrame(queries, "id long, m double, g string").repartition(3)
    b = spark.createDataFrame(bank, "row long, mass double, h string").repartition(4)
    for grouped in (False, True):
        names = {"query_group": "g", "bank_group": "h"} if grouped else {}
        got = sweep.selected_pairs(q, b, query_mass="m", bank_mass="mass", narrow=1.0, wide=300.0, cap=cap, cell_rows=cell_rows, **names).collect()
        near, far, want = brute(queries, bank, 1.0, grouped), brute(queries, bank, 300.0, grouped), set()
        for k, *_ in queries:
            rows, ppm = (near[k], 1.0) if near[k] else (far[k], 300.0)
            want |= {(k, i, ppm) for i, _ in rows or [] if len(rows) <= cap}
        assert len(got) == len(want) and {(r.id, r.row, r.selected_ppm) for r in got} == want


def test_distinct_by_blocks_equals_listing():
    rng = np.random.default_rng(2)
    for size in (1, 2, 37, 64, 300):
        cell = sweep.Bank(np.sort(rng.random(size)), np.ones(size, dtype=np.int64), pa.array([f"g{k}" for k in rng.integers(0, 9, size)]))
        first = rng.integers(0, size + 1, 4000)
        last = np.minimum(first + rng.integers(0, size + 1, 4000), size)
        names = np.array(cell.names.to_pylist())[cell.code]
        assert cell.distinct(first, last).tolist() == [len(set(names[a:b])) for a, b in zip(first, last)]
        if size > 100:
            assert cell.levels  # the windows were too wide to list


def test_plan_has_one_exchange(spark):
    queries, bank = sides(5)
    q, b = spark.createDataFrame(queries, "id long, m double, grp string"), spark.createDataFrame(bank, "row long, mass double, grp string")
    plan = sweep.window_counts(q, b, query_mass="m", bank_mass="mass", ppms=[50.0], group="grp")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, m double, grp string")
    some = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b")], "id long, m double, grp string")
    bank = some.selectExpr("id as row", "m as mass", "grp")
    assert sweep.window_counts(none, bank, query_mass="m", bank_mass="mass", ppms=[9.0]).count() == 0
    got = {r.id: (r.rows_9, r.groups_9) for r in sweep.window_counts(some, bank.limit(0), query_mass="m", bank_mass="mass", ppms=[9.0], group="grp").collect()}
    assert got == {1: (0, 0), 2: (None, None)}


@pytest.mark.parametrize("cell_rows, n_bits", [(10, 70), (40, 64), (10**6, 1000)])
def test_window_scores(spark, cell_rows, n_bits, monkeypatch):
    rng = np.random.default_rng(n_bits)
    words = -(-n_bits // 64)
    masses = [*np.round(rng.uniform(100, 100.2, 80), 3).tolist(), *[100.1] * 40, None, -1.0]
    bits = rng.integers(0, 2, (len(masses), n_bits))
    packed = np.packbits(np.pad(bits, ((0, 0), (0, 64 * words - n_bits))).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    bank = spark.createDataFrame([(k, m, w.tolist()) for k, (m, w) in enumerate(zip(masses, packed))], "c long, cm double, w array<bigint>").repartition(3)
    z = rng.normal(0, 1, (len(masses), n_bits))
    queries = spark.createDataFrame([(k, m, None if k == 5 else v.tolist()) for k, (m, v) in enumerate(zip(masses, z))], "q long, qm double, z array<double>").repartition(2)
    got = sweep.window_scores(queries, bank, query_mass="qm", bank_mass="cm", ppm=300.0, logits="z", words="w", n_bits=n_bits,
                              blocks={"all": (0, n_bits), "head": (0, 33)}, cell_rows=cell_rows).collect()
    want = {(k, i) for k, m in enumerate(masses) for i, x in enumerate(masses) if m and x and m > 0 and x > 0 and m - m * (300 / 1e6) <= x <= m + m * (300 / 1e6)}
    assert len(got) == len(want) and {(r.q, r.c) for r in got} == want
    for r in got:
        assert r.on_bits == bits[r.c].sum() and (r["all"] is None) == (r.q == 5)
        if r.q != 5:
            assert abs(r["all"] - z[r.q] @ bits[r.c]) < 1e-9 and abs(r["head"] - z[r.q][:33] @ bits[r.c][:33]) < 1e-9


@pytest.mark.parametrize("words, tile_rows", [(1, 10**6), (3, 7)])
def test_analog_features(spark, words, tile_rows):
    rng = np.random.default_rng(words)
    rows = [(q, c, float(q + c), rng.integers(0, 2**62, words).tolist()) for q in range(6) for c in range(40 if q == 3 else 5)]
    analogs = [(q, k + 1, float(w), rng.integers(0, 2**62, words).tolist()) for q in range(5) for k, w in enumerate(sorted(rng.random(4), reverse=True))]
    df = spark.createDataFrame(rows, "q int, c long, raw double, w array<bigint>").repartition(3)
    an = spark.createDataFrame(analogs, "q int, place int, weight double, words array<bigint>")
    hot = skew.find_hot(df, ["q"], 20) if tile_rows < 100 else skew.BOUNDED
    got = ranking.analog_features(df, an, "q", "w", 3.0, hot, tile_rows).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["q", "c", "raw", "cs", *ranking.ANALOG_COLUMNS]
    count = lambda ws: sum(bin(w).count("1") for w in ws)
    for r in got:
        mine = next(w for q, c, _, w in rows if (q, c) == (r.q, r.c))
        own = [(weight, both / (count(mine) + count(w) - both + 1e-9)) for q, _, weight, w in analogs if q == r.q for both in [count([a & b for a, b in zip(mine, w)])]]
        want = (max(t * w**3 for w, t in own), max(t * w for w, t in own), max(t for _, t in own), own[0][1], sum(t * w**3 for w, t in own) / (sum(w**3 for w, _ in own) + 1e-9), own[0][0]) if own else (0,) * 6
        assert r.cs == count(mine) and np.allclose([r[c] for c in ranking.ANALOG_COLUMNS], want)


@pytest.mark.parametrize("cell_rows", [40, 10_000])
def test_block_balanced_keeps_pairs_in_their_task(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(sweep, "TILE_BYTES", 8 * 64 * 16)
    rng = np.random.default_rng(11)
    masses = np.concatenate([rng.uniform(100, 101, 150), np.full(90, 200.0), [300.0]])  # a hot mass, a lone row
    words, z = rng.integers(0, 1 << 62, masses.size), rng.normal(size=(masses.size, 64))
    bank = spark.createDataFrame([(i, float(m), [int(w)]) for i, (m, w) in enumerate(zip(masses, words))], "c long, cm double, w array<bigint>")
    queries = spark.createDataFrame([(i, float(m), z[i].tolist() if i else None) for i, m in enumerate(masses)], "q long, qm double, z array<double>")
    got = block_balanced(queries, bank, "q", "da", "db", query_mass="qm", bank_mass="cm", ppm=900.0, logits="z", words="w", n_bits=64,
                         blocks={"da": (0, 32), "db": (32, 64)}, cell_rows=cell_rows)
    above = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above and "Join" not in above
    found = {(r["q"], r["c"]): r["balanced"] for r in got.collect()}
    on = (words[:, None] >> np.arange(64)) & 1
    want = {}
    for q, m in enumerate(masses):
        near = np.flatnonzero((masses >= m - m * 900e-6) & (masses <= m + m * 900e-6))
        s = [on[near][:, a:b] @ z[q, a:b] for a, b in ((0, 32), (32, 64))]
        a, b = (np.zeros(near.size) if x.size == 1 else (x - x.mean()) / x.std() for x in s)
        want |= {(q, int(c)): v for c, v in zip(near, a + 0.3 * b)}
    assert found.keys() == want.keys()
    assert all(found[k] is None if k[0] == 0 else abs(found[k] - want[k]) < 1e-9 for k in want)
