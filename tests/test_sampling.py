"""Keyed permutations, samples from windows, chains of masses and merged components against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from ionweave.operators import components, sampling, splits


def test_permuted_is_a_permutation():
    for size in (1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4096):
        for key in (0, 5, 2**28 - 1):
            got = sampling.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(got.tolist()) == list(range(size))
    big = np.int64(3 * 10**11)
    got = sampling.permuted(np.arange(60_000), np.full(60_000, big), np.full(60_000, 77))
    assert len(set(got.tolist())) == 60_000 and 0.45 * big < got.mean() < 0.55 * big and got.max() < big


def test_sampled_window(spark):
    rng = random.Random(3)
    bank = [(k, rng.choice([-250.0, -1.0, 0.0, 3.0, rng.uniform(-300, 300)])) for k in range(500)] + [(900, None), (901, float("nan")), (902, float("inf"))]
    queries = [(k, rng.uniform(-320, 320)) for k in range(40)] + [(50, None), (51, float("nan")), (52, 9999.0)]
    b, q = spark.createDataFrame(bank, "row long, m double").repartition(5), spark.createDataFrame(queries, "q long, qm double").repartition(3)
    masses = {k: m for k, m in bank if m is not None and math.isfinite(m)}
    for size, limit in ((7, 10**6), (60_000, 10**6), (7, 20)):
        got = {}
        for r in sampling.sampled_window(q, b, query_mass="qm", bank_mass="m", query_id="q", bank_id="row", half_width=40.0, size=size, tag="t", limit=limit).collect():
            got.setdefault(r.q, []).append((r.draw, r.row))
        for k, m in queries:
            inside = {i for i, x in masses.items() if m is not None and m - 40 <= x <= m + 40}
            rows = sorted(got.get(k, []))
            assert [d for d, _ in rows] == list(range(1, min(size, len(inside)) + 1))
            assert len({i for _, i in rows}) == len(rows) and {i for _, i in rows} <= inside


@pytest.mark.parametrize("limit", [15, 10**6])
def test_decoys_name_unusable_masses(spark, limit):
    bank = spark.createDataFrame([(k, m) for k, m in enumerate([5.0, 5.0, 5.0001, None, -2.0, 0.0, float("nan"), float("inf")])], "row long, m double")
    q = bank.selectExpr("row as q", "m as qm", "row as own")
    got = splits.window_decoys(q, bank, query_id="q", query_mass="qm", own_row="own", mass="m", row="row", ppm=100.0, draws=3, seed="t", limit=limit).collect()
    assert sorted(r.q for r in got if r.status == "BAD_MASS") == [3, 4, 5, 6, 7] and all(r.decoy_row is None for r in got if r.status == "BAD_MASS")
    drawn = [r for r in got if r.status == "OK"]
    assert len(drawn) == 9 and all(r.decoy_row in (0, 1, 2) and r.decoy_row != r.q for r in drawn)


@pytest.mark.parametrize("block_rows", [4, 30, 10**6])
def test_decoys_are_drawn_where_the_window_is(spark, block_rows):
    rng = random.Random(5)
    masses = [round(rng.uniform(100, 100.2), 3) for _ in range(80)] + [110.0] * 60 + [150.0, 170.0]
    bank = spark.createDataFrame([(k, m, rng.randint(0, 9)) for k, m in enumerate(masses)], "row long, m double, s int").repartition(3)
    scores = {r.row: r.s for r in bank.collect()}
    q = bank.selectExpr("row as q", "m as qm", "s as qs", "row as own")
    how = dict(query_id="q", query_mass="qm", own_row="own", mass="m", row="row", ppm=100.0, draws=7, seed="t", block_rows=block_rows)
    order = sorted(range(len(masses)), key=lambda k: (masses[k], k))
    want = []
    for k, x in enumerate(masses):
        inside = [i for i, r in enumerate(order) if x - x * (100 / 1e6) <= masses[r] <= x + x * (100 / 1e6)]
        first, last = inside[0], inside[-1] + 1
        for draw in range(7):
            number = int(hashlib.sha256(f"t:{k}:{draw}".encode()).hexdigest(), 16)
            at = number % len(masses) if last - first <= 1 else first + number % (last - first)
            if last - first > 1 and order[at] == k:
                at = at + 1 if at + 1 < last else first
            want.append((k, draw, order[at]))
    got = splits.window_decoys(q, bank, **how)
    assert sorted((r.q, r.draw, r.decoy_row) for r in got.collect()) == want
    ranks = splits.decoy_ranks(q, bank, query_score="qs", score="s", **how).collect()
    assert sorted((r.q, r["rank"]) for r in ranks) == [(k, 1 + sum(scores[d] > scores[k] for a, _, d in want if a == k)) for k in range(len(masses))]


def lowest(nodes, links):
    low = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
        if not moved:
            return low


def test_mass_chain_has_the_components_of_all_pairs(spark):
    rng = random.Random(8)
    masses = [round(rng.uniform(100, 140), 2) for _ in range(300)] + [120.0] * 400 + [None, -1.0, 0.0, float("nan")]
    df = spark.createDataFrame(list(enumerate(masses)), "id long, m double").repartition(6)
    edges = [(r.a, r.b) for r in splits.mass_chain(df, "id", "m", 300.0).collect()]
    assert len(edges) < len(masses)
    pairs = [(i, j) for i, x in enumerate(masses) for j, y in enumerate(masses) if i < j and x and y and x > 0 and y > 0 and (x - x * 3e-4 <= y <= x + x * 3e-4 or y - y * 3e-4 <= x <= y + y * 3e-4)]
    assert lowest(range(len(masses)), edges) == lowest(range(len(masses)), pairs)


def test_merged_components(spark):
    first, more = [(1, 2), (3, 4), (5, 6), (7, 7), (8, 9)], [(2, 3), (6, 4), (9, 8), (7, 7)]
    classes = components.connected_components(spark.createDataFrame(first, "a long, b long"), "a", "b")
    got = {r.node: r.component for r in components.merged_components(classes, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == lowest(range(1, 10), first + more)


def test_panel_is_written_once(spark, tmp_path):
    bank = spark.createDataFrame([(k, 100.0 + k / 1e4) for k in range(30)], "row long, m double")
    spectra = spark.createDataFrame([(k % 10, k, 100.0 + k % 10 / 1e4) for k in range(40)], "st long, id long, sm double")
    call = lambda seed: splits.validation_panel(spectra, bank, structure="st", row="id", size=6, seed=seed, structure_mass="sm", mass="m", bank_row="row", ppm=50.0, draws=4, path=f"{tmp_path}/panel")
    once = sorted(map(tuple, call("a").collect()))
    assert len(once) == 24 and len({r[0] for r in once}) == 6 and sorted(map(tuple, call("b").collect())) == once
