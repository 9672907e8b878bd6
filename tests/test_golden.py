"""Golden values and refusals of the single operators."""

import math

import pytest
from pyspark.sql import functions as F

from ionweave.functions import bits, peaks, scalars
from ionweave.operators import components, evaluation, lists, rangejoin, ranking, similarity, skew
from ionweave.sources import readers


def one(spark, *columns, **named):
    return spark.range(1).select(*columns, *[c.alias(n) for n, c in named.items()]).first()


def test_window_endpoints_are_closed(spark):
    masses = [99.0, 99.99899999999998, 99.999, 99.999, 100.0, 100.0, 100.0, 100.001, 100.001, 100.00100000000002, 101.0]
    bank = spark.createDataFrame(list(enumerate(masses)), "b long, bm double")
    q = spark.createDataFrame([(0, 100.0)], "q long, qm double")
    got = rangejoin.mass_window_join(q, bank, query_mass="qm", bank_mass="bm", query_id="q", bank_id="b", ppm=10.0)
    assert sorted(r.b for r in got.collect()) == [2, 3, 4, 5, 6, 7, 8]


def test_window_union_ignores_bad_estimates(spark):
    r = 400 * 10 / 1e6
    bank = spark.createDataFrame([(0, 399.0), (1, 400 - r), (2, 400.0), (3, 400 + r), (4, 401.0)], "b long, m double")
    est = spark.createDataFrame([(7, x) for x in (400.0, float("nan"), float("inf"), -float("inf"), 0.0, -1.0)], "q long, e double")
    base = spark.createDataFrame([(7, 0)], "q long, b long")
    out = rangejoin.window_union(est, base, bank, query_id="q", estimate="e", bank_mass="m", bank_id="b", ppm=10.0)
    assert sorted(x.b for x in out.collect()) == [0, 1, 2, 3]
    exact = rangejoin.window_union(est, base, bank, query_id="q", estimate="e", bank_mass="m", bank_id="b", ppm=0.0)
    assert sorted(x.b for x in exact.collect()) == [0, 2]


def test_ion_conversion(spark):
    from ionweave.functions.constants import channel_dimension
    mz = {r.channel: r for r in channel_dimension(spark).collect()}
    dimer, double = mz["[2M+H]+"], mz["[M+2H]2+"]
    assert (dimer.n_mol * 100.0 + dimer.shift_da) / dimer.abs_charge == pytest.approx(201.0072764665789, abs=1e-12)
    assert (double.n_mol * 300.0 + double.shift_da) / double.abs_charge == pytest.approx(151.0072764665789, abs=1e-12)


def test_midrank(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.9), (1, 0.4), (2, 5.0)], "q long, s double")
    got = sorted((r.q, r.m) for r in ranking.with_midrank(df, ["q"], "s", "m").collect())
    assert got == [(1, 0.25), (1, 0.25), (1, 1.0), (2, 0.0)]


def test_expected_metrics_at_the_cut(spark):
    rows = [(1, i, 2.0, 0) for i in range(24)] + [(1, 24, 1.0, 1), (1, 25, 1.0, 0)]
    df = spark.createDataFrame(rows, "q long, c long, s double, y int")
    r = evaluation.expected_metrics(evaluation.truth_standing(df, "q", "s", "y", ["c"]), "q").first()
    assert r.expected_rr == pytest.approx(0.02) and r.expected_topk == pytest.approx(0.5) and r.expected_top1 == 0


def test_missing_truth_scores_zero(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 1), (2, 1, 2.0, 0)], "q long, c long, s double, y int")
    roster = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    got = {r.q: r.rr for r in evaluation.mrr_at_k(roster, evaluation.truth_standing(df, "q", "s", "y", ["c"]), "q").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_lookup_keeps_zero_apart_from_absent(spark):
    from ionweave.operators.joins import exact_key_lookup
    values = spark.createDataFrame([("b", 0), ("d", 4)], "k string, v long")
    queries = spark.createDataFrame([(i, k) for i, k in enumerate("abcbde")], "i long, k string")
    got = [(r.k, r.v, r.matched) for r in exact_key_lookup(queries, values, "k").orderBy("i").collect()]
    assert got == [("a", None, False), ("b", 0, True), ("c", None, False), ("b", 0, True), ("d", 4, True), ("e", None, False)]


@pytest.mark.parametrize("text", ["20", "20.5", "1e-5", "1000000", "0.0001", "123456.7", "999999.5", "-3.25", "0", "1e300", "100000", "0.00012345678"])
def test_shortest_number_prints_like_percent_g(spark, text):
    assert one(spark, scalars.shortest_number(F.lit(text)))[0] == f"{float(text):g}"


def test_energy_signature(spark):
    assert one(spark, scalars.energy_signature(F.lit(" 20.0, None,nan, 35.50 ,x1")))[0] == "20,35.5,x1"
    assert one(spark, scalars.energy_signature(F.lit(None).cast("string")))[0] == ""


def test_energy_bucket_rounds_half_even(spark):
    got = [one(spark, scalars.energy_bucket(F.lit(x)))[0] for x in (22.5, 12.5, 1.0, 27.5)]
    assert got == [20.0, 10.0, 5.0, 30.0]


def test_hash_modulus_uses_all_bits(spark):
    import hashlib
    for n in (1, 7, 1000003, 2147483647):
        got = one(spark, scalars.hash_modulus(F.lit("seed:12:1:3"), F.lit(n)))[0]
        assert got == int.from_bytes(hashlib.sha256(b"seed:12:1:3").digest(), "big") % n


def test_group_id_matches_compact_json(spark):
    import hashlib
    import json
    comp = F.array(F.struct(F.lit("O").alias("symbol"), F.lit(2).alias("count")), F.struct(F.lit("C").alias("symbol"), F.lit(6).alias("count")))
    got = one(spark, scalars.identity_group_id(comp, F.lit("ABCDEFGHIJKLMN")))[0]
    assert got == hashlib.sha256(json.dumps([[["C", 6], ["O", 2]], "ABCDEFGHIJKLMN"], separators=(",", ":")).encode()).hexdigest()


def test_bits_words_and_padding(spark):
    flags = [1, 0, 1] * 30
    words = bits.pack_words(F.array(*[F.lit(b) for b in flags]), 90)
    r = one(spark, w=words, n=bits.popcount(words), ok=bits.padding_clean(words, 90), bad=bits.padding_clean(words, 66))
    assert r.n == 60 and r.ok and not r.bad and len(r.w) == 2
    both_empty = one(spark, k=bits.tanimoto(F.lit(0), F.lit(0), 0.0), a=bits.tanimoto(F.lit(0), F.lit(0)))
    assert both_empty.k == 0.0 and both_empty.a is None


def peak_array(pairs):
    return F.array(*[F.struct(F.lit(float(m)).alias("mz"), F.lit(float(i)).alias("intensity")) for m, i in pairs])


def test_clean_peaks(spark):
    got = one(spark, peaks.clean_floor_topk(peak_array([(300, 1), (100, 8), (200, float("nan")), (150, 0.001), (120, 1)]), 0.01, 2))[0]
    assert [(p.mz, p.intensity) for p in got] == [(100.0, 8 / 9), (300.0, 1 / 9)]
    assert one(spark, peaks.clean_floor_topk(peak_array([(1, 0)])))[0] == []


def test_merge_neighbours_judges_original_neighbours(spark):
    got = one(spark, peaks.merge_neighbours(peak_array([(100.0, 1), (100.004, 2), (100.008, 2), (101, 5)])))[0]
    assert [p.mz for p in got] == [100.008, 101.0]


def test_merge_predicted_uses_first_of_cluster(spark):
    data = peak_array([(100.0, 1), (100.0009, 3), (100.0018, 2)])
    top = one(spark, peaks.merge_predicted(data, how="max"))[0]
    summed = one(spark, peaks.merge_predicted(data, how="sum"))[0]
    assert [(p.mz, round(p.intensity, 6)) for p in top] == [(100.0, 0.6), (100.0018, 0.4)]
    assert [round(p.intensity, 6) for p in summed] == [round(4 / 6, 6), round(2 / 6, 6)]


def test_windowed_keeps_best_of_each_window_first(spark):
    data = peak_array([(10, 9), (11, 8), (12, 7), (60, 1), (500, 99)])
    got = one(spark, peaks.windowed(data, F.lit(100.0), max_peaks=3, per_window=2))[0]
    assert [p.mz for p in got] == [10.0, 11.0, 60.0]


def test_consensus_golden(spark):
    views = [("a", [100.0, 100.006], [9.0, 4.0]), ("b", [100.0], [9.0]), ("c", [110.0], [9.0])]
    df = spark.createDataFrame([(v, m, [math.sqrt(x) for x in w]) for v, m, w in views], "v string, m array<double>, w array<double>")
    df = df.select(F.lit(1).alias("q"), F.lit(1).alias("n_ions"), similarity.explained(F.array(F.lit(100.0)), F.col("m"), F.col("w"), 0.01, 0.0).alias("e"),
                   peaks.covered_fraction(F.array(F.lit(100.0)), F.lit(90.0), F.lit(120.0), 0.01, 0.0).alias("coverage"))
    r = similarity.consensus_features(df.select("q", "n_ions", "e.*", "coverage"), ["q"], "n_ions").first()
    assert r.assignment_max == pytest.approx(1.0) and r.assignment_median == pytest.approx(0.6) and r.assignment_q25 == pytest.approx(0.3)
    assert r.reuse_gap_max == pytest.approx(0.4) and r.view_count == 3


def test_assignment_against_brute_force(spark):
    import itertools
    import random
    rng = random.Random(3)
    cases = []
    for _ in range(60):
        ions = sorted({round(rng.uniform(0, 1), 2) for _ in range(rng.randint(1, 4))})
        mz = sorted(round(rng.uniform(0, 1), 2) for _ in range(rng.randint(1, 4)))
        cases.append((ions, mz, [rng.uniform(0.1, 3) for _ in mz]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x array<double>, m array<double>, w array<double>")
    got = {r.i: r.e.assignment for r in df.select("i", similarity.explained(F.col("x"), F.col("m"), F.col("w"), 0.1, 0.0).alias("e")).collect()}
    for i, (ions, mz, w) in enumerate(cases):
        best = 0.0
        slots = list(range(len(ions))) + [None] * len(mz)
        for choice in set(itertools.permutations(slots, len(mz))):
            if all(s is None or abs(ions[s] - m) <= 0.1 for s, m in zip(choice, mz)):
                best = max(best, sum(x for s, x in zip(choice, w) if s is not None))
        assert got[i] == pytest.approx(best / sum(w))


def test_components_on_chain_hub_and_cycle(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30))
    assert out[202] == 200 and out[300] == 300


def test_gate_that_varies_is_flagged(spark):
    df = spark.createDataFrame([(1, 0.2, 1.0, 3.0, 5.0), (1, 0.3, 1.0, 3.0, 5.0), (2, 0.9, 1.0, 3.0, 5.0), (3, 0.1, 1.0, 3.0, 5.0)], "q int, g double, b double, h1 double, h2 double")
    got = sorted((r.q, r.route, r.routed_score) for r in lists.gated_route(df, "q", "g", 0.5, "b", ("h1", "h2")).collect() if r.q > 1)
    assert got == [(2, "baseline", 1.0), (3, "head_mean", 4.0)]


def test_slot_merge_moves_tail_only(spark):
    base = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "q int, item int, r int")
    tier = spark.createDataFrame([(1, 50, 1), (1, 3, 2)], "q int, item int, r int")
    got = [r.item for r in lists.slot_merge(base, tier, "q", "item", "r", [2, 4], 6).orderBy("rank").collect()]
    assert got == [1, 50, 2, 3, 4, 5]


def test_sign_test_exact(spark):
    def exact(w, l):
        n, k = w + l, min(w, l)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / (1 << n)) if n else 1.0

    cases = [(0, 0), (1, 0), (3, 9), (10, 10), (400, 350), (5000, 4700)]
    df = spark.createDataFrame(cases, "wins long, losses long")
    for r in evaluation.sign_test(df, "wins", "losses").collect():
        assert r.sign_p == pytest.approx(exact(r.wins, r.losses), rel=1e-9)


def test_required_columns_refuse(spark):
    with pytest.raises(ValueError, match="absent"):
        readers.require_columns(spark.range(1), {"absent": "bigint"})
    with pytest.raises(ValueError, match="have bigint"):
        readers.require_columns(spark.range(1), {"id": "double"})


def test_blank_json_line_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    from pyspark.sql import types as T
    with pytest.raises(ValueError, match="blank"):
        readers.scan_jsonl(spark, str(tmp_path), T.StructType([T.StructField("a", T.LongType())]))


def test_calibration_fit_lowers_the_loss(spark):
    from ionweave.operators.aggregates import calibration_fit
    from ionweave.plans.aggregates_q import calibration_bins
    bins = calibration_bins(spark, "/root/testdata/sf0.001").cache()
    theta, history = calibration_fit(bins, 3, 64, 1500.0)
    assert len(history) >= 2 and all(b <= a for a, b in zip(history, history[1:])) and any(theta)


def test_frequency_bits_and_metamorphic_view_duplication(spark):
    df = spark.createDataFrame([([1, 0, 1],), ([1, 1, 0],), ([1, 0, 0],)], "b array<int>")
    from ionweave.operators.fingerprints import bit_frequencies
    got = sorted((r.bit, r.n_set) for r in bit_frequencies(df, "b").collect())
    assert got == [(0, 3), (1, 1), (2, 1)]
    assert skew.HOT_ROWS > 0


def test_harmonic_beyond_the_table(spark):
    from pyspark.sql import functions as F

    from ionweave.operators.evaluation import harmonic

    got = {r.n: r.h for r in spark.range(1, 400).select(F.col("id").alias("n"), harmonic(F.col("id")).alias("h")).collect()}
    assert all(abs(h - sum(1 / k for k in range(1, n + 1))) < 1e-12 for n, h in got.items())


def test_expected_rank_at_a_deep_cut(spark):
    from ionweave.operators.evaluation import expected_metrics

    row = expected_metrics(spark.createDataFrame([("q", 120, 2)], "q string, above long, tied long"), "q", 200).first()
    assert abs(row.expected_rr - (1 / 121 + 1 / 122) / 2) < 1e-12


def test_bootstrap_interval_against_resampling(spark):
    import numpy as np

    from ionweave.operators.evaluation import bootstrap_interval

    values = np.random.default_rng(4).exponential(1.0, 6000)
    got = bootstrap_interval(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "u long, v double"), "u", "v", replicates=1500).first()
    direct = np.quantile(np.random.default_rng(5).choice(values, (1500, values.size)).mean(axis=1), [0.05, 0.95])
    width = direct[1] - direct[0]
    assert abs(got.low - direct[0]) < 0.2 * width and abs(got.high - direct[1]) < 0.2 * width


def test_low_bound_under_zero_stays_small(spark):
    from ionweave.operators.rangejoin import window_pairs

    queries = spark.createDataFrame([(1, -1.0, 5.0), (2, 4.9, 5.1), (3, -2.0, -1.0), (4, 0.0, 1.0)], "q long, lo double, hi double")
    bank = spark.createDataFrame([(7, 2.0), (8, 5.0)], "b long, m double")
    got = {(r.q, r.b) for r in window_pairs(queries, bank, "m", query_id="q", bank_id="b", max_ppm=10.0).collect()}
    assert got == {(1, 7), (1, 8), (2, 8)}


def test_scoring_runs_add_up(spark, tmp_path):
    from ionweave.streaming.streams import incremental_scores

    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / f"in{k}"))
        done = incremental_scores(stream, "id", lambda df: df.selectExpr("id", "id * 2 as score"), str(tmp_path / "done"))
        assert sorted(r.id for r in done.collect()) == list(range(k * 10 + 10))
