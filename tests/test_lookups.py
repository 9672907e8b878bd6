"""Stored banks, absent combinations in chunks, and digests of far positions."""

import hashlib

import pytest

from ionweave.operators import digests, joins, rangejoin


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    rows = spark.createDataFrame([(k, 100.0 + (k % 900) / 100) for k in range(3000)] + [(9001, None), (9002, -1.0), (9003, float("nan"))], "row long, m double")
    return rangejoin.store_bank(rows, "m", 300.0, str(tmp_path_factory.mktemp("bank")), buckets=4)


def test_lookup_equals_brute_force(spark, bank):
    masses = [100.0, 104.561, 108.99, 300.0, None, 0.0, float("nan")]
    q = spark.createDataFrame(list(enumerate(masses)), "q long, qm double")
    got = {(r.q, r.row) for r in rangejoin.lookup(q, bank, "qm", 300.0).collect()}
    assert got == {(i, k) for i, m in enumerate(masses) if m and m == m for k in range(3000) if m - m * 3e-4 <= 100.0 + (k % 900) / 100 <= m + m * 3e-4}
    assert rangejoin.lookup(q.limit(0), bank, "qm", 300.0).count() == 0


def test_the_bank_is_not_shuffled(spark, bank):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        q = spark.range(50).selectExpr("id as q", "100.0D + id / 100 as qm")
        plan = rangejoin.lookup(q, bank, "qm", 300.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "GreaterThanOrEqual(m,99.97)" in plan


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_missing_combinations(spark, chunk):
    have = [(g, v) for g in range(7) for v in range(20) if (g * v) % 3 == 0] * 2
    got = joins.missing_combinations(spark.createDataFrame(have, "g int, v int"), "g", "v", chunk).collect()
    assert sorted(map(tuple, got)) == sorted({(g, v) for g in range(7) for v in range(20)} - set(have))


def test_sequence_digest_of_far_positions(spark):
    rows = [(0, "a"), (1, "bé"), (5, "c"), (2**40, "d")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for p, t in rows:
        level.setdefault(p >> 21, []).append(f"{len(t.encode())}:{sha(t)}")
    level = {b: sha("".join(parts)) for b, parts in level.items()}
    for _ in range(2):
        up = {}
        for b in sorted(level):
            up.setdefault(b >> 21, []).append("64:" + level[b])
        level = {b: sha("".join(parts)) for b, parts in up.items()}
    df = spark.createDataFrame([("g", *r) for r in rows], "g string, p long, t string")
    assert digests.sequence_digest(df, ["g"], "p", "t", fan_out=1 << 21).first().sequence_digest == level[0]
    with pytest.raises(ValueError):
        digests.sequence_digest(df, ["g"], "p", "t", fan_out=10)
