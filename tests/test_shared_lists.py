"""Lists that are dealt once: the same rows by the plan without a join, for several scores at once, with few exchanges."""

import random

import pytest
from pyspark.sql import functions as F

from ionweave.operators import evaluation, lists, skew
from ionweave.plans import workflows_q  # noqa: F401
from ionweave.plans.stand_ins import truth_lists

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    values = [(q, c, rng.randint(0, 4), rng.choice([0.1, 0.2, 0.3]), rng.choice([1.0, 2.0]), rng.choice([1.0, 5.0, 5.0]), int(c == 2), rng.random() < 0.3) for q in range(40) for c in range(rng.randint(3, 9))]
    return spark.createDataFrame(values, "q long, c long, ident int, s double, t double, b double, y int, p boolean").withColumn("fold", (F.col("q") % 3).cast("int")).repartition(5).cache()


def got(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())


def test_truth_and_shortlist_without_a_join(spark, rows):
    plain, shared = truth_lists(spark, SMALL), truth_lists(spark, SMALL, skew.BOUNDED)
    assert got(plain) == got(shared.select(plain.columns))
    how = ("q", ["c"], "s", "t", 2, 1)
    assert got(lists.shortlist_union(rows, *how)) == got(lists.shortlist_union(rows, *how, hot=skew.BOUNDED))


def test_ranks_of_two_scores_at_once(spark, rows):
    hot = skew.hot_keys(rows, ["q"], 6)
    for kind in (None, skew.BOUNDED, hot):
        both = evaluation.pool_aware_ranks(rows, "q", "ident", {"_s": "s", "_t": "t"}, "y", "p", 3, kind)
        for n in ("s", "t"):
            one = evaluation.pool_aware_rank(rows, "q", "ident", n, "y", "p", 3)
            assert got(one) == got(both.select("q", F.col(f"rank_{n}").alias("rank"), F.col(f"rr_{n}").alias("rr")))


def test_calibration_does_not_copy_rows(spark, rows):
    call = lambda hot: evaluation.alpha_calibration(rows, "q", "s", "b", "y", ["c"], "fold", 3, [0.0, 0.5, 2.0], hot=hot)
    assert got(call(skew.BOUNDED)) == got(call(skew.hot_keys(rows, ["q"], 6))) and len(got(call(None))) == 3
    want = {}
    per = {}
    for r in rows.groupBy("q", "fold").agg(F.collect_list(F.struct("s", "b", "y")).alias("x")).collect():
        b = [x.b for x in r.x]
        m = sum(b) / len(b)
        d = (sum((v - m) ** 2 for v in b) / len(b)) ** 0.5
        for alpha in (0.0, 0.5, 2.0):
            s = [round(x.s + alpha * ((x.b - m) / d if d > 1e-9 else 0.0), 9) for x in r.x]
            mine = max(v for v, x in zip(s, r.x) if x.y == 1)
            above, tied = sum(v > mine for v in s), s.count(mine)
            per.setdefault((r.fold, alpha), []).append(sum(1 / k for k in range(above + 1, above + tied + 1)) / tied)
    for held in range(3):
        train = {a: sum(sum(v) for (f, x), v in per.items() if f != held and x == a) / sum(len(v) for (f, x), v in per.items() if f != held and x == a) for a in (0.0, 0.5, 2.0)}
        best = min(train, key=lambda a: (-round(train[a], 12), a))
        want[held] = (best, train[best], sum(per[held, best]) / len(per[held, best]))
    for r in call(skew.BOUNDED).collect():
        assert (r.alpha, round(r.train_mrr, 9), round(r.holdout_mrr, 9)) == (want[r.held][0], round(want[r.held][1], 9), round(want[r.held][2], 9))
    # only rows of a fold are exploded: no row of a list is copied for each alpha
    assert "_qa" not in call(skew.BOUNDED)._jdf.queryExecution().optimizedPlan().toString()


def test_replay_deals_rows_once(spark):
    plan = workflows_q.replay(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
