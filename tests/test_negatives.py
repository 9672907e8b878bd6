"""Negatives are judged where their query's window is; pairs are not shuffled."""

import pytest

import __spark_entry__ as entry_module
from conftest import SMALL

QUERIES = entry_module.queries()


@pytest.mark.parametrize("name", ["K7_hard_negative_select", "K8_staged_negative_pools", "K9_deterministic_negative_sample"])
def test_no_exchange_of_pairs(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    above, _ = plan.split("MapInArrow", 1)
    assert "Exchange" not in above and "Sort" not in above and "Window" not in above


def test_several_batches_give_the_same_rows(spark, monkeypatch):
    from ionweave.operators import sweep
    names = ["K7_hard_negative_select", "K8_staged_negative_pools", "K9_deterministic_negative_sample"]
    whole = [sorted(map(tuple, QUERIES[n](spark, SMALL.replace("0.001", "0.01")).collect()), key=repr) for n in names]
    monkeypatch.setattr(sweep, "LISTED", 3)
    assert all(whole) and whole == [sorted(map(tuple, QUERIES[n](spark, SMALL.replace("0.001", "0.01")).collect()), key=repr) for n in names]
