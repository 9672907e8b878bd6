"""Spectra are matched where their masses meet; no pair is shuffled with its peaks."""

import numpy as np
import pytest

import __spark_entry__ as entry_module
from conftest import SMALL

QUERIES = entry_module.queries()


@pytest.mark.parametrize("name", ["M1_greedy_cosine", "M2_modified_cosine", "M3_library_best_by_key"])
def test_peaks_are_not_joined_to_pairs(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    above, _ = plan.split("MapInArrow", 1)
    assert "Join" not in above and "ArrowEvalPython" not in above
    assert "Exchange" not in above or name == "M3_library_best_by_key"  # its few best rows


def test_small_batches_give_the_same_rows(spark, monkeypatch):
    from ionweave.operators import similarity, sweep
    folder = SMALL.replace("0.001", "0.01")
    rows = lambda: [sorted(map(tuple, QUERIES[n](spark, folder).collect())) for n in ("M2_modified_cosine", "M3_library_best_by_key")]
    whole = rows()
    monkeypatch.setattr(similarity, "PAIRS", 7)
    monkeypatch.setattr(sweep, "LISTED", 20)
    assert all(whole) and rows() == whole


def test_pairs_are_matched_by_places_in_both_sides():
    """Spectra are not copied to their pairs; the matching is that of two pointers, also with empty spectra."""
    from ionweave.operators import similarity
    rng = np.random.default_rng(3)
    sizes = [[0, 5, 12, 1, 7], [9, 0, 3, 12]]
    mz, it = ([np.zeros((len(n), 12)) for n in sizes] for _ in range(2))
    for m, v, n in zip(mz, it, sizes):
        for k, size in enumerate(n):
            m[k, :size], v[k, :size] = np.sort(rng.uniform(100, 130, size)), rng.uniform(0.1, 1, size)
    of, at = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(4)))
    shift = rng.uniform(-3, 3, of.size)
    for s in (None, shift):
        got = similarity._walk(similarity._ended(mz[0], np.array(sizes[0])), it[0], of, similarity._ended(mz[1], np.array(sizes[1])), it[1], at, 1.0, s)
        for k, (a, b) in enumerate(zip(of, at)):
            i = j = 0
            want = 0.0
            while i < sizes[0][a] and j < sizes[1][b]:
                gap = mz[0][a, i] - (0 if s is None else s[k]) - mz[1][b, j]
                want += it[0][a, i] * it[1][b, j] if abs(gap) <= 1.0 else 0
                i, j = i + (gap <= 1.0), j + (gap >= -1.0)
            assert got[k] == want
    assert got.any()
