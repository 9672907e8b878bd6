"""The batched assignment programme against one spectrum at a time and against all assignments."""

import itertools

import numpy as np

from ionweave.operators import similarity


def one(x, masses, w, tol, share):
    if not len(masses) or sum(w) <= 0:
        return 0.0, 0.0
    reach = np.abs(masses[:, None] - x[None, :]) <= np.maximum(tol, share * masses)[:, None]
    best = 0.0
    # every order-keeping assignment of peaks to ions, each used once
    for many in range(min(len(masses), len(x)) + 1):
        for peaks in itertools.combinations(range(len(masses)), many):
            for ions in itertools.combinations(range(len(x)), many):
                if all(reach[p, i] for p, i in zip(peaks, ions)):
                    best = max(best, sum(w[p] for p in peaks))
    return best / sum(w), w[reach.any(axis=1)].sum() / sum(w)


def test_batches_equal_all_assignments(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(np.sort(rng.uniform(100, 110, rng.integers(0, 6))), np.sort(rng.uniform(100, 110, n)), rng.uniform(0, 1, n) * (rng.random() < 0.9)) for n in rng.integers(0, 6, 120)]
    want = [one(*r, 1.0, 1e-2) for r in rows]
    for cells in (1, 40, 1 << 20):
        monkeypatch.setattr(similarity, "CELLS", cells)
        column = lambda k: np.array([r[k] for r in rows] + [None], dtype=object)[:-1]
        assert np.allclose(similarity.assigned(column(0), column(1), column(2), 1.0, 1e-2), want, atol=1e-12)
    assert similarity.assigned(np.array([], object), np.array([], object), np.array([], object), 1.0, 0.0).shape == (0, 2)
