"""Runs of equal keys come out whole, in pieces bounded by rows and bytes."""

import numpy as np
import pyarrow as pa

from ionweave.llm import store


def test_whole_runs(monkeypatch):
    rng = np.random.default_rng(1)
    keys = np.sort(np.concatenate([rng.integers(0, 300, 5000), np.full(4000, 150)]))
    table = pa.table({"k": keys, "text": ["x" * int(n) for n in rng.integers(0, 400, keys.size)]})
    for most, size in ((100, 1 << 30), (1 << 30, 20_000), (1, 1)):
        monkeypatch.setattr(store, "BYTES", size)
        seen, pieces = [], list(store.whole_runs(iter(table.to_batches(max_chunksize=700)), ["k"], most))
        for part, bounds in pieces:
            own = part.column("k").to_numpy()
            assert bounds[0] == 0 and bounds[-1] == part.num_rows
            assert all(len(set(own[a:b])) == 1 for a, b in zip(bounds, bounds[1:]))
            seen += [int(own[a]) for a in bounds[:-1]]
        assert seen == sorted(set(keys.tolist())) and pa.concat_tables([p for p, _ in pieces]).equals(table)
        if most == 100:
            assert max(p.num_rows for p, _ in pieces if 150 not in p.column("k").to_pylist()) <= 1100
    assert list(store.whole_runs(iter(table.slice(0, 0).to_batches()), ["k"], 5)) == []
