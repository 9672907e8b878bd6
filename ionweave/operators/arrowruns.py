"""Two sides of a key in one sorted Arrow stream: one is held whole, the other passes by."""

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

Held = TypeVar("Held")


def against(batches: Iterator[pa.RecordBatch], keys: list[str], side: str, columns: list[str], prepare: Callable[[pa.Table], Held],
            answer: Callable[[Held, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """For each run of the integer ``keys``: ``columns`` of its rows with ``side`` 0, prepared once, then every part of its rows with ``side`` 1.

    The stream is sorted by keys and side. The first side must fit a task; the second is never gathered.
    """
    held: list[pa.RecordBatch] = []
    at, ready = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(c).to_numpy() for c in [*keys, side]]
        cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        for first, last in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            part, place = batch.slice(first, last - first), tuple(int(v[first]) for v in values[:-1])
            if place != at:
                held, at, ready = [], place, None
            if values[-1][first] == 0:
                held.append(part.select(columns))
                continue
            if ready is None:
                ready, held = prepare(pa.Table.from_batches(held, part.select(columns).schema).combine_chunks()), []
            yield from answer(ready, part)
