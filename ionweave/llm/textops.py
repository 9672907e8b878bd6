"""Array kernels over the UTF-8 bytes of an Arrow text column, shared by the operators that run inside tasks.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
Hashes are 64-bit polynomials of a word's bytes, mixed; they do not depend on batch or partition borders.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20  # bytes hashed at a time, so memory does not follow the longest text
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(values: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on all bits."""
    h = values.astype(U64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> U64(shift)
        h *= U64(factor)
    h ^= h >> U64(33)
    return h


_PLAIN = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most so many bytes of text (a longer text stands alone)."""
    _, offsets = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where words start and end; a text's border ends a word."""
    space = SPACE[data]
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < data.size)])
    begin[cuts] = ~space[cuts]
    stop[cuts - 1] = ~space[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A mixed 64-bit hash of each span (ordered, not overlapping); ``fold`` reads A-Z as a-z."""
    table, out = (_FOLDED if fold else _PLAIN), np.empty(starts.size, dtype=U64)
    i = 0
    while i < starts.size:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        size = int(ends[j - 1]) - base
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_BASE, size), _powers(_INVERSE, 1))
        sums = np.zeros(size + 1, dtype=U64)
        np.cumsum(table[data[base:base + size]] * up[:size], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def word_ranges(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the index of its first word, and the total at the end."""
    return np.searchsorted(starts, offsets)


_STEPS = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive words (empty when there are fewer)."""
    m = hashes.size - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(m, dtype=U64)
    for k in range(n):
        total += hashes[k:k + m] * _STEPS[k]
    return mix(total + U64(n))


def counts_between(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each ``[bounds[i], bounds[i + 1])``."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))


def head_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(spans, hashes): of all spans whole, then for each size of the first characters of the spans that have more."""
    if not starts.size:
        return [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64))] * (1 + len(sizes))
    lead = (data & 0xC0) != 0x80
    nth, leads = np.cumsum(lead) - 1, np.flatnonzero(lead)
    first = nth[starts]
    many = nth[ends - 1] - first + 1
    rows = [np.arange(starts.size), *[np.flatnonzero(many > k) for k in sizes]]
    stops = [ends, *[leads[first[r] + k] for r, k in zip(rows[1:], sizes)]]
    out = [np.empty(r.size, dtype=U64) for r in rows]
    i = 0
    while i < starts.size:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        size = int(ends[j - 1]) - base
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(_BASE, size), _powers(_INVERSE, 1))
        sums = np.zeros(size + 1, dtype=U64)
        np.cumsum(_FOLDED[data[base:base + size]] * up[:size], out=sums[1:])
        for r, stop, hashes in zip(rows, stops, out):
            a, b = np.searchsorted(r, (i, j))
            at = starts[r[a:b]] - base
            hashes[a:b] = (sums[stop[a:b] - base] - sums[at]) * down[at]
        i = j
    return [(r, mix(h + U64((k + 1) * 0xA0761D6478BD642F % (1 << 64)))) for r, h, k in zip(rows, out, (0, *sizes))]
