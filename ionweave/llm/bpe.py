"""Byte-level BPE by overlapping chunks.

Texts of up to ``CHUNK`` characters are pre-tokenised whole. Longer ones are cut into chunks that overlap by
``OVERLAP``; tasks pre-tokenise the chunks on their own. In an overlap both chunks have seen the text, and from the
first place where both have a pre-token boundary they agree, so there the later chunk takes over. A boundary counts
only if the pattern saw a character behind it. Where an overlap has no such place (one pre-token longer than it), the
earlier chunk's open end is read again together with the next chunk. The pieces between the places are then encoded
with the merge ranks, the lowest rank first and the leftmost among equals; decoding joins the bytes of the ids.

Defined results: a null text is empty; rows are encoded alone, so repeats get equal results and a missing doc_id stays
missing; an empty table gives no rows. Other columns are ignored.
"""

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import map_runs

CHUNK, OVERLAP = 1 << 16, 1 << 10
CACHE, SHORT = 150_000, 64
_ID = np.dtype("<u4")
_SPLIT = regex.compile(public_tokenizers.PATTERN)
_LOOSE_SPACE, _UNIT = re.compile(r" (?:\s|$)"), re.compile(r" (?=\S)")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges of one pre-token, the next one from a heap of (rank, place)."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] else len(parts)
        if j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, b"", after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(parts) and (p := parts[a] + parts[after[a]]) in ranks:
                heapq.heappush(heap, (ranks[p], a, p))
    return [ranks[p] for p in parts if p]


class Merges:
    """Merges many short pre-tokens at a time: in each round every one of them takes its lowest rank, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.never = ranks, len(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        parts = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(parts, dtype=np.int64).T
        key = left * (self.never + 1) + right
        order = np.argsort(key)
        self.key, self.rank = key[order], rank[order]

    def gain(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair together, ``never`` if it has none."""
        key = left * (self.never + 1) + right
        place = np.minimum(np.searchsorted(self.key, key), self.key.size - 1)
        return np.where(self.key[place] == key, self.rank[place], self.never)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens of at least one byte, as 32-bit numbers."""
        out = [b""] * len(pieces)
        piece, size = np.arange(len(pieces)), np.array([len(x) for x in pieces], dtype=np.int64)
        token = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        last = np.zeros(token.size, dtype=bool)
        last[np.cumsum(size) - 1] = True
        gain = np.where(last, self.never, self.gain(token, np.append(token[1:], 0)))
        while piece.size:
            n = token.size
            low = np.minimum.reduceat(gain * n + np.arange(n), np.cumsum(size) - size)
            done = low >= self.never * n
            if done.any():
                flat, own = token.astype(_ID).tobytes(), 4 * np.cumsum(size)
                for k, a, b in zip(piece[done].tolist(), (own - 4 * size)[done].tolist(), own[done].tolist()):
                    out[k] = flat[a:b]
                go = np.repeat(~done, size)
                token, gain, last, piece, size = token[go], gain[go], last[go], piece[~done], size[~done]
                low = low[~done]
                at = low % n - (np.cumsum(~go) - ~go)[low % n]
            else:
                at = low % n
            if not piece.size:
                break
            token[at] = gain[at]
            last[at] = last[at + 1]
            stay = np.ones(token.size, dtype=bool)
            stay[at + 1] = False
            token, gain, last = token[stay], gain[stay], last[stay]
            at = at - np.arange(at.size)
            size = size - 1
            ends = np.append(token[1:], 0)
            gain[at] = np.where(last[at], self.never, self.gain(token[at], ends[at]))
            begin = at[at > np.cumsum(size) - size]
            gain[begin - 1] = self.gain(token[begin - 1], token[begin])
        return out


class Recent:
    """What was met lately. Once ``CACHE`` keys are held, those of the time before that were not asked for again go."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]]):
        self.learn, self.new, self.old = learn, {}, {}

    def know(self, keys: Iterable[str]) -> dict[str, bytes]:
        """A table that has all of ``keys``."""
        wanted = set(keys)
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        new = self.new
        fresh = wanted.difference(new)
        new.update((k, self.old[k]) for k in fresh.intersection(self.old))
        rest = list(fresh.difference(self.old))
        new.update(zip(rest, self.learn(rest)))
        table, long = new, [k for k in rest if len(k) > SHORT]
        if long:
            table = dict(new)
            for k in long:
                del new[k]
        return table


class Coder:
    """Encodes units and pre-tokens, and decodes their ids, with a bounded memory of what it has met."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.names = {rank: str(rank) for rank in self.tokens}
        self.whole = {token: np.array([rank], dtype=_ID).tobytes() for token, rank in self.ranks.items()}
        self.merges = Merges(self.ranks)
        self.pieces, self.units = Recent(self._pieces), Recent(self._units)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pieces]
        out = list(map(self.whole.get, raw))
        fresh = [k for k, x in enumerate(out) if x is None]
        for k in fresh:
            if len(raw[k]) > SHORT:
                out[k] = np.array(merge(raw[k], self.ranks), dtype=_ID).tobytes()
        fresh = [k for k in fresh if out[k] is None]
        for k, x in zip(fresh, self.merges.ids([raw[k] for k in fresh]) if fresh else []):
            out[k] = x
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        parts = list(map(_SPLIT.findall, units))
        table = self.pieces.know(chain.from_iterable(parts))
        return [table[x[0]] if len(x) == 1 else b"".join([table[p] for p in x]) for x in parts]

    def code(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as 32-bit numbers."""
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and many small lists would set off collections
        try:
            return list(map(self.units.know(units).__getitem__, units))
        finally:
            if collects:
                gc.enable()


@lru_cache(maxsize=1)
def coder_of(path: str) -> Coder:
    """One for all tasks of a worker."""
    return Coder(path)


def units(text: str) -> list[str]:
    """The text cut before each blank that a non-blank follows, where pre-tokens always end; most units repeat."""
    first, *rest = text.split(" ") if not _LOOSE_SPACE.search(text) else _UNIT.split(text)
    return [first, *[f" {x}" for x in rest]] if first else [f" {x}" for x in rest]


def boundaries(text: str) -> list[int]:
    """Where pre-tokens end."""
    return [m.end() for m in _SPLIT.finditer(text)]


def stitched(chunks: Iterator[tuple[int, str, list[int]]]) -> Iterator[list[str]]:
    """Pre-tokens of a text from its chunks (start, text, pre-token ends within it), in order, a list for each chunk."""
    held = None  # (start, text, ends) still open: its first character begins a pre-token
    for start, text, ends in chunks:
        if held is not None:
            first, open_text, open_ends = held
            sure = {first + e for e in open_ends if e < len(open_text)} | {first}
            meet = next((start + e for e in [0, *ends] if start + e in sure and (e or start == first) and e < len(text)), None)
            if meet is None:  # no common boundary: read the open end together with this chunk
                last = max((e for e in open_ends if e < len(open_text)), default=0)
                yield _pieces(open_text, [e for e in open_ends if e <= last])
                text = open_text[last:] + text[first + len(open_text) - start:]
                start, ends = first + last, boundaries(text)
            else:
                yield _pieces(open_text, [e for e in open_ends if first + e <= meet])
                text, ends = text[meet - start:], [e - (meet - start) for e in ends if start + e > meet]
                start = meet
        held = start, text, ends
    if held is not None:
        yield _pieces(held[1], held[2])


def _pieces(text: str, ends: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *ends], ends)]


class Digest:
    """Running digests of ids and of the bytes they decode to."""

    def __init__(self, coder: Coder) -> None:
        self.coder, self.n, self.ids, self.raw = coder, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, coded: Iterable[bytes]) -> None:
        if ids := np.frombuffer(b"".join(coded), dtype=_ID).tolist():
            self.ids.update((("," if self.n else "") + ",".join(map(self.coder.names.__getitem__, ids))).encode())
            self.raw.update(b"".join(map(self.coder.tokens.__getitem__, ids)))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.raw.hexdigest()


FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            for part in T.slices(batch, most=1 << 20):
                rows, each = [], [units(x) for x in part.column("text").to_pylist()]
                coded = iter(coder.code(list(chain.from_iterable(each))))
                for own in each:
                    digest = Digest(coder)
                    digest.add(islice(coded, len(own)))
                    rows.append(digest.row())
                n, ids, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "text")]):
                for start in range(0, max(len(text) - overlap, 1), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([start]), pa.array([text[start:start + chunk + overlap]])], ["row", "doc_id", "start", "text"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [boundaries(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*batch.schema.names, "ends"])

    def join(table: pa.Table, bounds) -> pa.Table:
        coder, rows = coder_of(path), []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            digest = Digest(coder)
            part = table.slice(first, last - first)
            for pieces in stitched(zip(*[part.column(c).to_pylist() for c in ("start", "text", "ends")])):
                digest.add(coder.code(pieces))
            rows.append((part.column("doc_id")[0].as_py(), *digest.row()))
        doc, n, ids, raw = zip(*rows)
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": raw})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = texts.filter(F.length("text") <= chunk).mapInArrow(whole, f"doc_id long, {FIELDS}")
    numbered = texts.withColumn("row", F.monotonically_increasing_id()).filter(F.length("text") > chunk)
    chunks = numbered.mapInArrow(cut, "row long, doc_id long, start long, text string").repartition("row", "start")
    long = map_runs(chunks.mapInArrow(split, "row long, doc_id long, start long, text string, ends array<int>"), ["row"], f"doc_id long, {FIELDS}", join, most=32, order=["start"])
    return short.unionByName(long)
