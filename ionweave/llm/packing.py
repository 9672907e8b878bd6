"""Harmonic packing of tokenised documents into sequences of ``LENGTH`` ids.

A document's ids are cut into full sequences and, of what remains, pieces of falling powers of two down to ``LEAST``
and one shorter rest. A piece of length n belongs to the reciprocal-capacity class j = LENGTH // n, and every sequence
of a class takes exactly j pieces: no worker needs to know what another holds. Powers of two fill their sequences
without padding; a class of rests wastes under 1 / (j + 1) of sequences that hold few of all ids. Pieces are numbered
inside each task and shifted by the counts of the tasks before it, so only one row a task and class crosses tasks. The
last, unfilled sequence of each class (a number of pieces bounded by LENGTH) is packed by first fit.

Defined results: a null text is empty and gives the closing id alone; rows are documents even if they repeat a doc_id;
an empty table gives no piece. Other columns are ignored.
"""

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import stored

LENGTH, LEAST, CLOSING = 1024, 64, 0
CACHE = 400_000
_LOOSE_SPACE = re.compile(r" (?:\s|$)")
_UNIT = re.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes; units that start at a blank before a mark or letter are kept.

    The vocabulary file's ids follow its merges, so they serve as merge ranks; the test compares with the file's own
    tokenizer. As there, the file's added tokens are found in a text before anything else and have ids of their own.
    """

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        letters, self.added = byte_letters(), {x["content"]: array("I", [x["id"]]).tobytes() for x in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.at_added = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        self.known: dict[str, bytes] = {}

    @staticmethod
    def units(text: str) -> list[str]:
        """The text cut before each blank that a non-blank follows; no pre-token crosses such a place."""
        first, *rest = text.split(" ") if not _LOOSE_SPACE.search(text) else _UNIT.split(text)
        return [first, *[f" {x}" for x in rest]]

    def learn(self, unit: str) -> bytes:
        ids = array("I", self.encode(unit)).tobytes()
        if len(unit) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def plain(self, text: str) -> bytes:
        get, learn = self.known.get, self.learn
        return b"".join([get(u) or learn(u) for u in self.units(text)])

    def ids(self, text: str) -> bytes:
        if self.at_added is None or not any(x in text for x in self.added):
            return self.plain(text)
        return b"".join([self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.at_added.split(text))])


@lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(vocabulary)


def cuts(total: int) -> list[int]:
    """The lengths of a document's pieces."""
    out, rest = [LENGTH] * (total // LENGTH), total % LENGTH
    size = LENGTH // 2
    while size >= LEAST:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, class, place): ``place`` counts a task's pieces of a class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, filled = encoder_of(vocabulary), TaskContext.get().partitionId(), np.zeros(LENGTH + 1, dtype=np.int64)
        for batch in batches:
            for part in T.slices(batch, most=1 << 20):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), map(encoder.ids, [x or "" for x in part.column("text").to_pylist()])):
                    ids += CLOSING.to_bytes(4, "little")
                    start = 0
                    for size in cuts(len(ids) // 4):
                        kind = LENGTH // size
                        rows.append((doc, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), len(ids) // 4, task, kind, int(filled[kind])))
                        filled[kind] += 1
                        start += size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], NAMES)

    schema = ", ".join(f"{x} long" for x in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "class", "place"]


def first_fit(lengths: list[int], room: int = LENGTH) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, the longest first into the first sequence with room."""
    used, out = [], [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = next((k for k, u in enumerate(used) if u + lengths[i] <= room), len(used))
        if at == len(used):
            used.append(0)
        out[i] = (at, used[at])
        used[at] += lengths[i]
    return out


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json")))
    counts = cut.groupBy("task", "class").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("task", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    totals = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())  # a row a class
    first, base = {}, 0
    for kind, n in totals:
        first[kind] = base
        base += n // kind
    table = spark.createDataFrame([(kind, first[kind], n // kind * kind) for kind, n in totals], "class long, _first long, _full long")
    ranked = cut.join(shift, ["task", "class"]).join(F.broadcast(table), "class").withColumn("_rank", F.col("_shift") + F.col("place"))
    bins = ranked.filter("_rank < _full").withColumn("sequence_id", (F.col("_first") + F.floor(F.col("_rank") / F.col("class"))).cast("long"))
    even = bins.filter(F.col("class") < LENGTH // LEAST).withColumn("offset", F.col("length") * F.pmod("_rank", "class"))
    within = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)  # at most LENGTH rows
    uneven = bins.filter(F.col("class") >= LENGTH // LEAST).withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    tails = ranked.filter("_rank >= _full").select("class", "_rank", "length").orderBy("class", "_rank").collect()  # under the sum of the classes
    places = first_fit([r["length"] for r in tails])
    late = spark.createDataFrame([(r["class"], r["_rank"], base + s, o) for r, (s, o) in zip(tails, places)], "class long, _rank long, sequence_id long, offset long")
    ends = ranked.filter("_rank >= _full").join(F.broadcast(late), ["class", "_rank"])
    names = [*NAMES[:5], "sequence_id", "offset"]
    return even.select(names).unionByName(uneven.select(names)).unionByName(ends.select(names))
