"""How far the sources of each language stand from one another, by hash-consed segment trees over term ids.

Terms are runs of letters (A-Z folded) and of all characters beyond ASCII. A language keeps the terms that at least
``MIN_DOCS`` of its documents have. The terms of a language are dealt into blocks by their hash; inside a block they are
numbered by falling frequency, and every group (language, source) has a segment tree of its counts over these numbers.
Trees are built bottom-up by their content: equal count subtrees, at whatever place and in whichever group, are one node.
Two trees are priced by walking both from the root at once: a frontier of (pair of groups, node, node) with a
multiplicity, in which equal node pairs are merged at every level, so each is opened, and at the leaves priced, once.
A pair of groups sums its blocks. Blocks are independent tasks of about ``BLOCK`` terms; where a language has more than
``TILE`` groups, a block is read once for each pair of tiles of groups, so no task holds all groups of a language. Terms
that neither tile has are 0 for both groups; they are counted, and priced once for each pair at the end.

With ``c`` occurrences of a term among the ``N`` of a group, and ``V`` kept terms, its price is
``p = 1 + floor(SCALE * (c + 1) / (N + V))``, and ``f = floor((p - q) ** 2 / q)``. All of it is integer arithmetic, also
beyond 64 bits where counts need it.

Defined results: null text, language or source is ''; repeated rows are documents of their own; a group without terms is
a group with counts 0; a language without kept terms has 0 between all its sources; a lone source has no pairs; equal
values are ranked by the item's UTF-8 bytes; an empty table gives no rows. Other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import map_runs, stored

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
BLOCK, TILE = 1 << 11, 24
SLICE = 4 << 20
#: A side of at most so many rows (about 100 bytes each) may be broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 100_000
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[65:91] = np.arange(65, 91)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The folded bytes of each span as strings."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = _LOWER[data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]]
    return pa.StringArray.from_buffers(size.size, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def _slice_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, term, docs, sources, counts): each term of each language in some texts, with its counts by source."""
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    part, code = part.take(pa.array(order)), code[order]  # groups in order, so that order by term is order by group too
    data, offsets = T.text_bytes(part.column("text"))
    starts, ends = T.word_spans(_LETTERS[data], offsets)
    words = T.span_hashes(data, starts, ends, fold=True)
    by_word = np.argsort(words, kind="stable")
    word = words[by_word]
    doc = np.repeat(np.arange(part.num_rows), np.diff(T.word_ranges(starts, offsets)))[by_word]
    group = code[doc]
    spoken = group // max(len(source.dictionary), 1)

    def changes(*keys: np.ndarray) -> np.ndarray:
        out = np.ones(word.size, dtype=bool)
        if word.size:
            out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return out

    rows, entries = np.flatnonzero(changes(word, spoken)), np.flatnonzero(changes(word, group))
    docs = np.add.reduceat(changes(word, doc).astype(np.int64), rows) if rows.size else rows
    lists = pa.array(np.append(np.searchsorted(entries, rows), entries.size), pa.int32())
    names = source.dictionary.take(pa.array(group[entries] % max(len(source.dictionary), 1)))
    first = by_word[rows]
    return pa.RecordBatch.from_arrays([
        lang.dictionary.take(pa.array(spoken[rows])), _strings(data, starts[first], ends[first]), pa.array(docs, pa.int64()),
        pa.ListArray.from_arrays(lists, names), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(entries, word.size)), pa.int64()))],
        ["lang", "term", "docs", "sources", "counts"])


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, lead): counts of the kept terms; one row of each term of a language leads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, most=SLICE):
                yield from pa.Table.from_batches([_slice_counts(part)]).to_batches(max_chunksize=1 << 16)

    found = docs.mapInArrow(run, "lang string, term string, docs long, sources array<string>, counts array<long>")
    # one shuffle: counts by source and document counts both follow from rows that share a language and a term
    each = found.repartition("lang", "term").select("lang", "term", "docs", F.posexplode(F.arrays_zip("sources", "counts")))
    counts = each.groupBy("lang", "term", F.col("col.sources").alias("source")).agg(
        F.sum("col.counts").alias("n"), F.sum(F.when(F.col("pos") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    term = Window.partitionBy("lang", "term")
    lead = F.row_number().over(term.orderBy("source")) == 1
    return counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("_docs"), lead.alias("lead")).filter(
        F.col("_docs") >= min_docs).drop("_docs")


def _price(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    return 1 + SCALE * (count + 1) // whole


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Trees:
    """The hash-consed segment trees of the rows of a matrix of counts; ids of level 0 are counts, -1 pads."""

    def __init__(self, counts: np.ndarray):
        height = max(int(counts.shape[1] - 1).bit_length(), 0)
        leaves = np.full((counts.shape[0], 1 << height), -1, dtype=np.int64)
        leaves[:, :counts.shape[1]] = counts
        self.values, ids = np.unique(leaves, return_inverse=True)
        ids = ids.reshape(leaves.shape)
        self.nodes: list[tuple[np.ndarray, np.ndarray]] = []  # children of every node, level by level
        self.sizes = [self.values.size]
        for _ in range(height):
            below = self.sizes[-1]
            pairs, ids_up = np.unique(ids[:, 0::2] * below + ids[:, 1::2], return_inverse=True)
            self.nodes.append((pairs // below, pairs % below))
            self.sizes.append(pairs.size)
            ids = ids_up.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]

    def meet(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, count, count, multiplicity) at the leaves, for each pair of rows ``first[i]``, ``second[i]``."""
        pair, x, y, times = np.arange(first.size), self.roots[first], self.roots[second], np.ones(first.size, dtype=np.int64)
        for (left, right), size in zip(reversed(self.nodes), reversed(self.sizes[:-1])):
            key = np.concatenate([(pair * size + left[x]) * size + left[y], (pair * size + right[x]) * size + right[y]])
            key, place = np.unique(key, return_inverse=True)
            times = np.bincount(place, weights=np.concatenate([times, times]), minlength=key.size).astype(np.int64)
            pair, x, y = key // (size * size), key // size % size, key % size
        real = self.values[x] >= 0
        return pair[real], self.values[x[real]], self.values[y[real]], times[real]


def _block(table: pa.Table, top: int, tile: int) -> list[tuple[np.ndarray, ...]]:
    """Partial sums of the pairs, and the best terms, of one block for two tiles: (gid, other, row of term, value, terms seen)."""
    gid, n = table.column("gid").to_numpy(), table.column("n").to_numpy()
    head = table.column("head").to_numpy(zero_copy_only=False)
    whole = table.column("whole").to_numpy()
    groups, at = np.unique(gid[head], return_index=True)
    wholes = whole[head][at]
    rows = np.flatnonzero(~head)
    row, own = np.searchsorted(groups, gid[rows]), n[rows]
    words = table.column("term").take(pa.array(rows)).combine_chunks().dictionary_encode()
    word = words.indices.to_numpy().astype(np.int64)
    total = np.zeros(len(words.dictionary), dtype=np.int64)
    total[word] = table.column("total").to_numpy()[rows]
    number = np.empty(total.size, dtype=np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(total.size)
    counts = np.zeros((groups.size, total.size), dtype=np.int64)
    counts[row, number[word]] = own
    # counts times SCALE leave 64 bits only for enormous tables; Python's integers take over there
    kind = object if max(int(total.max(initial=0)) + 1, 1) > (1 << 62) // SCALE else np.int64
    first_tile, last_tile = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
    side = groups // tile
    a, b = np.nonzero((side[:, None] == first_tile) & (side[None, :] == last_tile) & (groups[:, None] < groups[None, :]))
    pair, x, y, times = Trees(counts).meet(a, b)
    p, q = _price(x.astype(kind), wholes[a[pair]]), _price(y.astype(kind), wholes[b[pair]])
    out = []
    for one, other, value in ((a, b, times * _far(p, q)), (b, a, times * _far(q, p))):
        sums = np.zeros(a.size, dtype=kind)
        np.add.at(sums, pair, value)
        out.append((groups[one], groups[other], np.full(a.size, -1), sums.astype(np.int64), np.full(a.size, total.size)))
    if first_tile == last_tile:
        p = _price(own.astype(kind), whole[rows])
        q = _price(total[word].astype(kind), table.column("lang_whole").to_numpy()[rows])
        up = np.flatnonzero(p > q)
        value = _far(p[up], q[up]).astype(np.int64)
        place = np.empty(total.size, dtype=np.int64)
        place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(total.size)
        order = np.lexsort((place[word[up]], -value, row[up]))
        mine = row[up][order]
        best = order[np.arange(order.size) - np.searchsorted(mine, mine) < top]
        out.append((gid[rows[up[best]]], np.full(best.size, -1), rows[up[best]], value[best], np.zeros(best.size, dtype=np.int64)))
    return out


def _attach(frame: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """A join that sends ``side`` to every task only if it is small."""
    return frame.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, keys)


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources of the language, and the ``top`` terms a source has more of."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = stored(kept_counts(docs, min_docs))
    # groups of a language by number, and what their prices divide by
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("lead").cast("long")).alias("terms"))
    named = docs.select("lang", "source").distinct().withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    codes = named.select("lang").distinct().withColumn("lid", F.row_number().over(Window.orderBy("lang")))
    groups = stored(named.join(codes, "lang").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "lang_n", "terms"]).select(
        "lang", "source", "lid", "gid", "terms", (F.col("n") + F.col("terms")).alias("whole"), (F.col("lang_n") + F.col("terms")).alias("lang_whole")))
    blocks = F.ceil(F.col("terms") / block)
    own = F.floor(F.col("gid") / tile)
    shape = groups.groupBy("lid").agg(F.max(own).alias("last_tile"))
    sized = _attach(groups, shape, ["lid"])
    hit = _attach(kept, sized, ["lang", "source"]).select(
        "lid", F.pmod(F.xxhash64("term"), blocks).alias("block"), "gid", "term", "n", "total", "whole", "lang_whole", F.lit(False).alias("head"), "last_tile")
    heads = sized.filter("terms > 0").select(
        "lid", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "gid", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("total"), "whole", "lang_whole", F.lit(True).alias("head"), "last_tile")
    # every pair of tiles that a row's own tile is in
    facing = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last_tile")), lambda t: F.struct(F.least(t, own).alias("ti"), F.greatest(t, own).alias("tj")))
    dealt = hit.union(heads).withColumn("_at", F.explode(facing)).select("lid", "block", "_at.ti", "_at.tj", "gid", "term", "n", "total", "whole", "lang_whole", "head")

    def run(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        lid, out, rows = [], [], []
        ids = table.column("lid").to_numpy()
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for gid, other, row, value, seen in _block(table.slice(first, last - first), top, tile):
                lid.append(np.full(gid.size, ids[first]))
                out.append((gid, other, value, seen))
                rows.append(np.where(row >= 0, row + first, -1))
        gid, other, value, seen = (np.concatenate(x) for x in zip(*out))
        rows = np.concatenate(rows)
        term = table.column("term").take(pa.array(np.where(rows >= 0, rows, 0), mask=rows < 0))
        return pa.table({"lid": pa.array(np.concatenate(lid), pa.int64()), "gid": pa.array(gid, pa.int64()), "other": pa.array(other, pa.int64()), "term": term, "value": pa.array(value, pa.int64()), "seen": pa.array(seen, pa.int64())})

    longs = [F.col(c).cast("long").alias(c) for c in ("lid", "block", "ti", "tj", "gid", "n", "total", "whole", "lang_whole")]
    priced = stored(map_runs(dealt.select(*longs, "term", "head"), ["lid", "block", "ti", "tj"], "lid long, gid long, other long, term string, value long, seen long", run))
    best = Window.partitionBy("lid", "gid").orderBy(F.desc("value"), "term")
    terms = priced.filter("other < 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = groups.select("lang", "source", F.col("lid").cast("long").alias("lid"), F.col("gid").cast("long").alias("gid"), "whole", "terms")
    term_rows = _attach(terms, names, ["lid", "gid"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    sums = priced.filter("other >= 0").groupBy("lid", "gid", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    facing = names.join(names.select("lid", F.col("gid").alias("other"), F.col("source").alias("item"), F.col("whole").alias("item_whole")), "lid").filter("gid <> other")
    none = [F.expr(f"1 + {SCALE} div greatest({c}, 1)") for c in ("whole", "item_whole")]  # the price of a term without occurrences
    pairs = facing.join(sums, ["lid", "gid", "other"], "left").withColumns({"p": none[0], "q": none[1]}).withColumn(
        "value", F.expr("coalesce(value + (terms - seen) * ((p - q) * (p - q) div q), 0L)"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lid", "gid").orderBy(F.desc("value"), "item")))
    return term_rows.union(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
