"""Repeated passages from sparse suffix arrays.

Of every text only suffixes that start at minimiser positions are kept: the first least of ``WINDOW`` consecutive hashes
of ``GRAM`` words. Every stretch of ``LEAST`` words has exactly one, at a place chosen by those words alone, so a
stretch that two texts share belongs to a suffix with the same first words in both, whatever stands around it.

Suffixes whose first words another text has are gathered by them, with the words of their stretches before and after. A
group is sorted by the words that follow, and each suffix compared with its neighbour: the common length is the sparse
array's LCP, and suffixes between two smaller ones share at least that much to the right. The same is done with the words
before, nearest first, for what is shared to the left. Two suffixes share a stretch that begins ``a`` words before their
start where they are in one interval of depth ``LEAST - a`` to the right and in one of depth ``a`` to the left; for each
``a`` such classes are found among all suffixes of the group, not only neighbours', with the smallest and largest
document of each. The stretches of a suffix all hold its first words, so what is shared of them is one range; ranges of
a document are merged, and long passages come out whole. Words are compared by 48 bits of their hashes, all ``LEAST`` of
a stretch.

First words that more than ``GROUP`` suffixes have would be too much for one task to sort: their stretches are counted
one by one, in a grouped minimum and maximum joined back. Both ways give the same rows.

Texts that are equal as a whole are handled as one; each copy is a repeat as a whole. Defined results: texts under
``LEAST`` words, nulls and rows without doc_id have no passages; repeated rows of a doc_id have their document's.
Repeats inside one text alone are not reported.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import map_runs, stored

LEAST, GRAM = 50, 8
WINDOW = LEAST - GRAM + 1
GROUP = 16_000
CODE = 6  # bytes of a word's hash that are carried


def minimisers(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): the first least position of each window of ``grams``, and the first window that each is that of.

    Windows follow each other, so those of a place are the ones up to the first of the next place.
    """
    if grams.size < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low, at, have = grams, np.arange(grams.size), 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        left = low[:-step] <= low[step:]
        low, at, have = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), have + step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first


def _tokens(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = T.text_bytes(part.column("text"))
    starts, ends = T.word_spans(data, offsets)
    hashes, bounds = T.span_hashes(data, starts, ends), T.word_ranges(starts, offsets)
    for i in range(part.num_rows):
        yield hashes[bounds[i]:bounds[i + 1]]


def _marks(docs: DataFrame) -> DataFrame:
    """(gram, doc_id, place, key): the retained suffixes; ``key`` tells different texts apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                out = []
                for doc, key, words in zip(part.column("doc_id").to_pylist(), part.column("key").to_pylist(), _tokens(part)):
                    grams = T.gram_hashes(words, GRAM)
                    at, _ = minimisers(grams)
                    out.append((grams[at].view(np.int64), np.full(at.size, doc), at, np.full(at.size, key)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["gram", "doc_id", "place", "key"])

    return docs.mapInArrow(run, "gram long, doc_id long, place long, key long")


def _contexts(docs: DataFrame) -> DataFrame:
    """(gram, n, doc_id, start, lead, words): each suffix with the words of its stretches, ``lead`` of them before it; the first stretch is at ``start``.

    Suffixes of hot first words are not sorted: instead of words they carry the 64-bit hashes of their stretches.
    """
    most = GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, most=1 << 20):
                for doc, hits, words in zip(part.column("doc_id").to_pylist(), part.column("hits"), _tokens(part)):
                    at, first = minimisers(T.gram_hashes(words, GRAM))
                    ends = np.append(first[1:], max(words.size - LEAST + 1, 0)) + LEAST - 1  # where the last stretch of each ends
                    codes = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].copy()
                    stretches = T.gram_hashes(words, LEAST)
                    place, gram, n = (hits.values.field(c).to_numpy() for c in ("place", "gram", "n"))
                    k = np.searchsorted(at, place)
                    fits = at[np.minimum(k, at.size - 1)] == place if at.size else np.zeros(place.size, dtype=bool)
                    k, gram, n = k[fits], gram[fits], n[fits]
                    for i in range(0, k.size, 1 << 12):
                        j = k[i:i + (1 << 12)]
                        hot = n[i:i + j.size] > most
                        own = [(stretches[a:b - LEAST + 1] if h else codes[a:b]).tobytes() for a, b, h in zip(first[j].tolist(), ends[j].tolist(), hot.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(gram[i:i + j.size]), pa.array(n[i:i + j.size]), pa.array(np.full(j.size, doc)), pa.array(first[j]), pa.array(at[j] - first[j]), pa.array(own, pa.binary())],
                                                         ["gram", "n", "doc_id", "start", "lead", "words"])

    return docs.mapInArrow(run, "gram long, n long, doc_id long, start long, lead long, words binary")


def _flat_words(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): the words of all suffixes, one row of bytes each, and how many each suffix has."""
    own = table.column("words").to_pylist()
    return np.frombuffer(b"".join(own), dtype=np.uint8).reshape(-1, CODE), np.array([len(x) // CODE for x in own], dtype=np.int64)


def _intervals(gram: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted by gram and words, and how many words each has in common with the one before it, -1 across grams."""
    rows = np.concatenate([gram.astype(">i8").view(np.uint8).reshape(-1, 8), words.reshape(len(words), -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")
    there, before = words[order[1:]], words[order[:-1]]
    same = np.logical_and.accumulate((there == before).all(axis=2), axis=1).sum(axis=1)
    return order, np.concatenate([[-1], np.where(gram[order[1:]] == gram[order[:-1]], same, -1)])


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The number of the interval of suffixes that share ``depth`` words, for each suffix."""
    out = np.empty(order.size, dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _same(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """The range of each suffix that other documents have, and the range that an earlier one has."""
    gram, doc, start, lead = (table.column(c).to_numpy() for c in ("gram", "doc_id", "start", "lead"))
    codes, size = _flat_words(table)
    base = np.cumsum(size) - size
    step = np.arange(WINDOW - 1)
    right, left = lead[:, None] + GRAM + step, lead[:, None] - 1 - step
    take = lambda at: np.where(((at >= 0) & (at < size[:, None]))[:, :, None], codes[np.clip(base[:, None] + at, 0, max(len(codes) - 1, 0))], 0)
    after, before = _intervals(gram, take(right)), _intervals(gram, take(left))
    none = np.iinfo(np.int64).max
    found = {only: [np.full(doc.size, none), np.full(doc.size, -1), np.full(doc.size, none)] for only in (False, True)}
    for ahead in range(WINDOW):  # of the suffix its stretch begins
        own = np.flatnonzero((ahead <= lead) & (lead - ahead + LEAST <= size))
        if not own.size:
            continue
        key = _classes(*after, LEAST - GRAM - ahead)[own] * (doc.size + 1) + _classes(*before, ahead)[own]
        order = np.argsort(key, kind="stable")
        head = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        at, where = np.flatnonzero(head), np.empty(own.size, dtype=np.int64)
        where[order] = np.cumsum(head) - 1
        mine = doc[own]
        low, high = np.minimum.reduceat(mine[order], at)[where], np.maximum.reduceat(mine[order], at)[where]
        other, here = np.where(mine == low, high, low), start[own] + lead[own] - ahead
        for only, hit in ((False, low < high), (True, low < mine)):
            first, last, least = found[only]
            rows = own[hit]
            first[rows], last[rows], least[rows] = np.minimum(first[rows], here[hit]), np.maximum(last[rows], here[hit]), np.minimum(least[rows], other[hit])
    out = []
    for only, (first, last, least) in found.items():
        rows = np.flatnonzero(last >= 0)
        out.append(pa.table({"doc_id": doc[rows], "start": first[rows], "end": last[rows] + LEAST, "other_id": least[rows], "cut": np.full(rows.size, only)}))
    return pa.concat_tables(out)


def _stretches(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of every stretch of the suffixes of hot first words."""
    own = part.column("words").to_pylist()
    many = np.array([len(x) // 8 for x in own], dtype=np.int64)
    row = np.repeat(np.arange(many.size), many)
    step = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many)
    return np.frombuffer(b"".join(own), dtype=np.int64), row, part.column("start").to_numpy()[row] + step


def _spread(suffixes: DataFrame) -> DataFrame:
    """What ``_same`` gives, for first words of any number of suffixes: no task holds what is equal."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(i, 1 << 12)
                window, row, start = _stretches(part)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (window, part.column("doc_id").to_numpy()[row], part.column("start").to_numpy()[row], start)], ["window", "doc_id", "suffix", "start"])

    each = suffixes.select("doc_id", "start", "words").mapInArrow(run, "window long, doc_id long, suffix long, start long")
    shared = stored(each.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high"))
    found = each.join(shared.hint("merge"), "window").withColumn("other", F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")))
    later = F.col("low") < F.col("doc_id")
    ranges = lambda test: F.struct(F.min(F.when(test, F.col("start"))).alias("start"), (F.max(F.when(test, F.col("start"))) + LEAST).alias("end"),
                                   F.min(F.when(test, F.col("other"))).alias("other_id"))
    found = found.groupBy("doc_id", "suffix").agg(ranges(F.lit(True)).alias("_all"), ranges(later).alias("_cut"))
    return found.select("doc_id", "_all.*", F.lit(False).alias("cut")).unionByName(found.select("doc_id", "_cut.*", F.lit(True).alias("cut")).filter("start is not null"))


def _merge(table: pa.Table, bounds: np.ndarray) -> pa.Table:
    """Overlapping ranges of a document as one passage, those with ``cut`` apart."""
    doc, start, end, other, cut = (table.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "start", "end", "other_id", "cut"))
    out = []
    for only in (False, True):
        rows = np.flatnonzero(cut == only)
        rows = rows[np.lexsort((end[rows], start[rows], doc[rows]))]
        if not rows.size:
            continue
        where = np.searchsorted(np.unique(doc[rows]), doc[rows])
        span = int(end.max()) + 1
        reach = np.maximum.accumulate(end[rows] + where * span)  # never reaches into the next document
        new = np.concatenate([[True], (start[rows][1:] + where[1:] * span) > reach[:-1]])
        at = np.flatnonzero(new)
        out.append(pa.table({"doc_id": doc[rows][at], "start": start[rows][at], "end": np.maximum.reduceat(end[rows], at),
                             "other_id": np.minimum.reduceat(other[rows], at), "cut": np.full(at.size, only)}))
    return pa.concat_tables(out)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, other_id, cut): word ranges that another document also has.

    Rows with ``cut`` false are the maximal passages. Rows with ``cut`` true cover what an earlier document has.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    key = F.xxhash64("text", F.crc32("text"), F.octet_length("text"))
    keyed = docs.withColumn("key", key)
    marks = stored(_marks(keyed.select("doc_id", "key", "text")))
    wide = marks.groupBy("gram").agg(F.min("key").alias("_a"), F.max("key").alias("_b"), F.count(F.lit(1)).alias("n")).filter("_a <> _b").select("gram", "n")
    copies = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
                    .filter("_first <> _last"))
    again = keyed.select("doc_id", "key").join(copies, "key").select("doc_id", "_first", "_last").distinct()
    hits = marks.join(wide.hint("merge"), "gram").join(again.filter("doc_id <> _first").select("doc_id").hint("merge"), "doc_id", "left_anti")
    listed = hits.groupBy("doc_id").agg(F.collect_set(F.struct("place", "gram", "n")).alias("hits"))  # as many as the text has minimisers
    # written out, so that the shuffled texts can go before the suffixes are shuffled
    suffixes = stored(_contexts(docs.join(listed.hint("merge"), "doc_id").select("doc_id", "hits", "text")))

    ranges = "doc_id long, start long, end long, other_id long, cut boolean"
    found = map_runs(suffixes.filter(F.col("n") <= GROUP).select("gram", "doc_id", "start", "lead", "words"), ["gram"], ranges, _same, most=1 << 13)
    if not suffixes.filter(F.col("n") > GROUP).isEmpty():
        found = found.unionByName(_spread(suffixes.filter(F.col("n") > GROUP)))
    found = found.groupBy("doc_id", "start", "end", "cut").agg(F.min("other_id").alias("other_id"))  # so a run is bounded by its text
    parts = map_runs(found, ["doc_id"], ranges, _merge)

    words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    whole = docs.join(again.hint("merge"), "doc_id").select("doc_id", F.lit(0).cast("long").alias("start"), words.cast("long").alias("end"), F.when(F.col("doc_id") == F.col("_first"), F.col("_last")).otherwise(F.col("_first")).alias("other_id"))
    whole = whole.filter(F.col("end") >= LEAST).distinct()
    ended = whole.select("*", F.lit(False).alias("cut")).unionByName(whole.filter("other_id < doc_id").select("*", F.lit(True).alias("cut")))
    return parts.join(whole.select("doc_id"), "doc_id", "left_anti").unionByName(ended).unionByName(
        parts.join(whole.filter("other_id > doc_id").select("doc_id"), "doc_id", "left_semi").filter("cut"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, other_id, start_word, end_word, n_words): the passages of ``LEAST`` words or more that documents share."""
    return passages(docs).filter("not cut").select("doc_id", "other_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document has; rows left without a word by that go. Columns stay; n_chars, if there, follows the text."""
    names = docs.columns
    cuts = passages(docs).filter("cut").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__llm_cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            for i, (text, cut) in enumerate(zip(texts, batch.column("__llm_cuts").to_pylist())):
                keep.append(True)
                if text is None or not cut:
                    continue
                data, offsets = T.text_bytes(pa.array([text]))
                starts, ends = T.word_spans(data, offsets)
                out, at = [], 0
                for span in cut:
                    if span["start"] >= starts.size:
                        continue
                    out.append(data[at:max(at, starts[span["start"]])].tobytes())
                    at = max(at, int(ends[min(span["end"], starts.size) - 1]))
                texts[i] = (b"".join(out) + data[at:].tobytes()).decode()
                keep[-1] = bool(texts[i].strip(" \t\n\v\f\r"))
            new = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
            if "n_chars" in new.schema.names:
                kind = new.schema.field("n_chars")
                sizes = [n if not c else len(x) for n, c, x in zip(new.column("n_chars").to_pylist(), new.column("__llm_cuts").to_pylist(), texts)]
                new = new.set_column(new.schema.get_field_index("n_chars"), kind, pa.array(sizes, kind.type))
            yield new.filter(pa.array(keep, pa.bool_())).select(names)

    return docs.join(cuts.hint("merge"), "doc_id", "left").select(*docs.columns, "__llm_cuts").mapInArrow(run, docs.schema)
