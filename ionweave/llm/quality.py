"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with references of every language by
Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1). The references are counted over all documents
with a language: shares of the character classes, and of the ``COMMON`` most frequent words plus one bin for the rest.
A document is held to the nearest reference, so a wrong or missing language does not condemn it. A text without any
common word is no farther than the share of common words allows (0.46 where that is 0.37), so want of them is judged
apart: each reference has a least share of its common words, ``SPREADS`` robust deviations (quartile distance / 1.349)
below the median share of its language's documents, and a text must reach that of one language. Guards: the distances
judge only documents of ``MIN_WORDS`` words; the word rules only those of ``MIN_WORDS_COMMON``; a language with fewer
than ``MIN_DOCS`` such documents has the spread of random draws, and one with no least share above 0 (few common words,
as in unspaced scripts) excuses texts whose character classes are near its own.

Base counts, and the base rule, need no reference. Defined results: a null text has no words and fails the base rule;
with no reference at all (no language, or an empty table) the base rule alone decides; equal rows get equal results;
rows without doc_id are judged like any other.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .store import stored

MIN_WORDS, MIN_WORDS_COMMON = 50, 80
COMMON = 100
CLASS_LIMIT, WORD_LIMIT = 0.30, 0.60
SPREADS, MIN_DOCS, STEPS = 5.0, 30, 1000
#: Character classes by a character's first byte; 0 stands for the other bytes of a character.
CLASSES = ("continued", "lower", "upper", "digit", "blank", "line end", "stop", "mark", "symbol", "control", "two bytes", "three bytes", "four bytes")
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[:32] = _CLASS[127] = CLASSES.index("control")
_CLASS[33:127] = CLASSES.index("mark")
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[[32, 9]] = CLASSES.index("blank")
_CLASS[[10, 13]] = CLASSES.index("line end")
_CLASS[[44, 46]] = CLASSES.index("stop")
_CLASS[list(b"#*$%&|<>=+@^_~\\{}[]`")] = CLASSES.index("symbol")
_CLASS[192:224], _CLASS[224:240], _CLASS[240:] = (CLASSES.index(x) for x in ("two bytes", "three bytes", "four bytes"))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = np.ones(256, dtype=bool)
_LEAD[128:192] = False


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of ``p`` to every row of ``q``."""
    def entropy(x: np.ndarray) -> np.ndarray:
        return -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=-1)

    middle = entropy((p[:, None, :] + q[None, :, :]) / 2)
    return np.sqrt(np.maximum(middle - (entropy(p)[:, None] + entropy(q)[None, :]) / 2, 0))


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of class counts for each text."""
    n = offsets.size - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.bincount(owner * len(CLASSES) + _CLASS[data], minlength=n * len(CLASSES))
    return out.reshape(n, len(CLASSES))[:, 1:]


def reference_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n): character classes (kind 0) and folded words (kind 1) of all documents with a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").to_pylist()
            kinds = sorted(set(names))
            code = np.array([kinds.index(x) for x in names], dtype=np.int64)
            classes, found = np.zeros((len(kinds), len(CLASSES) - 1), dtype=np.int64), []
            row = 0
            for part in T.slices(batch, most=1 << 20):
                data, offsets = T.text_bytes(part.column("text"))
                own = code[row:row + part.num_rows]
                np.add.at(classes, own, _class_counts(data, offsets))
                starts, ends = T.word_spans(data, offsets)
                words, where = T.span_hashes(data, starts, ends, fold=True), np.repeat(own, np.diff(T.word_ranges(starts, offsets)))
                found += [(k, *np.unique(words[where == k], return_counts=True)) for k in set(own.tolist())]
                row += part.num_rows
            for k, name in enumerate(kinds):
                words, times = (np.concatenate([x[i] for x in found if x[0] == k]) for i in (1, 2))
                word, place = np.unique(words, return_inverse=True)
                n = np.bincount(place, weights=times, minlength=word.size).astype(np.int64)
                key = np.concatenate([np.arange(classes.shape[1]), word.view(np.int64)])
                kind = np.repeat([0, 1], [classes.shape[1], word.size])
                yield from pa.Table.from_pydict({"lang": pa.array([name] * key.size), "kind": pa.array(kind, pa.int32()), "key": key, "n": np.concatenate([classes[k], n])}).to_batches(max_chunksize=1 << 16)

    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    return known.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict:
    """The model: class shares, the common words and their shares, a row for each language (a small driver-side table)."""
    every = Window.partitionBy("lang").orderBy(F.desc("kind"), F.desc("n"), "key")
    counts = stored(reference_counts(docs))  # read three times
    total = {r["lang"]: r["n"] for r in counts.filter("kind = 1").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rows = counts.filter("kind = 1").withColumn("_rank", F.row_number().over(every)).filter(F.col("_rank") <= COMMON).drop("_rank").collect()
    classes = counts.filter("kind = 0").collect()
    langs = sorted(total)
    words = np.array(sorted({r["key"] for r in rows}), dtype=np.int64)
    by_class, by_word = np.zeros((len(langs), len(CLASSES) - 1)), np.zeros((len(langs), words.size + 1))
    for r in classes:
        if r["lang"] in total:
            by_class[langs.index(r["lang"]), r["key"]] = r["n"]
    for r in rows:
        by_word[langs.index(r["lang"]), np.searchsorted(words, r["key"])] = r["n"]
    by_word[:, -1] = [total[x] for x in langs] - by_word.sum(axis=1)
    model = {"langs": langs, "classes": _shares(by_class), "words": words, "word_shares": _shares(by_word)}
    return model | {"least": least_shares(docs, model)}


def _common_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    """A row for each text: how often each common word stands there, and all other words."""
    folded, n = T.span_hashes(data, starts, ends, fold=True).view(np.int64), offsets.size - 1
    size = model["words"].size + 1
    place = np.minimum(np.searchsorted(model["words"], folded), size - 2)
    place = np.where(model["words"][place] == folded, place, size - 1)
    owner = np.repeat(np.arange(n), np.diff(T.word_ranges(starts, offsets)))
    return np.bincount(owner * size + place, minlength=n * size).reshape(n, size)


def _common_share(counts: np.ndarray, model: dict) -> np.ndarray:
    """The share of each language's common words in each text."""
    return _shares(counts)[:, :-1] @ (model["word_shares"][:, :-1] > 0).T


def least_shares(docs: DataFrame, model: dict) -> np.ndarray:
    """The least share of common words of each language, from its documents' shares counted in ``STEPS`` steps."""
    langs, part = model["langs"], 1 - model["word_shares"][:, -1]
    least = part - SPREADS * np.sqrt(part * (1 - part) / MIN_WORDS_COMMON)
    if not langs:
        return least
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), STEPS + 1), dtype=np.int64)
        for batch in batches:
            for part in T.slices(batch, most=2 << 20):
                data, offsets = T.text_bytes(part.column("text"))
                starts, ends = T.word_spans(data, offsets)
                counts = _common_counts(data, offsets, starts, ends, shared.value)
                own = np.array([langs.index(x) if x in langs else -1 for x in part.column("lang").to_pylist()], dtype=np.int64)
                rows = np.flatnonzero((counts.sum(axis=1) >= MIN_WORDS_COMMON) & (own >= 0))
                share = _common_share(counts[rows], shared.value)[np.arange(rows.size), own[rows]]
                np.add.at(total, (own[rows], np.rint(share * STEPS).astype(np.int64)), 1)
        lang, step = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.int32()), "step": pa.array(step, pa.int32()), "n": total[lang, step]})

    known = docs.select("lang", "text").filter("lang is not null and text is not null")
    table = np.zeros((len(langs), STEPS + 1))
    for r in known.mapInArrow(run, "lang int, step int, n long").groupBy("lang", "step").agg(F.sum("n").alias("n")).collect():
        table[r["lang"], r["step"]] = r["n"]
    for k in np.flatnonzero(table.sum(axis=1) >= MIN_DOCS):
        low, middle, high = np.searchsorted(np.cumsum(table[k]), np.array([0.25, 0.5, 0.75]) * table[k].sum()) / STEPS
        least[k] = middle - SPREADS * max(high - low, 1 / STEPS) / 1.349
    return least


def _repeated(words: np.ndarray) -> int:
    """Words inside three-word windows that the text has twice or more."""
    windows = T.gram_hashes(words, 3)
    if windows.size < 2:
        return 0
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    hit = np.zeros(windows.size + 2, dtype=bool)
    again = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def _repeated_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return again


def measure(part: pa.RecordBatch, model: dict) -> dict[str, np.ndarray]:
    """Base counts, distances and verdict of each text of a batch."""
    data, offsets = T.text_bytes(part.column("text"))
    n = offsets.size - 1
    starts, ends = T.word_spans(data, offsets)
    hashes, bounds = T.span_hashes(data, starts, ends), T.word_ranges(starts, offsets)
    lead = np.concatenate([[0], np.cumsum(_LEAD[data] & ~T.SPACE[data])])
    out = {
        "n_words": np.diff(bounds), "word_chars": np.diff(lead[offsets]), "n_symbols": T.counts_between(_SYMBOL[data], offsets),
        "n_dup_lines": np.array([_repeated_lines(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(n)], dtype=np.int64),
        "n_repeat_words": np.array([_repeated(hashes[bounds[i]:bounds[i + 1]]) for i in range(n)], dtype=np.int64),
    }
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    far, odd, wanting = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
    if model["langs"]:
        each = js_distance(_shares(_class_counts(data, offsets)), model["classes"])
        far = each.min(axis=1, initial=2)
        counts = _common_counts(data, offsets, starts, ends, model)
        wanting = ~np.where(model["least"] > 0, _common_share(counts, model) >= model["least"], each <= CLASS_LIMIT).any(axis=1)
        odd = js_distance(_shares(counts), model["word_shares"]).min(axis=1, initial=2)
    out |= {"class_distance": far, "word_distance": odd}
    diverges = (out["n_words"] >= MIN_WORDS) & (far > CLASS_LIMIT) | (out["n_words"] >= MIN_WORDS_COMMON) & ((odd > WORD_LIMIT) | wanting)
    out["kept"] = ~out["base_failed"] & ~diverges
    return out


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, class_distance double, word_distance double, kept boolean")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and every measure, a row for each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, most=2 << 20):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in measure(part, model.value).items()})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {FIELDS}")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is kept."""
    typed = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(references(typed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, most=2 << 20):
                yield part.filter(pa.array(measure(part, model.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
