"""Languages of mixed texts: script ranges, per-word scores and Viterbi with a switching penalty.

A word's score in a language is the sum of log-shares of its hashed character n-grams and of the word itself, counted
over all learned documents (``BUCKETS`` counters a language, so the model is bounded). The script of its first letter
leaves only languages that write it. A word of over ``LONGEST`` bytes (unspaced scripts) counts as several, divided
between characters; its n-grams run over the divisions, and spans count the parts as words. Viterbi over a text's words, each switch costing ``PENALTY``, gives spans of one
language each. A path without switches is best whenever no stretch of words gains more than half the penalty in
another language (n stretches need n - 1 switches or more, and one over the whole text gains nothing); that is tested on running sums, so only mixed texts are walked word by word.

The language of a text is the one with most words on the path; its score is their mean posterior. Defined results: a
null text and one without a letter are ``und`` with score 0, and so is every text when nothing was learned; ties go to
the first language by name; rows are judged alone. A row without doc_id or language teaches nothing. Other columns are
ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T

BUCKETS = 1 << 15
PENALTY = 12.0
DAMPING = 0.5  # n-grams of one word are not independent
SCRIPT_SHARE = 0.001
LONGEST = 40
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "south asian", "kana", "han", "hangul", "other")
#: Script ranges by the first byte of a letter.
_SCRIPT = np.zeros(256, dtype=np.int64)
_SCRIPT[65:91] = _SCRIPT[97:123] = 1
_SCRIPT[0xC3:0xCC], _SCRIPT[0xCD:0xD0], _SCRIPT[0xD0:0xD4], _SCRIPT[0xD6:0xD8], _SCRIPT[0xD8:0xDC] = 1, 2, 3, 4, 5
_SCRIPT[0xE0], _SCRIPT[0xE1], _SCRIPT[0xE3], _SCRIPT[0xE4:0xEA], _SCRIPT[0xEA:0xEE] = 6, 10, 7, 8, 9
_BYTE = T.mix(np.arange(512, 768, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, reach, head, tail): words, the long ones divided before a character about every ``LONGEST`` bytes.

    ``reach`` is where the last n-gram of a part ends; head and tail say whether the word's borders are in reach.
    """
    many = (ends - starts + LONGEST - 1) // LONGEST
    word = np.repeat(np.arange(starts.size), many)
    begin = starts[word] + (np.arange(word.size) - (np.cumsum(many) - many)[word]) * LONGEST
    for _ in range(3):
        begin = begin - ((begin > starts[word]) & (data[begin] & 0xC0 == 0x80))
    end = np.append(begin[1:], 0)
    end[np.cumsum(many) - 1] = ends
    reach = np.minimum(end + 3, ends[word])
    return begin, end, reach, begin == starts[word], reach == ends[word]


class Words:
    """The different words of some texts: n-gram counters and scripts of each, and which word stands where."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = T.text_bytes(part.column("text"))
        starts, ends = T.word_spans(data, offsets)
        starts, ends, reach, head, tail = _parts(data, starts, ends)
        self.bounds = T.word_ranges(starts, offsets)
        kind = T.mix((ends - starts).astype(np.uint64) * np.uint64(4) + head * np.uint64(2) + tail)
        _, first, self.place = np.unique(T.span_hashes(data, starts, reach, fold=True) ^ kind, return_index=True, return_inverse=True)
        start, head, whole = starts[first], head[first].astype(np.int64), (head & (ends == reach))[first]
        own = head + ends[first] - starts[first]  # n-grams begin at the blank before or at a byte of the part
        size = head + reach[first] - starts[first] + tail[first]
        self.n = first.size
        owner = np.repeat(np.arange(self.n), size)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        step = np.arange(owner.size) - begin[owner]
        inside = step - head[owner]
        edge = (inside < 0) | (inside == (reach - starts)[first][owner])
        code = np.where(edge, 32, _LOWER[data[np.where(edge, start[owner], start[owner] + inside)]]) if owner.size else np.zeros(0, dtype=np.int64)
        left = np.where(step < own[owner], size[owner] - step, 0)  # characters left, this one included
        grams, owners, h = [], [], np.zeros(owner.size, dtype=np.uint64)
        for k in range(4):
            h = h[:owner.size - k] * np.uint64(0x100000001B3) + _BYTE[code[k:]] if k else _BYTE[code].copy()
            fits = left[:h.size] > k
            if k:
                grams.append(T.mix(h[fits] + np.uint64(k)))
                owners.append(owner[:h.size][fits])
        grams.append(T.mix(T.span_hashes(data, starts, ends, fold=True)[first[whole]] if self.n else np.zeros(0, dtype=np.uint64)))
        owners.append(np.flatnonzero(whole))
        self.gram = (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.owner = np.concatenate(owners)
        letters = np.flatnonzero((_SCRIPT[code] > 0) & (left > 0))
        self.script = np.zeros(self.n, dtype=np.int64)
        self.script[owner[letters[::-1]]] = _SCRIPT[code[letters[::-1]]]  # the first letter is written last


def learn(docs: DataFrame) -> dict | None:
    """The model of documents with text and language: names, log-shares by n-gram counter, scripts each language writes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in T.slices(batch, most=2 << 20):
                words, names = Words(part), part.column("lang").to_pylist()
                for name in set(names):
                    mine = np.array([x == name for x in names])
                    n = np.bincount(words.place[np.repeat(mine, np.diff(words.bounds))], minlength=words.n).astype(np.float64)
                    total = totals.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                    total[:BUCKETS] += np.bincount(words.gram, weights=n[words.owner], minlength=BUCKETS).astype(np.int64)
                    total[BUCKETS:] += np.bincount(words.script, weights=n, minlength=len(SCRIPTS)).astype(np.int64)
        for name, total in totals.items():
            key = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * key.size, pa.string()), "key": pa.array(key, pa.int32()), "n": total[key]})

    counts = docs.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(run, "lang string, key int, n long")
    rows = counts.groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()  # counters and scripts of each language
    if not rows.num_rows:
        return None
    names = sorted(set(rows.column("lang").to_pylist()))
    index = np.array([names.index(x) for x in rows.column("lang").to_pylist()])
    table = np.zeros((len(names), BUCKETS + len(SCRIPTS)))
    table[index, rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    share = np.log(grams + 0.5) - np.log(grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    writes = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= SCRIPT_SHARE
    writes[:, 0] = True
    writes |= ~writes.any(axis=0)  # a script nobody writes excludes nobody
    return {"names": names, "share": share.astype(np.float32), "writes": writes}


def word_scores(words: Words, model: dict) -> np.ndarray:
    """A row for each different word: the damped log-likelihood in each language, relative to the best."""
    out = np.stack([np.bincount(words.owner, weights=share[words.gram], minlength=words.n) for share in model["share"]], axis=1) * DAMPING
    out = np.where(words.script[:, None] == 0, 0.0, out)
    out = np.where(model["writes"][:, words.script].T, out, out.min(axis=1, initial=0, keepdims=True) - 8)
    return np.maximum(out - out.max(axis=1, initial=-np.inf, keepdims=True), -8.0) if words.n else out


def walk(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word: scores summed, each switch costing the penalty."""
    best = int(np.argmax(scores.sum(axis=0)))
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    if 2 * max((gain[1:] - floor[:-1]).max(initial=0), gain[:1].max(initial=0)) <= penalty:
        return np.full(len(scores), best)
    total, back, rows = scores[0].tolist(), [], scores.tolist()
    for row in rows[1:]:
        top = max(total)
        lead = total.index(top)
        came = [lead if top - penalty > t else k for k, t in enumerate(total)]
        total = [max(t, top - penalty) + x for t, x in zip(total, row)]
        back.append(came)
    path = [total.index(max(total))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


def label(part: pa.RecordBatch, model: dict | None) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans of (first word, last word + 1, language)) of each text."""
    words, out = Words(part), []
    scores = word_scores(words, model) if model else None
    sure = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True) if model else None
    letters = np.concatenate([[0], np.cumsum((words.script > 0)[words.place])])[words.bounds]
    for i, text in enumerate(part.column("text").to_pylist()):
        own = words.place[words.bounds[i]:words.bounds[i + 1]]
        if not model or not own.size or not (letters[i + 1] > letters[i] or any(map(str.isalpha, text))):
            out.append(("und", 0.0, []))
            continue
        path = walk(scores[own])
        best = int(np.argmax(np.bincount(path, minlength=len(model["names"]))))
        cut = np.flatnonzero(np.diff(path)) + 1
        spans = [(int(a), int(b), model["names"][path[a]]) for a, b in zip([0, *cut], [*cut, path.size])]
        out.append((model["names"][best], float(np.clip(sure[own, best].mean(), 0, 1)), spans))
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_spans, spans) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, most=2 << 20):
                names, score, spans = zip(*label(part, shared.value))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()),
                    pa.array([[{"first": a, "last": b, "lang": x} for a, b, x in own] for own in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())])))],
                    ["doc_id", "lang_pred", "score", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first: long, last: long, lang: string>>")


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_spans): learned from the documents not held out, predicted for all."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    out = identify(docs, learn(known))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
