"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, digits and characters beyond ASCII; a sequence is a sentence. A token's features are its
folded form and its first 3 to 7 characters. Labels exist for documents only, so tokens are labelled through features
that stand significantly (``G_SEED``) and many times more often in toxic documents than in others: in a toxic document
their tokens are toxic, every other token is not; toxic documents without such a token tell nothing and are left out.
The field has two tags, a weight for each of the ``FEATURES`` features most tied to toxic documents, a bias, transitions
and a start weight, fitted by L-BFGS; every evaluation of loss and gradient is a Spark job over the encoded sentences.
Forward-backward gives each token's marginal. A document is scored by a logistic function of its largest
marginal and the sum of those of at least one half, whose tokens form its spans.

The fit reads a bounded sample: at most about ``TOXIC`` toxic and ``CLEAN`` other labelled documents, drawn by a hash of
doc_id, of which one of each group of near copies (equal smallest shingle) stays, so that copies do not make words of one
text look toxic. Scores cover every text whole: sentences without any feature differ only in their length and are
computed once for each length; the others run through one chain in blocks, so neither a long text nor a long sentence
takes more memory than its size.

Defined results: a null text is empty; an empty text has the score of no marginals; without labels of both classes every
score is the share of toxic labels (0 with none); a document with several labels is toxic if one says so; rows are
judged alone, so repeats get equal results; a row without doc_id is scored and teaches nothing. Other columns are ignored.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .store import stored

TOXIC, CLEAN = 8_192, 16_384
FEATURES, CANDIDATES, SEEN = 1 << 14, 1 << 18, 4
HEADS = (3, 4, 5, 6, 7)
G_SEED, RATIO_SEED = 30.0, 10.0
RIDGE, ROUNDS, TASKS = 1.0, 30, 8
THRESHOLD, SLICE, CHAIN = 0.7, 1 << 20, 128
_TOKEN = np.full(256, 32, dtype=np.uint8)
for _first, _last in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TOKEN[_first:_last] = np.arange(_first, _last)
_BREAK = np.zeros(256, dtype=np.int64)
_BREAK[list(b".!?\n")] = 1


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Tokens:
    """The tokens of some texts: where they stand, in which text and sentence, and the hashes of their features."""

    def __init__(self, part: pa.RecordBatch):
        self.data, self.offsets = T.text_bytes(part.column("text"))
        self.starts, self.ends = T.word_spans(_TOKEN[self.data], self.offsets)
        self.n, self.texts = self.starts.size, part.num_rows
        self.bounds = T.word_ranges(self.starts, self.offsets)
        self.text = np.repeat(np.arange(self.texts), np.diff(self.bounds))
        stops = np.concatenate([[0], np.cumsum(_BREAK[self.data])])
        new = np.ones(self.n, dtype=bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (stops[self.starts[1:]] != stops[self.ends[:-1]])
        self.first = np.flatnonzero(new)  # of each sentence
        self.sentence = np.cumsum(new) - 1
        self.sizes = np.diff(np.append(self.first, self.n))

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(tokens, hashes) of each kind of feature."""
        return T.head_hashes(self.data, self.starts, self.ends, HEADS)

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, places in the sorted ``keys``) of all features among them."""
        bits = 20
        sieve = np.zeros(1 << bits, dtype=bool)
        sieve[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        tokens, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for rows, hashes in self.features() if keys.size else []:
            hit = np.flatnonzero(sieve[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, hashes[hit]), keys.size - 1)
            same = keys[place] == hashes[hit]
            tokens.append(rows[hit[same]])
            places.append(place[same])
        return np.concatenate(tokens), np.concatenate(places)


def chain(emission: np.ndarray, begins: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, scale, backward) of sequences laid end to end.

    ``links``: scores of start, enter, leave, stay, relative to no toxic tag. The messages of one sequence do not reach
    the next, since its start multiplies by a matrix of equal rows; so all are one chain, cut into rows of ``CHAIN``
    tokens: products of whole rows, their messages one after another, then all rows at once.
    """
    n = emission.size
    start, enter, leave, stay = links
    rows = max(-(-n // CHAIN), 1)
    e, b = np.zeros(rows * CHAIN), np.ones(rows * CHAIN, dtype=bool)
    e[:n], b[:n] = emission, begins
    e, b = np.ascontiguousarray(e.reshape(rows, CHAIN).T), np.ascontiguousarray(b.reshape(rows, CHAIN).T)
    low = np.minimum(-e, 0)  # each matrix is scaled, so that large scores stay in range
    m00 = np.exp(low)
    m01 = np.exp(np.where(b, start, enter) + e + low)
    m10 = np.exp(np.where(b, 0.0, leave) + low)
    m11 = np.exp(np.where(b, start, stay) + e + low)
    a = np.stack([np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)])
    for t in range(CHAIN):
        a = np.stack([a[0] * m00[t] + a[1] * m10[t], a[0] * m01[t] + a[1] * m11[t], a[2] * m00[t] + a[3] * m10[t], a[2] * m01[t] + a[3] * m11[t]])
        a /= a.max(axis=0)
    into, out = np.empty((2, rows)), np.empty((2, rows))
    x, y = 0.5, 0.5
    for k, (p, q, r, s) in enumerate(a.T.tolist()):
        into[0, k], into[1, k] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(rows - 1, -1, -1):
        out[0, k], out[1, k] = x, y
        p, q, r, s = a[:, k].tolist()
        x, y = p * x + q * y, r * x + s * y
        x, y = x / (x + y), y / (x + y)
    forward, scale, backward = np.empty((CHAIN, 2, rows)), np.empty((CHAIN, rows)), np.empty((CHAIN, 2, rows))
    x, y = into
    for t in range(CHAIN):
        x, y = x * m00[t] + y * m10[t], x * m01[t] + y * m11[t]
        total = x + y
        x, y = x / total, y / total
        forward[t, 0], forward[t, 1], scale[t] = x, y, np.log(total) - low[t]
    x, y = out
    for t in range(CHAIN - 1, -1, -1):
        backward[t, 0], backward[t, 1] = x, y
        x, y = m00[t] * x + m01[t] * y, m10[t] * x + m11[t] * y
        x, y = x / (x + y), y / (x + y)
    flat = lambda v: v.transpose(1, 2, 0).reshape(2, -1)[:, :n]
    return flat(forward), scale.T.reshape(-1)[:n], flat(backward)


def marginals(emission: np.ndarray, begins: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The probability of the toxic tag for each token."""
    forward, _, backward = chain(emission, begins, links)
    both = forward * backward
    return both[1] / both.sum(axis=0)


def tag(tokens: Tokens, model: dict) -> np.ndarray:
    """Each token's marginal."""
    token, place = tokens.known(model["keys"])
    emission = np.full(tokens.n, model["bias"])
    np.add.at(emission, token, model["weights"][place])
    touched = np.zeros(tokens.sizes.size, dtype=bool)
    touched[tokens.sentence[token]] = True
    full = touched[tokens.sentence]
    lengths, which = np.unique(tokens.sizes[~touched], return_inverse=True)  # the others differ in length alone
    begins = np.zeros(tokens.n, dtype=bool)
    begins[tokens.first] = True
    plain = np.zeros(lengths.sum(), dtype=bool)
    plain[np.cumsum(lengths) - lengths] = True
    every = marginals(np.concatenate([emission[full], np.full(plain.size, model["bias"])]), np.concatenate([begins[full], plain]), model["links"])
    out = np.empty(tokens.n)
    out[full] = every[:full.sum()]
    base = np.zeros(tokens.sizes.size, dtype=np.int64)
    base[~touched] = full.sum() + (np.cumsum(lengths) - lengths)[which]
    rest = np.flatnonzero(~full)
    out[rest] = every[base[tokens.sentence[rest]] + rest - tokens.first[tokens.sentence[rest]]]
    return out


def evidence(tokens: Tokens, marginal: np.ndarray) -> np.ndarray:
    """(constant, log of the sum of those of at least one half, largest) of the marginals of each text.

    Small ones are left out of the sum, which else would follow the length of a text.
    """
    total = np.bincount(tokens.text, weights=np.where(marginal >= 0.5, marginal, 0), minlength=tokens.texts)
    most = np.zeros(tokens.texts)
    np.maximum.at(most, tokens.text, marginal)
    return np.stack([np.ones(tokens.texts), np.log(total + 0.01), most], axis=1)


def spans(tokens: Tokens, marginal: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) in code points of the toxic stretches of each text."""
    hot = np.flatnonzero(marginal >= 0.5)
    new = np.ones(hot.size, dtype=bool)
    new[1:] = (np.diff(hot) > 1) | (np.diff(tokens.sentence[hot]) > 0)
    nth = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
    out: list[list[tuple[int, int]]] = [[] for _ in range(tokens.texts)]
    for a, b in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], hot.size)):
        i = tokens.text[hot[a]]
        zero = nth[tokens.offsets[i]]
        out[i].append((int(nth[tokens.starts[hot[a]]] - zero), int(nth[tokens.ends[hot[b - 1]]] - zero)))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from T.slices(batch, most=SLICE)


def training_texts(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[DataFrame, list[int]]:
    """(text, toxic) of the bounded sample without near copies, and how many labelled documents each class has."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").cast("int").isin(0, 1) & ~is_held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    have = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    totals = [have.get(0, 0), have.get(1, 0)]
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    drawn = marked.filter(share < F.when(F.col("toxic") == 1, toxic / max(totals[1], 1)).otherwise(clean / max(totals[0], 1)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            data, offsets = T.text_bytes(part.column("text"))
            starts, ends = T.word_spans(data, offsets)
            words, bounds = T.span_hashes(data, starts, ends, fold=True), T.word_ranges(starts, offsets)
            least = [int(T.gram_hashes(own, min(5, own.size)).min(initial=np.iinfo(np.uint64).max).view(np.int64)) if own.size else 0
                     for own in (words[bounds[i]:bounds[i + 1]] for i in range(part.num_rows))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], [*part.schema.names, "sign"])

    chosen = docs.join(F.broadcast(drawn), "doc_id")  # bounded by the two sample sizes
    chosen = stored(chosen.select("doc_id", "text", "toxic").mapInArrow(sign, "doc_id long, text string, toxic int, sign long"))
    single = chosen.groupBy("sign", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return chosen.join(F.broadcast(single), ["sign", "toxic", "doc_id"]).select("text", "toxic"), totals


def feature_counts(texts: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(feature, n): how many texts have each feature, or each of those ``among``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens = Tokens(part)
            if among is None:
                rows, hashes = (np.concatenate(x) for x in zip(*tokens.features()))
            else:
                rows, place = tokens.known(among)
                hashes = among[place]
            order = np.lexsort((tokens.text[rows], hashes))
            text, hashes = tokens.text[rows][order], hashes[order]
            new = np.ones(hashes.size, dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            feature, n = np.unique(hashes[new], return_counts=True)
            yield pa.RecordBatch.from_pydict({"feature": pa.array(feature.view(np.int64)), "n": pa.array(n, pa.int64())})

    return texts.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(texts: DataFrame) -> dict:
    """``keys``, the features most tied to toxic texts, and which of them are seeds."""
    bad, good = texts.filter("toxic = 1").select("text"), texts.filter("toxic = 0").select("text")
    n_bad, n_good = bad.count(), good.count()
    often = feature_counts(bad).filter(F.col("n") >= min(SEEN, max(n_bad // 4, 1))).orderBy(F.desc("n"), "feature").limit(CANDIDATES).toArrow()
    order = np.argsort(often.column("feature").to_numpy().view(np.uint64))
    keys, a = often.column("feature").to_numpy().view(np.uint64)[order], often.column("n").to_numpy()[order].astype(float)
    rest = feature_counts(good, keys).toArrow()
    b = np.zeros(keys.size)
    b[np.searchsorted(keys, rest.column("feature").to_numpy().view(np.uint64))] = rest.column("n").to_numpy()

    def part(seen: np.ndarray, of: int, rate: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / (of * rate)) + (of - seen) * np.log(np.maximum(of - seen, 1e-9) / (of * np.maximum(1 - rate, 1e-12)))

    rate = (a + b) / (n_bad + n_good)
    g = 2 * (part(a, n_bad, rate) + part(b, n_good, rate))
    ratio = (a + 0.5) / (n_bad + 1) / ((b + 0.5) / (n_good + 1))
    top = np.sort(np.lexsort((keys, -np.where(ratio > 1, g, 0)))[:FEATURES])
    return {"keys": keys[top], "seeds": (g[top] >= G_SEED) & (ratio[top] >= RATIO_SEED)}


def encoded_sentences(texts: DataFrame, chosen: dict) -> DataFrame:
    """(size, at, feature, toxic, n): equal sentences counted; feature ``feature[i]`` stands at token ``at[i]``, whose tag is ``toxic[i]``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens = Tokens(part)
            bad = part.column("toxic").to_numpy() == 1
            token, place = tokens.known(chosen["keys"])
            toxic = np.zeros(tokens.n, dtype=bool)
            toxic[token[chosen["seeds"][place]]] = True
            toxic &= bad[tokens.text]
            told = ~bad | (np.bincount(tokens.text, weights=toxic, minlength=tokens.texts) > 0)
            order = np.lexsort((place, token))
            token, place = token[order], place[order]
            bounds = np.searchsorted(tokens.sentence[token], np.arange(tokens.sizes.size + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in
                     ((token - tokens.first[tokens.sentence[token]]).astype(np.int32), place.astype(np.int32), toxic[token])]
            out = pa.RecordBatch.from_arrays([pa.array(tokens.sizes, pa.int64()), *lists], ["size", "at", "feature", "toxic"])
            yield out.filter(pa.array(told[tokens.text[tokens.first]]))

    return texts.mapInArrow(run, "size long, at array<int>, feature array<int>, toxic array<boolean>").groupBy("size", "at", "feature", "toxic").agg(F.count("*").alias("n"))


def loss_of(batch: pa.RecordBatch, point: np.ndarray) -> np.ndarray:
    """The negative log-likelihood of some sentences, and its gradient: weights, bias, start, enter, leave, stay."""
    size, times = batch.column("size").to_numpy(), batch.column("n").to_numpy().astype(float)
    first = np.cumsum(size) - size
    at, feature, toxic = (batch.column(c) for c in ("at", "feature", "toxic"))
    place = at.flatten().to_numpy() + np.repeat(first, at.value_lengths().to_numpy())
    feature = feature.flatten().to_numpy()
    tag_of = np.zeros(size.sum(), dtype=np.int64)
    tag_of[place[toxic.flatten().to_numpy(zero_copy_only=False)]] = 1
    begins = np.zeros(tag_of.size, dtype=bool)
    begins[first] = True
    weight = np.repeat(times, size)
    emission = np.bincount(place, weights=point[feature], minlength=tag_of.size) + point[-5]
    start, enter, leave, stay = links = point[-4:]
    forward, scale, backward = chain(emission, begins, links)
    both = forward * backward
    p = both[1] / both.sum(axis=0)
    inner = np.flatnonzero(~begins)
    x, y = forward[:, inner - 1], backward[:, inner] * np.exp(np.stack([np.minimum(-emission[inner], 0), np.minimum(emission[inner], 0)]))
    pairs = np.stack([x[0] * y[0], x[0] * y[1] * np.exp(enter), x[1] * y[0] * np.exp(leave), x[1] * y[1] * np.exp(stay)])
    pairs /= pairs.sum(axis=0)
    before, now, w = tag_of[inner - 1], tag_of[inner], weight[inner]
    off = (p - tag_of) * weight
    out = np.zeros(point.size + 1)
    score = tag_of * emission + np.where(begins, tag_of * start, 0)
    score[inner] += np.array([[0, enter], [leave, stay]])[before, now]
    out[0] = (weight * (scale - score)).sum()
    out[1:-5] = np.bincount(feature, weights=off[place], minlength=point.size - 5)
    out[-5], out[-4] = off.sum(), off[begins].sum()
    for k, (i, j) in enumerate(((0, 1), (1, 0), (1, 1))):
        out[-3 + k] = (w * (pairs[2 * i + j] - ((before == i) & (now == j)))).sum()
    return out


def fit(sentences: DataFrame, size: int) -> np.ndarray:
    """Weights of so many features, bias, start, enter, leave and stay, by rounds of Spark jobs."""
    sentences = stored(sentences.repartition(TASKS))

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(point.size + 1)
            for batch in batches:
                if batch.num_rows:
                    total += loss_of(batch, point)
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

        parts = sentences.mapInArrow(run, "part binary").toArrow().column("part").to_pylist()  # one row a task, at most TASKS
        total = np.sum([np.frombuffer(x) for x in sorted(parts)], axis=0)
        return total[0] + RIDGE / 2 * (point @ point), total[1:] + RIDGE * point

    begin = np.zeros(size + 5)
    begin[-5] = -4.0
    return lbfgs(loss, begin, ROUNDS)


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], point: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Minimise a smooth function: limited-memory BFGS steps, halved until they gain."""
    value, slope = loss(point)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, kept = -slope, []
        for s, y in reversed(past):
            kept.append((s @ step) / (s @ y))
            step = step - kept[-1] * y
        if past:
            s, y = past[-1]
            step = step * ((s @ y) / (y @ y))
        else:
            step = step / max(np.linalg.norm(slope), 1.0)
        for (s, y), k in zip(past, reversed(kept)):
            step = step + (k - (y @ step) / (s @ y)) * s
        rate = 1.0
        while True:
            to = point + rate * step
            new, new_slope = loss(to)
            if new <= value + 1e-4 * rate * (slope @ step) or rate < 1e-6:
                break
            rate /= 2
        if new >= value:
            break
        if (to - point) @ (new_slope - slope) > 1e-10:
            past = [*past, (to - point, new_slope - slope)][-memory:]
        gain, point, value, slope = value - new, to, new, new_slope
        if gain < 1e-4 * max(abs(value), 1.0):
            break
    return point


def calibrate(texts: DataFrame, model: dict, totals: list[int]) -> np.ndarray:
    """Logistic weights of constant, log sum and maximum, each class counted as often as it is labelled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            tokens = Tokens(part)
            x = evidence(tokens, tag(tokens, model))
            yield pa.RecordBatch.from_pydict({"toxic": part.column("toxic"), "sum": pa.array(x[:, 1]), "most": pa.array(x[:, 2])})

    rows = texts.mapInArrow(run, "toxic int, sum double, most double").toArrow()  # one small row for each text of the sample
    x = np.stack([np.ones(rows.num_rows), rows.column("sum").to_numpy(), rows.column("most").to_numpy()], axis=1)
    y = rows.column("toxic").to_numpy().astype(float)
    weight = np.where(y == 1, totals[1] / max(y.sum(), 1), totals[0] / max((1 - y).sum(), 1))
    weight *= y.size / weight.sum()
    point = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ point, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * point
        point = point - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
    return point


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> dict:
    """The model of the labelled documents that are not held out."""
    texts, totals = training_texts(docs, labels, toxic, clean)
    if not min(totals) or texts.select("toxic").distinct().count() < 2:
        return {"share": totals[1] / max(sum(totals), 1)}
    texts = stored(texts)
    chosen = choose_features(texts)
    point = fit(encoded_sentences(texts, chosen), chosen["keys"].size)
    model = {"keys": chosen["keys"], "weights": point[:-5], "bias": point[-5], "links": point[-4:]}
    return model | {"score": calibrate(texts, model, totals)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, spans) of every row; spans are array<struct<start, end>> in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in _parts(batches):
            if "share" in model:
                value, found = np.full(part.num_rows, model["share"]), [[]] * part.num_rows
            else:
                tokens = Tokens(part)
                marginal = tag(tokens, model)
                odds = evidence(tokens, marginal) @ model["score"]
                value, found = np.round(1 / (1 + np.exp(-np.clip(odds, -50, 50))), 9), spans(tokens, marginal)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value), pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def toxicity(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans, spans): learned from labels not held out, for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = score(docs, learn(docs, labels, toxic, clean))
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                        F.size("spans").cast("long").alias("n_spans"), listed.alias("spans"))
