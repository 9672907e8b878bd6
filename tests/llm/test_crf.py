"""The toxic-span field against enumeration of all taggings, finite differences and held-out labels."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from ionweave.llm import crf

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
ODD = [(-1, None), (-2, ""), (-3, " \n\t . !! "), (-4, "idiot"), (-5, "word " * 40_000), (-6, "ünï çödé 日本語 IDIOT, Moron! 🙂 stupid\nloser"), (-6, "x"), (None, "idiot")]


def enumerated(emission, links):
    """Marginals and log Z of one sequence from all its taggings."""
    start, enter, leave, stay = links
    step = [[0.0, enter], [leave, stay]]
    weights = {}
    for tags in itertools.product((0, 1), repeat=len(emission)):
        score = sum(e for e, t in zip(emission, tags) if t) + (start if tags[0] else 0) + sum(step[a][b] for a, b in zip(tags, tags[1:]))
        weights[tags] = np.exp(score)
    z = sum(weights.values())
    return [sum(w for tags, w in weights.items() if tags[k]) / z for k in range(len(emission))], np.log(z)


@pytest.mark.parametrize("seed", range(4))
def test_chain_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 9, 60)
    emission, links = rng.normal(0, 4, sizes.sum()), rng.normal(0, 1.5, 4)
    begins = np.zeros(sizes.sum(), dtype=bool)
    begins[np.cumsum(sizes) - sizes] = True
    got, scale = crf.marginals(emission, begins, links), crf.chain(emission, begins, links)[1]
    at = 0
    for size in sizes:
        want, z = enumerated(emission[at:at + size], links)
        assert np.allclose(got[at:at + size], want, atol=1e-9) and np.isclose(scale[at:at + size].sum(), z)
        at += size


def test_long_sequence_and_large_scores():
    emission = np.where(np.arange(5000) % 7 == 0, 900.0, -900.0)
    begins = np.arange(5000) == 0
    got = crf.marginals(emission, begins, np.zeros(4))
    assert np.array_equal(got > 0.5, emission > 0) and np.isfinite(got).all()


def test_gradient():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        size = int(rng.integers(1, 12))
        at = sorted(rng.integers(0, size, rng.integers(0, 5)).tolist())
        tags = {a: bool(rng.random() < 0.5) for a in at}
        rows.append({"size": size, "at": at, "feature": rng.integers(0, 6, len(at)).tolist(), "toxic": [tags[a] for a in at], "n": int(rng.integers(1, 4))})
    schema = pa.schema([("size", pa.int64()), ("at", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32())), ("toxic", pa.list_(pa.bool_())), ("n", pa.int64())])
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    point = rng.normal(0, 1, 11)
    got = crf.loss_of(batch, point)
    for k in range(point.size):
        e = np.zeros(point.size)
        e[k] = 1e-5
        assert np.isclose(got[1 + k], (crf.loss_of(batch, point + e)[0] - crf.loss_of(batch, point - e)[0]) / 2e-5, rtol=1e-4, atol=1e-5)


@pytest.fixture(scope="module")
def model(spark):
    return crf.learn(spark.read.parquet(f"{MORE}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') as text"), spark.read.parquet(f"{MORE}/labels.parquet"))


def test_held_out_documents(spark, model):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') as text", "'x' as score", "1 as spans")
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    got = crf.score(docs, model).join(labels, "doc_id").filter(crf.is_held_out(crf.F.col("doc_id"))).select("score", "toxic").toPandas()
    hit = got.score >= crf.THRESHOLD
    assert len(got) > 1000 and hit[got.toxic == 0].mean() < 0.005
    assert hit[got.toxic == 1].mean() > 0.85


def test_odd_texts(spark, model):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') as text", "1 as _text")
    got = {(r.doc_id, r.score): r for r in crf.score(docs, model).collect()}
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got.values())
    by = {r.doc_id: r for r in got.values()}
    assert by[-1].score == by[-2].score == by[-3].score and not by[-5].spans and by[-5].score < 0.5
    text = dict(ODD[:6])[-6]
    found = next(r for r in got.values() if r.doc_id == -6 and r.spans)
    assert [text[s.start:s.end] for s in found.spans] == ["IDIOT, Moron", "stupid", "loser"] and found.score >= crf.THRESHOLD
    assert by[-4].score == by[None].score


def test_defined_results(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(6)], "doc_id long, text string")
    one = spark.createDataFrame([(k, 1) for k in range(6)], "doc_id long, toxic int")
    assert {r.score for r in crf.toxicity(docs, one).collect()} == {1.0}
    assert {(r.score, r.predicted) for r in crf.toxicity(docs, one.limit(0)).collect()} == {(0.0, 0)}
    assert crf.toxicity(docs.limit(0), one).count() == 0 and crf.toxicity(docs, one).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    both = spark.createDataFrame([(k, k % 2) for k in range(6)] + [(0, 1), (None, 1)], "doc_id long, toxic int")
    got = crf.toxicity(docs.union(docs), both).collect()
    assert len(got) == 12 and len({r.score for r in got}) == 1 and all(r.held_out in (True, False) for r in got)
