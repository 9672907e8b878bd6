"""The divergence and filter audits against plain Python over small tables with nulls, ties, repeats and odd texts."""

import collections
import itertools
import re

import numpy as np
import pytest

from ionweave.llm import divergence, filter_audit

TERM, WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence_rows(docs, top=200, min_docs=3):
    """All rows by the definition, term by term and pair by pair."""
    groups, spread = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in docs:
        terms = TERM.findall((text or "").translate(FOLD))
        groups[lang or "", source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in spread[lang].items() if n >= min_docs]
        mine = {g[1]: c for g, c in groups.items() if g[0] == lang}
        whole = sum((c for c in mine.values()), collections.Counter())
        price = lambda c: [1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept]  # noqa: E731, B023
        prices, q = {s: price(c) for s, c in mine.items()}, price(whole)
        far = lambda p, q: (p - q) * (p - q) // q
        for source, p in prices.items():
            pairs = [(s, sum(map(far, p, prices[s]))) for s in prices if s != source]
            terms = [(t, far(a, b)) for t, a, b in zip(kept, p, q) if mine[source][t] and a > b]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


def many(seed, n, sources):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "été", "ÉTÉ", "日本", "x", "zeta_9eta", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]]
    return [(k, " ".join(rng.choice(words, rng.integers(0, 30)).tolist()), f"l{rng.integers(0, 2)}", f"s{rng.integers(0, sources)}") for k in range(n)]


ODD = [(1, None, None, None), (1, None, None, None), (None, "", "", "a"), (3, "one Two 3", "l0", "s0"), (4, "solo solo\nsolo", "only", "one"),
       (5, "A" * 200_000, "l0", "s1"), (6, "--- 123 ...", "empty", "p"), (7, None, "empty", "q")]


@pytest.mark.parametrize("seed, n, sources, block, tile", [(0, 60, 4, 2048, 24), (1, 200, 9, 8, 2), (2, 40, 30, 16, 4)])
def test_divergence(spark, seed, n, sources, block, tile):
    docs = many(seed, n, sources) + ODD + many(seed, 5, sources)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as term", "'x' as rank", "2 as n")
    for top in (200, 3):
        got = [tuple(r) for r in divergence.divergences(frame, top=top, block=block, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == divergence_rows(docs, top)


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.divergences(empty).collect() == []
    lone = spark.createDataFrame([("a", "l", "s"), (None, "l", "t")], "text string, lang string, source string")
    assert {tuple(r) for r in divergence.divergences(lone).collect()} == {("l", "s", "pair", "t", 0, 1), ("l", "t", "pair", "s", 0, 1)}


def test_trees_share_equal_subtrees():
    counts = np.zeros((3, 256), dtype=np.int64)
    counts[1, 5], counts[2, :] = 7, np.arange(256) % 4
    trees = divergence.Trees(counts)
    assert trees.sizes[-1] == 3 and max(trees.sizes) <= 6  # 256 leaves, a handful of nodes on each level
    pair, x, y, times = trees.meet(np.array([0, 1, 0]), np.array([1, 2, 0]))
    for k, (a, b) in enumerate(((0, 1), (1, 2), (0, 0))):
        want = collections.Counter(zip(counts[a].tolist(), counts[b].tolist()))
        mine = pair == k
        assert dict(zip(zip(x[mine].tolist(), y[mine].tolist()), times[mine].tolist())) == want


def test_enormous_counts():
    whole = np.array([9 * 10**18], dtype=object)
    assert divergence._price(np.array([8 * 10**18], dtype=object), whole)[0] == 1 + 10**9 * (8 * 10**18 + 1) // (9 * 10**18)


def audit_rows(docs, labels):
    """All rows by walking every order over every document."""
    marks = collections.defaultdict(set)
    for doc_id, quality, toxic in labels:
        marks[doc_id] |= {k for k, v in (("good", quality), ("toxic", toxic)) if v == 1 and doc_id is not None}
    low = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            low[text or ""] = min(low.get(text or "", doc_id), doc_id)
    parts = collections.defaultdict(list)
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {k for k, v in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), bool(set(text) & set("#$%&*|")),
            doc_id is not None and low[text] < doc_id)) if v}
        parts[source or ""].append((fails, marks[doc_id]))
    out, removed = {}, collections.Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            alive = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in alive if letter in r[0]]
                failing = sum(letter in r[0] for r in rows)
                alive = [r for r in alive if letter not in r[0]]
                removed[part, letter] += len(gone)
                out[part, "".join(order), step] = (len(alive), len(gone), failing - len(gone), sum(r[0] == {letter} for r in rows), sum("good" in r[1] for r in gone), sum("toxic" in r[1] for r in gone))
    return {(part, order, step, *v, removed[part, order[step - 1]]) for (part, order, step), v in out.items()}


def test_filter_audit(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n", "WORD " * 250, "word " * 250, " ".join(map(str, range(300))), "A#b", " ".join(f"x{k}" for k in range(210)) + " % ", "é" * 100 + "AB", "\x0b1\x0c2\t3 " * 90]
    docs = [(k, texts[rng.integers(len(texts))], ["s", "t", None, ""][rng.integers(4)]) for k in range(120)]
    docs += docs[:9] + [(None, "A#b", "s"), (None, "only here", "t"), (500, "only here", "t"), (501, "long " * 60_000, "u")]
    labels = [(k, int(rng.integers(2)), int(rng.integers(2))) for k in range(0, 120, 2)] + [(0, 1, 0), (2, None, None), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as mask", "'z' as good", "3 as digest")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as n")
    got = [tuple(r) for r in filter_audit.audit(frame, marks).collect()]
    assert len(got) == 4 * 600 and set(got) == audit_rows(docs, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
