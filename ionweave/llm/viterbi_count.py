"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton finds every piece ending at every character; dynamic programming carries the best score and
its number of pieces. The rules are those of the unigram tokenizer: scores are summed in double precision, a later
candidate must be strictly better, and candidates for one end come by their start, earliest first; a character that no
single piece covers costs the lowest score less 10 and counts its UTF-8 bytes. Blanks become U+2581, with one in
front. No piece holds that mark after another character, so texts are cut before each word's marks, the best path
passes there anyway, and words met before are looked up.

The vocabulary is the piece list of a public model with its scores, read as a unigram model. Defined results: a null
or empty text has no tokens; rows are counted alone; an empty table gives no rows. Other columns are ignored.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE = 400_000


def vocabulary(path: str) -> dict[str, float]:
    """The plain pieces (no control, unknown or byte pieces) and their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): model.get_score(i) for i in plain}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.lowest = min(pieces.values(), default=0.0) - UNKNOWN_COST
        self.single = {p for p in pieces if len(p) == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on past a word's start")
        self.known: dict[str, int] = {}

    def best(self, unit: str) -> int:
        """The number of pieces on the best path of one unit."""
        scores, counts, at = [0.0], [0], 1
        found: list[list[tuple[int, float]]] = [[] for _ in unit]
        for end, match in self.automaton.iter(unit):
            found[end].append(match)
        for end, char in enumerate(unit):
            top, n = None, 0
            for length, score in sorted(found[end], reverse=True):
                value = scores[at - length] + score
                if top is None or value > top:
                    top, n = value, counts[at - length] + 1
            if char not in self.single:
                value = scores[at - 1] + self.lowest
                if top is None or value > top:
                    top, n = value, counts[at - 1] + len(char.encode())
            scores.append(top)
            counts.append(n)
            at += 1
        return counts[-1]

    def learn(self, unit: str) -> int:
        n = self.best(unit)
        if len(unit) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        get, learn = self.known.get, self.learn
        return sum([get(u) or learn(u) for u in _UNITS.findall(MARK + text.replace(" ", MARK))])


_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=1)
def counter_of(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in T.slices(batch, most=1 << 20):
                n = [counter.count(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
