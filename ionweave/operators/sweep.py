"""Tolerance windows by a range-partitioned sweep: counts, distinct groups and pairs in one pass.

Both sides are cut into cells of the mass axis at quantiles of all masses, and bank rows within reach of a cell are
copied to it, so each query finds its whole window in its own cell. Queries and bank rows travel in one exchange, sorted
by mass; a task holds one cell of the bank as arrays and streams the queries past it. Window sizes are differences of
running sums, rows of the query's own group are found in a second order by group, and distinct groups are counted by the
rows whose previous row of the same group lies before the window. No pair is formed to count.

A mass that many rows share would make one large cell. Such a mass shows as several equal quantiles. Its bank rows are
folded to one weighted row for each group before they travel (rows that a listed window could need are kept), and the
queries of its cell are dealt to as many slices as there were equal quantiles, each with a copy of the folded bank. Where
every pair is wanted, bank rows are dealt to the slices instead, and the queries are copied.

Scores of logits against fingerprints of any width are products of blocks: the queries of a batch stand close together,
so their windows overlap, and one matrix product serves them all. A logit row is sent once, a fingerprint once a cell.
"""

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .arrowruns import against

CELL_ROWS = 200_000
PAIR_ROWS = 2_000  # of a cell where every pair is worked on: the work of a cell is its rows times a window
COPIES = 8  # cells that a bank row may be copied to, about, where every pair is worked on
MOST_CELLS = 16_384
MOST_TASKS = 4_096
LISTED = 1 << 18  # pairs made at a time
TILE_QUERIES, TILE_BYTES = 128, 16 << 20  # of a matrix product


def _bounds(mass: np.ndarray, ppm: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closed window around each mass, in the operation order of ``rangejoin.ppm_bounds``."""
    half = mass * (ppm / 1e6)
    return mass - half, mass + half


class Bank:
    """A cell of the bank in mass order."""

    def __init__(self, mass: np.ndarray, weight: np.ndarray, group: pa.Array | None):
        self.mass, self.total = mass, np.concatenate([[0], np.cumsum(weight)])
        self.names = None
        self.kept = None  # what an answer derives once from the cell's rows
        if group is not None:
            coded = group.dictionary_encode()
            self.names, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            order = np.argsort(self.code, kind="stable")  # by group, then by mass
            self.key = self.code[order] * (mass.size + 1) + order
            self.own_total = np.concatenate([[0], np.cumsum(weight[order])])
            self.before = np.full(mass.size, -1, dtype=np.int64)  # the previous row of the same group
            again = np.flatnonzero(self.code[order][1:] == self.code[order][:-1])
            self.before[order[again + 1]] = order[again]
            self.levels: list[np.ndarray] = []

    def codes(self, group: pa.Array) -> np.ndarray:
        """The bank's number of each group, -1 if it has none, -2 for a null."""
        found = pc.fill_null(pc.index_in(group, value_set=self.names), -1).to_numpy().astype(np.int64)
        found[group.is_null().to_numpy(zero_copy_only=False)] = -2
        return found

    def own(self, code: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows of the given group inside ``[first, last)``."""
        base = code * (self.mass.size + 1)
        a, b = np.searchsorted(self.key, base + first), np.searchsorted(self.key, base + last)
        return np.where(code >= 0, self.own_total[b] - self.own_total[a], 0)

    def distinct(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Different groups inside ``[first, last)``: rows whose previous one of the same group is before ``first``."""
        width = last - first
        if width.sum() <= 32 * (self.mass.size + first.size):
            row = np.repeat(np.arange(first.size), width)
            at = np.arange(row.size) - np.repeat(np.cumsum(width) - width, width) + first[row]
            return np.bincount(row, weights=self.before[at] < first[row], minlength=first.size).astype(np.int64)
        if not self.levels:  # sorted blocks of 1, 2, 4, ... rows
            size = 1 << max(int(self.mass.size - 1).bit_length(), 0)
            low = np.full(size, self.mass.size, dtype=np.int64)
            low[:self.mass.size] = self.before
            self.levels = [np.sort(low.reshape(-1, 1 << k), axis=1).reshape(-1) for k in range(size.bit_length())]
        out, a, b, span = np.zeros(first.size, dtype=np.int64), first.copy(), last.copy(), self.mass.size + 2

        def below(level: int, block: np.ndarray, rows: np.ndarray) -> None:
            low = self.levels[level]
            keys = low + 1 + (np.arange(low.size) >> level) * span
            out[rows] += np.searchsorted(keys, first[rows] + 1 + block * span) - (block << level)

        for level in range(len(self.levels)):
            rows = np.flatnonzero((a < b) & (a & 1 == 1))
            below(level, a[rows], rows)
            a[rows] += 1
            rows = np.flatnonzero((a < b) & (b & 1 == 1))
            b[rows] -= 1
            below(level, b[rows], rows)
            a, b = a >> 1, b >> 1
        return out

    def windows(self, mass: np.ndarray, ppm: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = _bounds(mass, ppm)
        return np.searchsorted(self.mass, lo, side="left"), np.searchsorted(self.mass, hi, side="right")

    def counts(self, mass: np.ndarray, ppm: float, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """(rows, groups) inside each window, without the query's own group."""
        first, last = self.windows(mass, ppm)
        rows = self.total[last] - self.total[first]
        if code is None:
            return rows, None
        own = self.own(code, first, last)
        groups = self.distinct(first, last) - (own > 0)
        return np.where(code == -2, 0, rows - own), np.where(code == -2, 0, groups)


def _cut_points(queries: DataFrame, bank: DataFrame, cell_rows: int, widest: float | None = None) -> list[float]:
    """Quantiles of all masses (``_m``), with repeats where a mass has more than one cell's rows.

    With ``widest`` cells are so large that the window around the middle of one reaches over ``COPIES`` of them at most, for
    most rows: what is copied then grows with the rows, and no longer with their square.
    """
    both = queries.select("_m").unionByName(bank.select("_m"))
    rows = both.count()
    cells = min(MOST_CELLS, -(-rows // cell_rows))
    if cells < 2:
        return []
    shares = F.array(*[F.lit(k / cells) for k in range(1, cells)])
    cuts = sorted(both.agg(F.percentile_approx("_m", shares, F.lit(100_000))).first()[0])
    if widest is None:
        return cuts
    at = np.array(cuts)
    first, last = np.searchsorted(at, _bounds(at, widest)[0], side="left"), np.searchsorted(at, _bounds(at, widest)[1], side="right")
    apart = np.unique(at).size
    step = 1 if apart < at.size else max(1, int(-(-np.percentile(last - first, 75) // COPIES)))  # repeats keep their count
    return cuts[step - 1::step]


def _cell(frame: DataFrame, cuts: list[float], column: str, name: str) -> DataFrame:
    """``name``: how many of the (different) cuts are at or under ``column``."""
    if not cuts:
        return frame.withColumn(name, F.lit(0))
    edges = [-float("inf"), *cuts, float("inf")]
    return Bucketizer(splits=edges, inputCol=column, outputCol=name, handleInvalid="keep").transform(frame).withColumn(name, F.col(name).cast("int"))


def _folded(bank: DataFrame, hot: list[float], cap: int | None) -> DataFrame:
    """Rows of hot masses as one weighted row for each group, but for those that a window of at most ``cap`` could list."""
    if not hot:
        return bank.withColumn("_w", F.lit(1).cast("bigint"))
    is_hot = F.col("_m").isin(hot)
    runs = bank.filter(is_hot).groupBy("_m", "_g").agg(F.count(F.lit(1)).alias("_w"))
    whole = runs.groupBy("_m").agg(F.sum("_w").alias("_all"), F.max("_w").alias("_top"))  # a row for each hot mass
    listed = F.lit(False) if cap is None else (F.col("_all") - F.col("_top") <= cap) & (F.col("_w") <= cap)
    judged = runs.join(F.broadcast(whole), "_m").withColumn("_listed", listed).drop("_all", "_top")
    few = judged.filter("_listed").select(F.col("_m").alias("_fm"), F.col("_g").alias("_fg"))  # at most cap rows have these
    kept = bank.filter(is_hot).join(few, (F.col("_m") == F.col("_fm")) & F.col("_g").eqNullSafe(F.col("_fg"))).select(bank.columns)
    one = judged.filter("not _listed").select("_m", "_g", F.lit(None).cast(bank.schema["_b"].dataType).alias("_b"), "_w")
    plain = bank.filter(~is_hot).unionByName(kept).withColumn("_w", F.lit(1).cast("bigint"))
    return plain.unionByName(one)


def windowed(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, widest: float, group: tuple[str, str] | None, bank_columns: list[str],
           cap: int | None, schema: str, whole: bool = True, answer: Callable[[pa.StructArray, Bank, np.ndarray, np.ndarray | None, pa.StructArray], Iterator[pa.RecordBatch]],
           cell_rows: int = CELL_ROWS, fold: bool = True, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Stream every query past the cell that holds its window; ``answer`` gives the rows of a batch of queries.

    ``whole``: a query needs its window in one piece; else the pieces of a hot cell may answer apart. ``fold``: bank rows
    of a hot mass may be folded by group; else each slice of its queries has all of them. ``then`` works on the stream of
    a task's answers.
    """
    none = F.lit(None).cast("string")
    query_group, bank_group = (F.col(group[0]).cast("string"), F.col(group[1]).cast("string")) if group else (none, none)
    mass = F.col(query_mass).cast("double")
    valid = finite(mass) & (mass > 0)
    q = queries.select(F.when(valid, mass).otherwise(0.0).alias("_m"), query_group.alias("_g"), F.struct(*queries.columns).alias("_q"))
    b = bank.filter(finite(F.col(bank_mass).cast("double")) & (F.col(bank_mass) > 0)).select(
        F.col(bank_mass).cast("double").alias("_m"), bank_group.alias("_g"), F.struct(*bank_columns).alias("_b"))
    if group:
        b = b.filter(F.col("_g").isNotNull())
    cuts = _cut_points(q, b, cell_rows, None if whole and fold else widest)
    repeats = Counter(cuts)
    edges, hot = sorted(repeats), sorted(c for c, n in repeats.items() if n > 1 and c != 0.0)
    b = _folded(b, hot if whole and fold else [], cap)
    part = widest / 1e6
    reach = b.withColumns({"_a": F.col("_m") / (1 + part) * (1 - 1e-12), "_z": F.col("_m") / (1 - part) * (1 + 1e-12) if part < 1 else F.lit(float("inf"))})
    reach = _cell(_cell(reach, edges, "_a", "_ca"), edges, "_z", "_cz")
    b = reach.withColumn("_cell", F.explode(F.sequence("_ca", "_cz")))
    q = _cell(q, edges, "_m", "_cell")
    many = [1, *(max(1, repeats[c]) if c != 0.0 else 1 for c in edges)]  # slices of each cell
    slices = F.get(F.array(*map(F.lit, many)), F.col("_cell")) if hot else F.lit(1)
    one = F.pmod(F.xxhash64(F.monotonically_increasing_id()), slices).cast("int") if hot else F.lit(0)
    every = F.explode(F.sequence(F.lit(0), slices - 1)) if hot else F.lit(0)
    q, b = q.withColumn("_slice", one if whole else every), b.withColumn("_slice", every if whole else one)
    names = ["_cell", "_slice", "_side", "_m", "_g", "_w", "_q", "_b"]
    q = q.select("_cell", "_slice", F.lit(1).alias("_side"), "_m", "_g", F.lit(0).cast("bigint").alias("_w"), "_q", F.lit(None).cast(b.schema["_b"].dataType).alias("_b"))
    b = b.select("_cell", "_slice", F.lit(0).alias("_side"), "_m", "_g", "_w", F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), "_b")

    def prepare(rows: pa.Table) -> tuple[Bank, pa.StructArray]:
        masses, groups, weights, known = (rows.column(c).combine_chunks() for c in ("_m", "_g", "_w", "_b"))
        return Bank(masses.to_numpy(), weights.to_numpy(), groups if group else None), known

    def reply(ready: tuple[Bank, pa.StructArray], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, known = ready
        yield from answer(part.column("_q"), cell, part.column("_m").to_numpy(), cell.codes(part.column("_g")) if group else None, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = against(batches, ["_cell", "_slice"], "_side", ["_m", "_g", "_w", "_b"], prepare, reply)
        return then(found) if then else found

    # each cell and slice has a number, so that tasks hold as many of them as one another
    tasks = min(MOST_TASKS, sum(many))
    before = F.get(F.array(*map(F.lit, np.cumsum([0, *many[:-1]]).tolist())), F.col("_cell"))
    dealt = q.unionByName(b).select(names).repartitionById(tasks, F.pmod(before + F.col("_slice"), F.lit(tasks)).cast("int")).sortWithinPartitions("_cell", "_slice", "_side", "_m")
    return dealt.mapInArrow(run, schema)


def _schema(*parts: DataFrame | str) -> str:
    return ", ".join(p if isinstance(p, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema) for p in parts)


def window_counts(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, ppms: list[float], group: str | None = None,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """``queries`` with ``rows_<ppm>``, the bank rows inside each window, and with ``group`` (a column of both sides)
    ``groups_<ppm>``: then rows of the query's own group are left out and the other groups counted.

    Queries whose mass is null, not finite or not positive get NULL; a null group has no others and is nobody's other.
    """
    counts = [*[f"rows_{p:g}" for p in ppms], *([f"groups_{p:g}" for p in ppms] if group else [])]
    names = [*queries.columns, *counts]

    def answer(query: pa.StructArray, cell: Bank, mass: np.ndarray, code: np.ndarray | None, _: pa.StructArray) -> Iterator[pa.RecordBatch]:
        bad = mass <= 0
        rows, groups = zip(*[cell.counts(mass, p, code) for p in ppms])
        found = [pa.array(x, pa.int64(), mask=bad) for x in [*rows, *(groups if group else ())]]
        yield pa.RecordBatch.from_arrays([*query.flatten(), *found], names)

    return windowed(queries, bank, query_mass=query_mass, bank_mass=bank_mass, widest=max(ppms), group=(group, group) if group else None, bank_columns=[bank_mass], cap=None,
                  schema=_schema(queries, *[f"`{c}` bigint" for c in counts]), answer=answer, cell_rows=cell_rows)


def selected_pairs(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, narrow: float, wide: float, cap: int,
                   query_group: str | None = None, bank_group: str | None = None, cell_rows: int = CELL_ROWS,
                   settle: tuple[Callable[[np.ndarray, pa.RecordBatch], pa.RecordBatch], str] | None = None) -> DataFrame:
    """Pairs of each query with the rows of its narrow window, or of the wide one if that is empty.

    All columns of both sides (of different names) and ``selected_ppm``. A window of more than ``cap`` rows is held: it
    gives no pair, and is found by its count. ``settle`` turns batches of pairs, each with the number of its query (those
    of a query stand together and in one batch), into rows of its schema, so that work on whole queries needs no shuffle.
    """
    names = [*queries.columns, *bank.columns, "selected_ppm"]

    def answer(query: pa.StructArray, cell: Bank, mass: np.ndarray, code: np.ndarray | None, known: pa.StructArray) -> Iterator[pa.RecordBatch]:
        rows, _ = cell.counts(mass, narrow, code)
        more, _ = cell.counts(mass, wide, code)
        near = rows > 0
        size = np.where(near, rows, more)
        usable = np.flatnonzero((mass > 0) & (size > 0) & (size <= cap))
        (a, b), (c, d) = cell.windows(mass[usable], narrow), cell.windows(mass[usable], wide)
        first, last = np.where(near[usable], a, c), np.where(near[usable], b, d)
        upto = np.concatenate([[0], np.cumsum(last - first)])
        begin = 0
        while begin < usable.size:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + LISTED, side="right")) - 1)
            width = (last - first)[begin:end]
            row = np.repeat(np.arange(begin, end), width)
            at = np.arange(row.size) - np.repeat(np.cumsum(width) - width, width) + first[row]
            if code is not None:
                other = cell.code[at] != code[usable[row]]
                row, at = row[other], at[other]
            left, right = query.take(pa.array(usable[row])), known.take(pa.array(at))
            ppm = pa.array(np.where(near[usable[row]], narrow, wide))
            pairs = pa.RecordBatch.from_arrays([*left.flatten(), *right.flatten(), ppm], names)
            yield settle[0](row, pairs) if settle else pairs
            begin = end

    return windowed(queries, bank, query_mass=query_mass, bank_mass=bank_mass, widest=max(narrow, wide), group=(query_group, bank_group) if query_group else None,
                  bank_columns=bank.columns, cap=cap, schema=settle[1] if settle else _schema(queries, bank, "selected_ppm double"), answer=answer, cell_rows=cell_rows)


def _tiles(query: pa.StructArray, cell: Bank, mass: np.ndarray, known: pa.StructArray, *, ppm: float, logits: str, words: str, n_bits: int,
           blocks: dict[str, tuple[int, int]], spread: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(query, bank row, scores of each block, set bits) of the pairs of a batch, a tile at a time; pairs of a query stand together."""
    own = query.field(logits)
    z = np.full((len(query), n_bits), np.nan)
    have = own.is_valid().to_numpy(zero_copy_only=False)
    if have.any():
        sent = own.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(have.sum()), -1)
        z[have] = spread(sent) if spread else sent
    first, last = cell.windows(mass, ppm)
    last = np.where(mass > 0, last, first)
    room = max(1, TILE_BYTES // (8 * n_bits))
    begin = 0
    while begin < mass.size:
        # as many queries as reach over at most a tile of the bank; sorted by mass, so are the ends of their windows
        end = begin + int(np.searchsorted(last[begin:begin + TILE_QUERIES], first[begin] + room, side="right"))
        end = max(end, begin + 1)
        for low in range(int(first[begin]), int(last[end - 1]), room):
            high = min(low + room, int(last[end - 1]))
            start, stop = (np.clip(x[begin:end], low, high) for x in (first, last))
            width = stop - start
            row = np.repeat(np.arange(width.size), width)
            if not row.size:
                continue
            at = np.arange(row.size) - np.repeat(np.cumsum(width) - width, width) + start[row]
            packed = known.slice(low, high - low).field(words).flatten().to_numpy().reshape(high - low, -1)
            bits = np.unpackbits(packed.view(np.uint8), axis=1, bitorder="little")[:, :n_bits].astype(np.float64)
            scores = [(z[begin:end, a:b] @ bits[:, a:b].T)[row, at - low] for a, b in blocks.values()]
            yield row + begin, at, scores, bits.sum(axis=1).astype(np.int32)[at - low]
        begin = end


def window_scores(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, ppm: float, logits: str, words: str, n_bits: int,
                  blocks: dict[str, tuple[int, int]], on_bits: str = "on_bits", cell_rows: int = PAIR_ROWS, spread: Callable[[np.ndarray], np.ndarray] | None = None,
                  made: dict[str, Callable[[dict[str, np.ndarray]], np.ndarray]] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Every pair of a query and a bank row in its window, with the sum of the logits at the row's set bits for each block.

    ``logits`` (array<float> or array<double>) and ``words`` (array<bigint> of 64-bit words, lowest bit first, unused bits
    zero) are used up; all other columns of both sides (of different names) are kept. ``blocks`` maps a name to a half-open
    range of bits. A query without logits has null scores. ``spread`` makes the ``n_bits`` logits of queries (query, bit)
    from the values that are sent. ``made`` replaces the scores and the set bits by doubles that follow from them and from
    numbers of the query, NaN for null; ``kept`` names the other columns that a pair then has. What is not kept stays in
    the task.
    """
    left, right = [c for c in queries.columns if c != logits], [c for c in bank.columns if c != words]
    shown = [c for c in [*left, *right] if kept is None or c in kept]
    names = [*shown, *(made or [*blocks, on_bits])]
    numbers = [c for c in left if queries.schema[c].dataType.typeName() == "double"] if made else []

    def answer(query: pa.StructArray, cell: Bank, mass: np.ndarray, _: np.ndarray | None, known: pa.StructArray) -> Iterator[pa.RecordBatch]:
        plain = {c: query.field(c).to_numpy(zero_copy_only=False) for c in numbers}
        for row, at, scores, on in _tiles(query, cell, mass, known, ppm=ppm, logits=logits, words=words, n_bits=n_bits, blocks=blocks, spread=spread):
            if made:
                have = {**{c: v[row] for c, v in plain.items()}, **dict(zip(blocks, scores)), on_bits: on}
                found = [f(have) for f in made.values()]
            else:
                found = [*scores, on]
            row, at = pa.array(row), pa.array(at)
            yield pa.RecordBatch.from_arrays([*(query.field(c).take(row) if c in left else known.field(c).take(at) for c in shown),
                                              *(pa.array(x, mask=np.isnan(x)) if x.dtype == np.float64 else pa.array(x) for x in found)], names)

    kinds = {f.name: f.dataType.simpleString() for side in (queries, bank) for f in side.schema}
    found = [f"`{c}` double" for c in made] if made else [*[f"`{c}` double" for c in blocks], f"`{on_bits}` int"]
    return windowed(queries, bank, query_mass=query_mass, bank_mass=bank_mass, widest=ppm, group=None, bank_columns=bank.columns, cap=None, whole=False,
                  schema=", ".join([*[f"`{c}` {kinds[c]}" for c in shown], *found]), answer=answer, cell_rows=cell_rows)


def settled_windows(queries: DataFrame, bank: DataFrame, *, query_mass: str, bank_mass: str, ppm: float, schema: str,
                    settle: Callable[[pa.StructArray, pa.StructArray, np.ndarray, np.ndarray], pa.RecordBatch], own_ppm: str | None = None, cell_rows: int = PAIR_ROWS) -> DataFrame:
    """What ``settle`` makes of the pairs of a query and a bank row in its window, where they meet: no pair is shuffled.

    It gets the rows of both sides and, ``LISTED`` pairs or a query at a time, the places of each pair in them; those of a
    query stand together and come in one call, unless one query has more, or its mass is hot. ``own_ppm`` names a column
    with the width of each query's window, at most ``ppm``.
    """

    def answer(asked: pa.StructArray, cell: Bank, mass: np.ndarray, _: np.ndarray | None, known: pa.StructArray) -> Iterator[pa.RecordBatch]:
        first, last = cell.windows(mass, ppm if own_ppm is None else asked.field(own_ppm).to_numpy())
        usable = np.flatnonzero((mass > 0) & (last > first))
        width = (last - first)[usable]
        upto = np.concatenate([[0], np.cumsum(width)])
        begin = 0
        while begin < usable.size:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + LISTED, side="right")) - 1)
            w = width[begin:end]
            row = np.repeat(usable[begin:end], w)
            at = np.arange(row.size) - np.repeat(np.cumsum(w) - w, w) + first[row]
            for i in range(0, row.size, LISTED):
                yield settle(asked, known, row[i:i + LISTED], at[i:i + LISTED])
            begin = end

    return windowed(queries, bank, query_mass=query_mass, bank_mass=bank_mass, widest=ppm, group=None, bank_columns=bank.columns, cap=None, whole=False, schema=schema,
                    answer=answer, cell_rows=cell_rows)


def score_spread(queries: DataFrame, bank: DataFrame, *, query: str, query_mass: str, bank_mass: str, ppm: float, logits: str, words: str, n_bits: int,
                 blocks: dict[str, tuple[int, int]], cell_rows: int = PAIR_ROWS) -> DataFrame:
    """For each query with a window its mean ``m_<block>`` and population deviation ``s_<block>`` of ``window_scores``; an
    exact 0 for a constant block, null without logits.

    A tile gives one row for each of its queries; the pairs stay in their task.
    """
    names = [query, "_n", *(f"_{k}_{c}" for c in blocks for k in "mvlh")]

    def answer(asked: pa.StructArray, cell: Bank, mass: np.ndarray, _: np.ndarray | None, known: pa.StructArray) -> Iterator[pa.RecordBatch]:
        for row, _, scores, _ in _tiles(asked, cell, mass, known, ppm=ppm, logits=logits, words=words, n_bits=n_bits, blocks=blocks):
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            n = np.diff(np.append(start, row.size))
            out = []
            for x in scores:
                mean = np.add.reduceat(x, start) / n
                out += [mean, np.add.reduceat((x - np.repeat(mean, n)) ** 2, start), np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)]
            yield pa.RecordBatch.from_arrays([asked.field(query).take(pa.array(row[start])), pa.array(n), *(pa.array(x, mask=np.isnan(x)) for x in out)], names)

    schema = ", ".join([f"`{query}` {queries.schema[query].dataType.simpleString()}", "_n bigint", *[f"`{c}` double" for c in names[2:]]])
    asked = queries.select(query, query_mass, logits)
    pieces = windowed(asked, bank.select(bank_mass, words), query_mass=query_mass, bank_mass=bank_mass, widest=ppm, group=None, bank_columns=[bank_mass, words], cap=None,
                    whole=False, schema=schema, answer=answer, cell_rows=cell_rows)
    # a query has a piece for each tile of its window
    sums = pieces.groupBy(query).agg(F.sum("_n").alias("_n"), F.collect_list(F.struct(*names[1:])).alias("_p"), *[F.sum(F.col("_n") * F.col(f"_m_{c}")).alias(f"_t_{c}") for c in blocks],
                                     *[(F.min(f"_l_{c}") == F.max(f"_h_{c}")).alias(f"_k_{c}") for c in blocks])
    out = [F.col(query)]
    for c in blocks:
        mean = F.col(f"_t_{c}") / F.col("_n")
        apart = F.transform("_p", lambda p: p[f"_v_{c}"] + p["_n"] * (p[f"_m_{c}"] - mean) * (p[f"_m_{c}"] - mean))  # noqa: B023
        about = F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + x)
        out += [mean.alias(f"m_{c}"), F.when(F.col(f"_k_{c}"), 0.0).otherwise(F.sqrt(about / F.col("_n"))).alias(f"s_{c}")]
    return sums.select(*out)


def policy(counted: DataFrame, *, query_mass: str, narrow: float, wide: float, cap: int | None) -> DataFrame:
    """The window that each counted query uses: ``selected_ppm``, ``selected_rows`` and ``status`` (0 usable, 1 bad mass, 2 empty, 3 over ``cap``, if there is one)."""
    n, w = F.col(f"rows_{narrow:g}"), F.col(f"rows_{wide:g}")
    rows: Column = F.when(n > 0, n).otherwise(w)
    valid = finite(F.col(query_mass)) & (F.col(query_mass) > 0)
    return counted.withColumn("selected_ppm", F.when(n > 0, F.lit(narrow)).when(w > 0, F.lit(wide))).withColumn("selected_rows", rows).withColumn(
        "status", F.when(~valid, 1).when(rows == 0, 2).when(F.lit(False) if cap is None else rows > cap, 3).otherwise(0))
