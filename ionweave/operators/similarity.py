"""Pair-level spectral similarity and assignment: small vectorised kernels inside Spark's Arrow batches.

The pairs come from a range join and are spread by Spark; a kernel only ever sees one Arrow batch.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import peaks as pk
from . import aggregates, sweep


def _padded(lists: pd.Series, fill: float) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    out = np.full((len(lists), max(1, int(lengths.max(initial=0)))), fill)
    mask = np.arange(out.shape[1]) < lengths[:, None]
    if lengths.sum():
        out[mask] = np.concatenate([np.asarray(x, np.float64) for x in lists])
    return out, lengths


def _ended(mz: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Peaks of spectra (row, peak) with infinite ones behind the last, at least one."""
    out = np.full((len(mz), mz.shape[1] + 1), np.inf)
    real = np.arange(mz.shape[1]) < lengths[:, None]
    out[:, :-1][real] = mz[real]
    return out


def _walk(qm: np.ndarray, qi: np.ndarray, of: np.ndarray, cm: np.ndarray, ci: np.ndarray, at: np.ndarray, tol: float, shift: np.ndarray | None) -> np.ndarray:
    """Two-pointer one-to-one matching of all pairs (row ``of`` of one side, row ``at`` of the other) at once.

    Both sides are ``_ended``: behind its last peak a side only lets the other go on, and two ends differ by no number.
    """
    i, j, dot = of * qm.shape[1], at * cm.shape[1], np.zeros(of.size)
    q, c = qm.reshape(-1), cm.reshape(-1)
    qv, cv = qi.reshape(-1), ci.reshape(-1)  # a place less in each row: intensities have no end
    gap, other = np.empty(of.size), np.empty(of.size)
    with np.errstate(invalid="ignore"):
        for _ in range(qm.shape[1] + cm.shape[1]):
            np.take(q, i, out=gap, mode="clip")
            if shift is not None:
                np.subtract(gap, shift, out=gap)
            np.subtract(gap, np.take(c, j, out=other, mode="clip"), out=gap)
            left, right = gap <= tol, gap >= -tol  # whose pointer goes on
            if not (left.any() or right.any()):
                break
            hit = np.flatnonzero(left & right)
            dot[hit] += qv[i[hit] - of[hit]] * cv[j[hit] - at[hit]]
            i += left
            j += right
    return dot


def greedy_cosine(query_mz: Column, query_it: Column, cand_mz: Column, cand_it: Column, shift: Column,
                  tol: float = 0.01, modified: bool = True) -> Column:
    """One-to-one cosine of L2 vectors; ``modified`` takes the better of direct and mass-shifted alignment."""

    @F.pandas_udf("double")
    def kernel(qm: pd.Series, qi: pd.Series, cm: pd.Series, ci: pd.Series, s: pd.Series) -> pd.Series:
        qmz, qn = _padded(qm, 0.0)
        qit, _ = _padded(qi, 0.0)
        cmz, cn = _padded(cm, 0.0)
        cit, _ = _padded(ci, 0.0)
        each, qmz, cmz = np.arange(len(qm)), _ended(qmz, qn), _ended(cmz, cn)
        direct = _walk(qmz, qit, each, cmz, cit, each, tol, None)
        if not modified:
            return pd.Series(direct)
        moved = _walk(qmz, qit, each, cmz, cit, each, tol, s.to_numpy(np.float64))
        return pd.Series(np.where(np.abs(s.to_numpy(np.float64)) < 0.001, direct, np.maximum(direct, moved)))

    return kernel(query_mz, query_it, cand_mz, cand_it, shift)


PAIRS = 1 << 14  # matched at a time, so that their places stay in the cache


def _spectra(side: pa.StructArray, mz: str, it: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded m/z and intensities of the rows, and their lengths."""

    def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        out = np.zeros((len(column), max(1, int(lengths.max(initial=0)))))
        out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out, lengths

    (m, n), (v, _) = padded(side.field(mz)), padded(side.field(it))
    return m, v, n


def window_cosines(queries: DataFrame, bank: DataFrame, *, query: str, cand: str, mass: str, mz: str, it: str, ppm: float, tol: float = 0.01, modified: bool = True,
                   key: str | None = None, cell_rows: int = sweep.PAIR_ROWS) -> DataFrame:
    """(query, candidate, sim) of every pair of spectra of different ids in a mass window, matched where the pair meets.

    Both sides have an id, ``mass`` and the arrays ``mz`` and ``it``; ``modified`` as in ``greedy_cosine``. A spectrum is
    sent once a cell. With ``key``, a column of the bank: (query, key, sim) with the best of a query's pairs in a batch,
    one row or a few for each key.
    """

    def settle(asked: pa.StructArray, known: pa.StructArray, row: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        names, theirs = asked.field(query).to_numpy(), known.field(cand).to_numpy()
        other = names[row] != theirs[at]
        row, at = row[other], at[other]
        sim = np.zeros(row.size)
        for i in range(0, row.size, PAIRS):
            r, c = row[i:i + PAIRS], at[i:i + PAIRS]
            # rows stand close together, so only the stretches that the pairs name are unpacked
            r0, c0 = int(r.min()), int(c.min())
            own, bank_rows = asked.slice(r0, int(r.max()) - r0 + 1), known.slice(c0, int(c.max()) - c0 + 1)
            (qm, qi, qn), (cm, ci, cn) = _spectra(own, mz, it), _spectra(bank_rows, mz, it)
            r, c, qm, cm = r - r0, c - c0, _ended(qm, qn), _ended(cm, cn)
            match = lambda shift: _walk(qm, qi, r, cm, ci, c, tol, shift)  # noqa: B023, E731
            direct = match(None)
            if modified:
                shift = own.field(mass).to_numpy()[r] - bank_rows.field(mass).to_numpy()[c]
                direct = np.where(np.abs(shift) < 0.001, direct, np.maximum(direct, match(shift)))
            sim[i:i + PAIRS] = direct
        if key is None:
            return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(theirs[at]), pa.array(sim)], [query, cand, "sim"])
        pairs = pa.table({query: names[row], key: known.field(key).take(pa.array(at)), "sim": sim})
        best = pairs.group_by([query, key], use_threads=False).aggregate([("sim", "max")]).combine_chunks()
        return pa.RecordBatch.from_arrays([best.column(c).combine_chunks() for c in (query, key, "sim_max")], [query, key, "sim"])

    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    qm, cm = f"_q{mass}", f"_c{mass}"
    q, b = (df.select(ident, F.col(mass).alias(own), mass, mz, it, *more) for df, ident, own, more in ((queries, query, qm, []), (bank, cand, cm, [key] if key else [])))
    out = sweep.settled_windows(q, b, query_mass=qm, bank_mass=cm, ppm=ppm, schema=f"{kind(queries, query)}, {kind(bank, key or cand)}, sim double", settle=settle, cell_rows=cell_rows)
    return out


def entropy(p: np.ndarray) -> np.ndarray:
    return -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)


def _reweighted(p: np.ndarray) -> np.ndarray:
    """Flatten low-entropy spectra: power 0.25 + 0.25 * entropy below entropy 3."""
    h = entropy(p)
    power = np.where(h < 3.0, 0.25 + 0.25 * h, 1.0)
    raised = np.where(p > 0, np.power(np.where(p > 0, p, 1.0), power[:, None]), 0.0)
    total = raised.sum(axis=1, keepdims=True)
    return np.where((h < 3.0)[:, None], raised / np.where(total > 0, total, 1.0), p)


def entropy_similarity(mz_a: Column, p_a: Column, mz_b: Column, p_b: Column, tol: float = 0.01) -> Column:
    """Spectral entropy similarity; peaks of A, strongest first, take the nearest free peak of B within ``tol``."""

    @F.pandas_udf("double")
    def kernel(ma: pd.Series, pa: pd.Series, mb: pd.Series, pb: pd.Series) -> pd.Series:
        am, an = _padded(ma, 0.0)
        ap, _ = _padded(pa, 0.0)
        bm, bn = _padded(mb, np.inf)
        bp, _ = _padded(pb, 0.0)
        ap, bp = _reweighted(ap), _reweighted(bp)
        rows = np.arange(len(am))
        order = np.argsort(-ap, axis=1, kind="stable")
        used = np.arange(bm.shape[1])[None, :] >= bn[:, None]
        mixed = np.zeros((len(am), am.shape[1]))
        for k in range(am.shape[1]):
            at = order[:, k]
            real = ap[rows, at] > 0
            gap = np.abs(bm - am[rows, at][:, None])
            gap = np.where(used | (gap > tol), np.inf, gap)
            best = gap.argmin(axis=1)
            hit = real & np.isfinite(gap[rows, best])
            mixed[:, k] = (ap[rows, at] + np.where(hit, bp[rows, best], 0.0)) / 2
            used[rows[hit], best[hit]] = True
        rest = np.where(used, 0.0, bp) / 2
        value = 1 - (2 * (entropy(mixed) + entropy(rest)) - entropy(ap) - entropy(bp)) / np.log(4.0)
        return pd.Series(np.where((an > 0) & (bn > 0), value, 0.0))

    return kernel(mz_a, p_a, mz_b, p_b)


def binned_entropy_similarity(left: DataFrame, right: DataFrame, keys: list[str], bin_column: str, value: str) -> DataFrame:
    """Unweighted entropy similarity of two binned spectra per key, as joins and sums."""

    def normal(df: DataFrame, name: str) -> DataFrame:
        per_bin = df.filter(F.col(value) > 0).groupBy(*keys, bin_column).agg(F.max(value).alias("_v"))
        totals = per_bin.groupBy(*keys).agg(F.sum("_v").alias("_t"))
        return per_bin.join(totals, keys).select(*keys, bin_column, (F.col("_v") / F.col("_t")).alias(name))

    both = normal(left, "_a").join(normal(right, "_b"), [*keys, bin_column], "full_outer")
    a, b = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    h = lambda p: F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0))
    sums = both.groupBy(*keys).agg(h((a + b) / 2).alias("_m"), h(a).alias("_ha"), h(b).alias("_hb"), F.sum(a).alias("_sa"), F.sum(b).alias("_sb"))
    value_ = 1 - (2 * F.col("_m") - F.col("_ha") - F.col("_hb")) / F.lit(float(np.log(4.0)))
    return sums.filter("_sa > 0 and _sb > 0").select(*keys, value_.alias("similarity"))


def explained(ions: Column, mz: Column, weight: Column, abs_tol: float, ppm: float) -> Column:
    """Struct (assignment, independent): share of observed weight an ion set explains.

    ``assignment`` uses every ion and peak once (the ordered dynamic programme, one prefix maximum
    per peak); ``independent`` lets ions repeat. Arrays are ascending and bounded per spectrum.
    """

    @F.pandas_udf("assignment double, independent double")
    def kernel(all_ions: pd.Series, all_mz: pd.Series, all_w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(assigned(all_ions.to_numpy(), all_mz.to_numpy(), all_w.to_numpy(), abs_tol, ppm * 1e-6), columns=["assignment", "independent"])

    return kernel(ions, mz, weight)


CELLS = 1 << 20  # of a padded block of rows


def assigned(ions: np.ndarray, mz: np.ndarray, weight: np.ndarray, abs_tol: float, share: float) -> np.ndarray:
    """(assignment, independent) of many spectra at a time.

    Spectra of similar size share a padded block; the programme takes one step a peak for all rows of a block. A padding
    ion is reached by no peak, and a padding peak weighs nothing.
    """
    sizes = np.array([(len(m), len(x)) for m, x in zip(mz, ions)], dtype=np.int64).reshape(-1, 2)
    out, order, begin = np.zeros((len(sizes), 2)), np.lexsort((sizes[:, 1], sizes[:, 0])), 0
    while begin < order.size:
        widest = np.maximum.accumulate(sizes[order[begin:], 1]) + 1
        end = begin + max(1, int(np.searchsorted(widest * np.arange(1, widest.size + 1), CELLS, side="right")))
        rows = order[begin:end]
        x, m, w = (_padded([v[r] for r in rows], fill)[0] for v, fill in ((ions, np.inf), (mz, 0.0), (weight, 0.0)))
        best, free = np.zeros((rows.size, x.shape[1] + 1)), np.zeros(rows.size)
        tol = np.maximum(abs_tol, share * m)
        for k in range(m.shape[1]):
            reach = np.abs(m[:, k, None] - x) <= tol[:, k, None]
            step = best.copy()
            step[:, 1:] = np.maximum(best[:, 1:], np.where(reach, best[:, :-1] + w[:, k, None], 0.0))
            best = np.maximum.accumulate(step, axis=1)
            free += np.where(reach.any(axis=1), w[:, k], 0.0)
        total = w.sum(axis=1)
        out[rows] = np.where(total[:, None] > 0, np.stack([best[:, -1], free], axis=1) / np.where(total > 0, total, 1.0)[:, None], 0.0)
        begin = end
    return out


def best_by_key(pairs: DataFrame, query: str, key: str, score: str) -> DataFrame:
    """Best similarity per (query, identity)."""
    return pairs.groupBy(query, key).agg(F.max(score).alias("best"))


def condition_means(roster: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean over conditions and measured spectra for every roster row; NULL where nothing was scored."""
    means = scores.groupBy(*keys).agg(F.avg(score).alias("mean_similarity"), F.count(score).alias("n_scored"))
    return roster.join(means, keys, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def consensus_features(views: DataFrame, keys: list[str], n_ions: str, hot: DataFrame | str | None = None) -> DataFrame:
    """Nine features per (query, candidate) over views with assignment, independent and coverage columns."""
    v = (views.withColumn("excess", F.col("assignment") - F.col("coverage"))
         .withColumn("reuse_gap", F.greatest(F.lit(0.0), F.col("independent") - F.col("assignment"))))
    base = v.groupBy(*keys).agg(
        F.max("assignment").alias("assignment_max"), F.avg("excess").alias("uniform_excess_mean"), F.max("reuse_gap").alias("reuse_gap_max"),
        F.avg("coverage").alias("coverage_mean"), F.log1p(F.max(n_ions).cast("double")).alias("hypothesis_count_log1p"),
        F.count(F.lit(1)).alias("view_count"))
    long = v.select(*keys, F.explode(F.array(
        F.struct(F.lit("a").alias("kind"), F.col("assignment").alias("x")),
        F.struct(F.lit("e").alias("kind"), F.col("excess").alias("x")))).alias("p")).select(*keys, "p.kind", "p.x")
    q = aggregates.exact_quantiles(long, [*keys, "kind"], "x", {"mid": 0.5, "low": 0.25}, hot=hot)
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    q = q.groupBy(*keys).agg(pick("a", "mid").alias("assignment_median"), pick("a", "low").alias("assignment_q25"),
                             pick("e", "low").alias("uniform_excess_q25"))
    return base.join(q, keys)


def column_ablation(base: DataFrame, recomputed: DataFrame, keys: list[str], column: str, old: str, new: str,
                    tolerance: float = 1e-8) -> DataFrame:
    """Swap ``column`` for ``new`` and flag rows where the recomputed old value leaves the stored one.

    A row without a recomputed partner counts as a violation.
    """
    joined = base.join(recomputed, keys, "left")
    parity = F.coalesce(F.abs(F.col(column) - F.col(old)) <= tolerance, F.lit(False))
    return joined.withColumn("parity_ok", parity).withColumn(column, F.col(new)).drop(old, new)


def prepared(df: DataFrame, peaks: str, floor: float = 0.002, top: int = 256) -> DataFrame:
    """m/z and unit-L2 square-root intensity arrays in m/z order."""
    out = df.withColumn("_p", pk.sqrt_l2(pk.by_mz(F.col(peaks)), floor, top))
    return (out.withColumn("mz", F.transform("_p", lambda p: p["mz"]))
            .withColumn("it", F.transform("_p", lambda p: p["intensity"])).drop("_p"))
