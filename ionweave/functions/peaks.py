"""Per-spectrum peak operations on ``array<struct<mz, intensity>>`` columns.

Everything here is a column expression: a spectrum is one row, so none of these shuffles.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import finite


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once even inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def intensities(peaks: Column) -> Column:
    return F.transform(peaks, lambda p: p["intensity"])


def highest(peaks: Column) -> Column:
    return F.array_max(intensities(peaks))


def _struct(mz: Column, intensity: Column) -> Column:
    return F.struct(mz.alias("mz"), intensity.alias("intensity"))


def finite_positive(peaks: Column) -> Column:
    """Drop peaks with a non-finite m/z or an intensity that is not finite and positive."""
    return F.filter(peaks, lambda p: finite(p["mz"]) & finite(p["intensity"]) & (p["intensity"] > 0))


def strongest(peaks: Column, floor: float, top: int) -> Column:
    """Peaks of at least ``floor`` times the maximum, the ``top`` strongest (earlier position wins ties), in place."""

    def pick(kept: Column) -> Column:
        ranked = F.transform(kept, lambda p, i: F.struct((-p["intensity"]).alias("neg"), i.alias("pos"), p.alias("p")))
        chosen = F.slice(F.array_sort(ranked), 1, top)
        placed = F.array_sort(F.transform(chosen, lambda r: F.struct(r["pos"].alias("pos"), r["p"].alias("p"))))
        return F.transform(placed, lambda r: r["p"])

    def above(raw: Column) -> Column:
        return let(highest(raw), lambda m: F.filter(raw, lambda p: p["intensity"] >= m * F.lit(floor)))

    return let(let(peaks, above), pick)


def by_mz(peaks: Column) -> Column:
    """Ascending m/z; equal m/z keep their order."""
    keyed = F.transform(peaks, lambda p, i: F.struct(p["mz"].alias("mz"), i.alias("pos"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda r: r["p"])


def unit_sum(peaks: Column) -> Column:
    """Intensities divided by their sum."""
    return let(peaks, lambda ps: let(total(intensities(ps)), lambda s: F.transform(
        ps, lambda p: _struct(p["mz"], p["intensity"] / s))))


def clean_floor_topk(peaks: Column, floor: float = 0.002, top: int = 256) -> Column:
    """Floor, strongest ``top``, m/z order, intensities summing to one; empty input stays empty."""
    good = finite_positive(peaks)
    return F.when(F.size(good) == 0, good).otherwise(unit_sum(by_mz(strongest(good, floor, top))))


def sqrt_l2(peaks: Column, floor: float = 0.002, top: int = 256) -> Column:
    """Floor, strongest ``top``, square root, unit L2 norm."""
    kept = strongest(peaks, floor, top)
    rooted = F.transform(kept, lambda p: _struct(p["mz"], F.sqrt(p["intensity"])))
    return let(rooted, lambda ps: let(
        F.sqrt(total(F.transform(ps, lambda p: p["intensity"] * p["intensity"]))),
        lambda n: F.transform(ps, lambda p: _struct(p["mz"], F.when(n > 0, p["intensity"] / n).otherwise(p["intensity"])))))


def windowed(peaks: Column, precursor: Column, max_peaks: int = 128, floor: float = 1e-3, window: float = 50.0,
             per_window: int = 8, slack: float = 1.5) -> Column:
    """Diversified peak choice: the strongest few of each m/z window first, then the strongest rest.

    Peaks above the precursor plus ``slack`` go first; result is in m/z order as float32
    ``sqrt(intensity / max)``. After sorting by (window, -intensity, position) a peak is among its
    window's first ``per_window`` exactly when the entry that many places before it belongs to
    another window.
    """
    empty = F.filter(peaks, lambda p: F.lit(False))
    inside = F.filter(peaks, lambda p: p["mz"] <= precursor + F.lit(slack))
    loud = let(inside, lambda ps: let(highest(ps), lambda m: F.when(
        m > 0, F.filter(ps, lambda p: p["intensity"] >= m * F.lit(floor))).otherwise(F.filter(ps, lambda p: F.lit(False)))))

    def choose(ps: Column) -> Column:
        boxed = F.array_sort(F.transform(ps, lambda p, i: F.struct(
            F.floor(p["mz"] / window).alias("box"), (-p["intensity"]).alias("neg"), i.alias("pos"), p.alias("p"))))
        flagged = let(boxed, lambda b: F.transform(b, lambda r, i: F.struct(
            F.when((i < per_window) | (F.get(b, i - per_window)["box"] != r["box"]), 0).otherwise(1).alias("late"),
            r["neg"].alias("neg"), r["pos"].alias("pos"), r["p"].alias("p"))))
        return F.transform(F.slice(F.array_sort(flagged), 1, max_peaks), lambda r: r["p"])

    chosen = let(loud, lambda ps: F.when(F.size(ps) > max_peaks, choose(ps)).otherwise(ps))

    def finish(ps: Column) -> Column:
        return let(highest(ps), lambda m: F.transform(by_mz(ps), lambda p: F.struct(
            p["mz"].cast("float").alias("mz"), F.sqrt(p["intensity"] / m).cast("float").alias("intensity"))))

    done = let(chosen, finish)
    return F.when(F.size(inside) > 0, done).otherwise(finish(empty))


def base_scaled(peaks: Column) -> Column:
    """Intensities divided by the spectrum's own maximum."""
    return let(peaks, lambda ps: let(F.greatest(highest(ps), F.lit(1e-9)), lambda m: F.transform(
        ps, lambda p: _struct(p["mz"], p["intensity"] / m))))


def merge_neighbours(peaks: Column, gap: float = 0.005) -> Column:
    """Of two adjacent peaks closer than ``gap`` the weaker goes, the later one winning ties.

    Every adjacent pair of the sorted list is judged on the original neighbours, so whether a peak
    stays depends on its two neighbours only.
    """

    def judge(ps: Column) -> Column:
        def stays(p: Column, i: Column) -> Column:
            before, after = F.get(ps, i - 1), F.get(ps, i + 1)
            beaten_left = (p["mz"] - before["mz"] < gap) & (p["intensity"] < before["intensity"])
            beaten_right = (after["mz"] - p["mz"] < gap) & (after["intensity"] >= p["intensity"])
            return ~F.coalesce(beaten_left, F.lit(False)) & ~F.coalesce(beaten_right, F.lit(False))

        return F.filter(ps, stays)

    return let(by_mz(peaks), judge)


def merge_predicted(peaks: Column, tolerance: float = 1e-3, top: int = 100, how: str = "max") -> Column:
    """Fold peaks within ``tolerance`` of a cluster's first peak by max or sum; strongest ``top``, unit sum."""
    ordered = by_mz(finite_positive(peaks))
    empty = F.filter(ordered, lambda p: F.lit(False))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        value = F.greatest(last["intensity"], p["intensity"]) if how == "max" else last["intensity"] + p["intensity"]
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                          F.array(_struct(last["mz"], value)))
        near = (F.size(acc) > 0) & (p["mz"] - last["mz"] <= tolerance)
        return F.when(near, merged).otherwise(F.concat(acc, F.array(_struct(p["mz"], p["intensity"]))))

    clusters = F.aggregate(ordered, empty, step)
    return let(clusters, lambda c: F.when(F.size(c) == 0, c).otherwise(unit_sum(strongest(c, 0.0, top))))


def window_status(peaks: Column, lo: Column, hi: Column) -> Column:
    """Declared acquisition bounds: absent, invalid, or containing every peak."""
    # fixed values: the states
    return (F.when(lo.isNull() | hi.isNull(), "HOLD_NO_ACQUISITION_WINDOW")
            .when(~finite(lo) | ~finite(hi) | (lo <= 0) | (hi <= lo)
                  | F.exists(peaks, lambda p: (p["mz"] < lo) | (p["mz"] > hi)), "INVALID_WINDOW")
            .otherwise("DECLARED_ACQUISITION_WINDOW"))


def overlapping_neighbours(peaks: Column, abs_tol: float = 0.01, ppm: float = 0.0) -> Column:
    """Adjacent m/z whose tolerance intervals touch."""

    def count(ps: Column) -> Column:
        reach = lambda m: F.greatest(F.lit(abs_tol), m * F.lit(ppm * 1e-6))
        touch = F.transform(ps, lambda p, i: F.coalesce(
            (p["mz"] + reach(p["mz"]) >= F.get(ps, i + 1)["mz"] - reach(F.get(ps, i + 1)["mz"])).cast("int"), F.lit(0)))
        return F.aggregate(touch, F.lit(0), lambda acc, x: acc + x)

    return let(by_mz(peaks), count)


def covered_fraction(ions: Column, lo: Column, hi: Column, abs_tol: float, ppm: float) -> Column:
    """Length of the union of clipped tolerance intervals over the window width."""
    p = ppm * 1e-6
    bounds = F.transform(ions, lambda x: F.struct(
        F.greatest(lo, F.least(x - abs_tol, x / (1 + p))).alias("left"),
        F.least(hi, F.greatest(x + abs_tol, x / (1 - p))).alias("right")))
    ordered = F.array_sort(F.filter(bounds, lambda b: b["right"] > b["left"]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("end"))
    walked = F.aggregate(ordered, start, lambda acc, b: F.struct(
        (acc["sum"] + F.greatest(F.lit(0.0), b["right"] - F.greatest(b["left"], acc["end"]))).alias("sum"),
        F.greatest(acc["end"], b["right"]).alias("end")))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), walked["sum"] / (hi - lo)))


def calibrated(intensity_ratio: Column, bin_index: Column, energy: Column, precursor: Column, theta: tuple[float, ...],
               n_bins: int, upper: float) -> Column:
    """Log-intensity after the temperature and tilt of one bin (before the group's maximum is subtracted)."""
    e = (energy_rounded(energy) - 40.0) / 20.0
    mz = (bin_index.cast("double") - 1.0) * F.lit(upper) / F.lit(n_bins - 1.0)
    r = mz / (mz + precursor) - 0.5
    temperature = F.lit(1.0) + F.lit(0.25) * F.tanh(F.lit(theta[0]) + F.lit(theta[1]) * e)
    tilt = F.lit(0.5) * F.tanh(F.lit(theta[2]) + F.lit(theta[3]) * e)
    return temperature * F.log(intensity_ratio) + tilt * r


def energy_rounded(energy: Column) -> Column:
    """Half-even to 5; NULL outside 20 to 60."""
    bucket = F.bround(energy / 5.0).cast("double") * 5.0
    return F.when(bucket.between(20.0, 60.0), bucket)


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform draw in (0, 1) decided by the text of ``parts`` alone, so a re-run task repeats it."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double")
    return (head + 0.5) / F.lit(float(2 ** 48))


def hashed_normal(*parts: Column | str) -> Column:
    """A standard normal draw from two hashed uniforms."""
    u, v = hashed_uniform(*parts, "u"), hashed_uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def augmented(peaks: Column, ident: Column, seed: str, drop_max: float = 0.3, sigma: float = 0.25,
              jitter: float = 5e-6) -> Column:
    """Random peak loss at a per-spectrum rate, lognormal intensities, relative m/z jitter; never left empty."""
    rate = hashed_uniform(seed, ident, "rate") * drop_max

    def noisy(p: Column, i: Column) -> Column:
        keep = hashed_uniform(seed, ident, i.cast("string"), "keep") > rate
        return F.struct(keep.alias("keep"), i.alias("pos"),
                        (p["mz"] * (1.0 + F.lit(jitter) * hashed_normal(seed, ident, i.cast("string"), "mz"))).alias("mz"),
                        (p["intensity"] * F.exp(F.lit(sigma) * hashed_normal(seed, ident, i.cast("string"), "it"))).alias("intensity"))

    def finish(all_peaks: Column) -> Column:
        kept = F.filter(all_peaks, lambda p: p["keep"])
        left = F.when(F.size(kept) > 0, kept).otherwise(F.slice(all_peaks, 1, 1))
        return F.transform(left, lambda p: F.struct(p["pos"].alias("pos"), p["mz"].alias("mz"), p["intensity"].alias("intensity")))

    return let(F.transform(peaks, noisy), finish)
