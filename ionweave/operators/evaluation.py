"""Tie-aware ranking metrics, paired comparisons, bootstrap intervals and refits."""


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates, ranking, skew

_HARMONIC = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, 101))])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n for any n: summed up to 100, beyond it the asymptotic series, exact there to a double's digits."""
    table = F.get(F.array(*[F.lit(float(x)) for x in _HARMONIC]), n.cast("int"))
    x = n.cast("double")
    series = F.log(x) + F.lit(float(np.euler_gamma)) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n < len(_HARMONIC), table).otherwise(series)


def truth_standings(df: DataFrame, query: str | list[str], scores: dict[str, str], label: str, ident: list[str], hot: DataFrame | str | None = None) -> DataFrame:
    """Standing of the truth under several scores at once; ``scores`` maps a column suffix to a score column.

    Per query with a truth: ``above`` rows with a higher score, ``tied`` rows with the same score
    (itself included) and ``before``, those of the ties that sort first by id. Two mergeable
    aggregates and one join; no query is ever sorted. Where ``hot`` says that queries are bounded, a window instead, so
    that rows which lie together already are not read and dealt twice.
    """
    key = F.struct(*ident)
    columns = sorted(set(scores.values()))
    # of several positives each score takes its own best
    best = {f"_t_{c}": F.struct(F.col(c).alias("s"), key.alias("k")) for c in columns}
    if hot is skew.BOUNDED:
        keys = [query] if isinstance(query, str) else query
        x = skew.with_stats(df.dropna(subset=keys), keys, {n: F.max(F.when(F.col(label) == 1, b)) for n, b in best.items()}, hot).dropna(subset=list(best))
    else:
        truth = df.filter(F.col(label) == 1).groupBy(query).agg(*[F.max(b).alias(n) for n, b in best.items()])
        x = df.join(truth, query)
    sums = []
    for suffix, score in scores.items():
        mine = F.col(f"_t_{score}")["s"]
        same = F.col(score) == mine
        sums += [F.sum((F.col(score) > mine).cast("bigint")).alias(f"above{suffix}"), F.sum(same.cast("bigint")).alias(f"tied{suffix}"),
                 F.sum((same & (key < F.col(f"_t_{score}")["k"])).cast("bigint")).alias(f"before{suffix}")]
    return x.groupBy(query).agg(*sums, F.count(F.lit(1)).alias("n"))


def truth_standing(df: DataFrame, query: str, score: str, label: str, ident: list[str]) -> DataFrame:
    """``truth_standings`` under a single score, without suffix."""
    return truth_standings(df, query, {"": score}, label, ident)


def reciprocal_rank(rank: Column, k: int = 25) -> Column:
    return F.when(rank <= k, 1 / rank).otherwise(F.lit(0.0))


def mrr_at_k(roster: DataFrame, standing: DataFrame, query: str, k: int = 25) -> DataFrame:
    """Reciprocal rank per roster query; a missing list or truth scores 0 and stays in the denominator."""
    joined = roster.select(query).join(standing, query, "left")
    rank = F.col("above") + F.col("before") + 1
    return joined.select(query, F.coalesce(reciprocal_rank(rank, k), F.lit(0.0)).alias("rr"))


def _expected_rr(above: Column, tied: Column, k: int) -> Column:
    """Expected reciprocal rank over uniform orders of the ties."""
    last = F.least(above + tied, F.lit(k))
    return F.when(above >= k, F.lit(0.0)).otherwise((harmonic(last) - harmonic(F.least(above, F.lit(k)))) / tied)


def expected_metrics(standing: DataFrame, query: str, k: int = 25) -> DataFrame:
    """Expectation over uniform tie orders of the reciprocal rank, top-1 and top-k."""
    rr = _expected_rr(F.col("above"), F.col("tied"), k)
    top1 = F.when(F.col("above") == 0, 1 / F.col("tied")).otherwise(F.lit(0.0))
    topk = F.greatest(F.lit(0), F.least(F.col("tied"), F.lit(k) - F.col("above"))) / F.col("tied")
    return standing.select(query, rr.alias("expected_rr"), top1.alias("expected_top1"), topk.alias("expected_topk"), "tied")


def pool_aware_ranks(df: DataFrame, query: str, identity: str, scores: dict[str, str], label: str, in_pool: str, k: int = 25, hot: DataFrame | str | None = None) -> DataFrame:
    """Rank of the truth among distinct identities, in-pool identities other than the truth not counted, under several scores at once.

    ``scores`` maps a suffix of ``rank`` and ``rr`` to a score column. ``hot`` is as in ``skew.with_stats``.
    """
    best = df.groupBy(query, identity).agg(*[F.max(c).alias(f"_s{n}") for n, c in scores.items()], F.max(label).alias("_y"), F.max(F.col(in_pool).cast("int")).alias("_p"))
    truth = {f"_t{n}": F.max(F.when(F.col("_y") == 1, F.struct(F.col(f"_s{n}").alias("s"), F.col(identity).alias("i")))) for n in scores}
    x = skew.with_stats(best, [query], truth, skew.find_hot(best, [query]) if hot is None else hot)
    sums, out = [], [F.col(query)]
    for n in scores:
        mine, top = F.col(f"_s{n}"), F.col(f"_t{n}")
        ahead = ((mine > top["s"]) | ((mine == top["s"]) & (F.col(identity) < top["i"]))) & (F.col("_p") == 0)
        sums += [F.max(top.isNotNull()).alias(f"_has{n}"), F.sum(F.coalesce(ahead, F.lit(False)).cast("bigint")).alias(f"_ahead{n}")]
        rank = F.when(F.col(f"_has{n}") & (F.col(f"_ahead{n}") < k), F.col(f"_ahead{n}") + 1)
        out += [rank.alias(f"rank{n}"), F.coalesce(1 / rank, F.lit(0.0)).alias(f"rr{n}")]
    return x.groupBy(query).agg(*sums).select(*out)


def pool_aware_rank(df: DataFrame, query: str, identity: str, score: str, label: str, in_pool: str, k: int = 25) -> DataFrame:
    """``pool_aware_ranks`` under a single score, without suffix."""
    return pool_aware_ranks(df, query, identity, {"": score}, label, in_pool, k)


def paired_delta(df: DataFrame, a: str, b: str, tolerance: float = 0.0) -> DataFrame:
    """Mean of both arms, mean difference and win/loss/tie counts (ties within ``tolerance``)."""
    d = F.col(b) - F.col(a)
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(d).alias("mean_delta"),
                  total(d > tolerance).alias("wins"), total(d < -tolerance).alias("losses"), total(F.abs(d) <= tolerance).alias("ties"))


BLOCKS = 1024
#: Cumulative Poisson(1) probabilities in units of 2 ** -32; a hash below the first draws 0, below the second 1, and so on.
_POISSON = np.floor(2.0 ** 32 * np.cumsum(np.exp(-1) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 11.0))]))).astype(np.int64)


def bootstrap_means(df: DataFrame, unit: str, value: str, replicates: int, seed: int, blocks: int = BLOCKS) -> DataFrame:
    """Mean of a resample of ``value`` per replicate, by the same method at every size.

    A hash of the unit deals units into ``blocks`` random blocks (summed map-side); a replicate weighs every block by
    its own hash-drawn Poisson(1) number. Blocks are random groups of equal expected size, so their resampled mean
    varies as that of the units does. Nothing comes to the driver, and a re-run draws the same.
    """
    block = F.pmod(F.conv(F.substring(F.md5(F.col(unit).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(blocks))
    sums = df.filter(F.col(value).isNotNull()).groupBy(block.alias("block")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "block")), 1, 8), 16, 10).cast("bigint")
    weight = sum((number >= F.lit(int(x))).cast("int") for x in _POISSON)
    weighed = drawn.select("replicate", "s", "n", weight.alias("w"))
    return weighed.groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))


def bootstrap_interval(df: DataFrame, unit: str, value: str, replicates: int = 5000, seed: int = 20261012, confidence: float = 0.9) -> DataFrame:
    """Percentile interval of the resampled mean, linear quantiles."""
    tail = (1 - confidence) / 2
    means = bootstrap_means(df, unit, value, replicates, seed)
    return means.agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"), F.count(F.lit(1)).alias("replicates"))


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for x >= 1: Stirling's series after a shift by eight."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * float(np.log(2 * np.pi))) + series - shift


def sign_test(counts: DataFrame, wins: str, losses: str) -> DataFrame:
    """Two-sided exact binomial p of each row's win/loss split.

    The tail is summed from its largest term down. Sixty standard deviations below it the terms
    are under the smallest double, so the sum stops there and its length grows with sqrt(n).
    """
    n, m = (F.col(wins) + F.col(losses)).cast("double"), F.least(wins, losses).cast("double")
    steps = F.least(m, F.ceil(60 * F.sqrt(n)) + 60).cast("bigint")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    folded = F.aggregate(F.sequence(F.lit(0).cast("bigint"), steps), start, lambda acc, k: F.struct(
        (acc["t"] * (m - k) / (n - m + k + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")))
    largest = log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * F.lit(float(np.log(2.0)))
    return counts.withColumn("sign_p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(largest) * folded["s"])))


def effect_diagnostics(df: DataFrame, delta: str) -> DataFrame:
    """Gain and loss mass, mean gain and loss, share of the three largest gains, leave-one-out range of the mean.

    Everything is read off the runs of equal differences, so both branches below share one exchange.
    """
    runs = df.filter(F.col(delta).isNotNull()).groupBy(F.col(delta).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    d, c = F.col("d"), F.col("c")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    gains, losses = F.sum(F.when(d > 0, c)), F.sum(F.when(d < 0, c))
    base = runs.agg(F.sum("c").alias("n"), zero(F.sum(F.when(d > 0, d * c))).alias("gain_mass"), zero(F.sum(F.when(d < 0, -d * c))).alias("loss_mass"),
                    zero(F.sum(F.when(d > 0, d * c)) / gains).alias("mean_gain"), zero(F.sum(F.when(d < 0, -d * c)) / losses).alias("mean_loss"),
                    F.sum(d * c).alias("_s"), F.max("d").alias("_hi"), F.min("d").alias("_lo"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)
    top = runs.filter(d > 0).orderBy(F.desc("d")).limit(3).withColumn("_used", F.coalesce(F.sum("c").over(order), F.lit(0)))
    top = top.agg(zero(F.sum(d * F.greatest(F.lit(0), F.least(c, 3 - F.col("_used"))))).alias("_top"))
    joined = base.join(F.broadcast(top))  # one row
    loo = lambda x: F.when(F.col("n") > 1, (F.col("_s") - F.col(x)) / (F.col("n") - 1))
    return joined.select("n", "gain_mass", "loss_mass", "mean_gain", "mean_loss",
                         F.when(F.col("gain_mass") > 0, F.col("_top") / F.col("gain_mass")).otherwise(0.0).alias("largest_three_share"),
                         loo("_hi").alias("loo_low"), loo("_lo").alias("loo_high"))


def input_slices(df: DataFrame, gate: str, confidence: str, analog: str, flag: str) -> DataFrame:
    """Slice flags from quantiles of the gate-open rows only."""
    open_rows = df.filter(F.col(gate))
    c = aggregates.exact_quantiles(open_rows, [], confidence, {"_c3": 1 / 3, "_c5": 0.2})
    a = aggregates.exact_quantiles(open_rows, [], analog, {"_a2": 0.5, "_a3": 1 / 3})
    x = df.join(F.broadcast(c)).join(F.broadcast(a))  # one row each
    out = (x.withColumn("s1", F.col(gate) & (F.col(confidence) <= F.col("_c3")) & (F.col(analog) <= F.col("_a2")))
           .withColumn("s2", F.col(gate) & F.col(flag))
           .withColumn("s3", F.col(gate) & (F.col(confidence) <= F.col("_c5")) & (F.col(analog) <= F.col("_a3"))))
    return out.drop("_c3", "_c5", "_a2", "_a3")


def balanced_weights(sizes: DataFrame, query: str, regime: str, rows: str, light: float = 0.30, heavy: float = 0.70) -> DataFrame:
    """``sizes`` (a row for each group of a query and a regime, with its number of ``rows``) with ``paired``, ``baseline`` and
    ``treatment``, the weights of each of its rows."""
    paired = sizes.groupBy(query).agg(((F.count(F.lit(1)) == 2) & (F.min(rows) == F.max(rows))).alias("paired"))
    base = F.when(F.col(regime) == 0, light).otherwise(heavy)
    scale = sizes.agg((F.sum(base * F.col(rows)) / F.sum(base)).alias("_scale"))
    return (sizes.withColumn("baseline", base).join(F.broadcast(scale)).join(paired, query)  # one-row scale
            .withColumn("treatment", F.col("baseline") / F.col(rows) * F.col("_scale")).drop("_scale"))


def query_balanced_weights(df: DataFrame, query: str, regime: str, light: float = 0.30, heavy: float = 0.70) -> DataFrame:
    """Regime base weight over group size, rescaled so the total equals that of the base weights; unpaired queries flagged."""
    sizes = df.groupBy(query, regime).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(balanced_weights(sizes, query, regime, "_n", light, heavy).drop("_n"), [query, regime])


def alpha_calibration(df: DataFrame, query: str, a: str, b: str, label: str, ident: list[str], fold: str, folds: int, grid: list[float], k: int = 25,
                      hot: DataFrame | str | None = None) -> DataFrame:
    """Per fold the alpha with the best expected reciprocal rank on the other folds, and its value on the fold itself.

    Scores are ``a + alpha * z(b)``, a column for each alpha, so that a row is neither copied nor dealt again; the grid is
    a row for each alpha only where a fold is one row. ``hot`` is as in ``skew.with_stats``.
    """
    z = ranking.with_z(df, [query], b, "_z", ranking.z_or_zero, hot)
    score = {f"_{i}": f"_s_{i}" for i in range(len(grid))}
    wide = z.select(query, fold, label, *ident, *[F.round(F.col(a) + F.lit(float(g)) * F.col("_z"), 9).alias(f"_s_{i}") for i, g in enumerate(grid)])
    m = truth_standings(wide, [query, fold], score, label, ident, hot)
    rr = [_expected_rr(F.col(f"above_{i}"), F.col(f"tied_{i}"), k) for i in range(len(grid))]
    sums = m.groupBy(fold).agg(*[F.sum(x).alias(f"_sum_{i}") for i, x in enumerate(rr)], F.count(F.lit(1)).alias("_n"))
    per = sums.select(fold, "_n", F.explode(F.array(*[F.struct(F.lit(float(g)).alias("alpha"), F.col(f"_sum_{i}").alias("_sum")) for i, g in enumerate(grid)])).alias("_g")).select(
        fold, "_g.alpha", "_g._sum", "_n")
    held = per.select(F.col(fold).alias("held"), "alpha", (F.col("_sum") / F.col("_n")).alias("holdout_mrr"))
    folds_ = F.array(*[F.lit(f) for f in range(folds)])
    train = per.withColumn("held", F.explode(F.filter(folds_, lambda f: f != F.col(fold)))).groupBy("held", "alpha").agg(
        (F.sum("_sum") / F.sum("_n")).alias("train_mrr"))
    best = train.groupBy("held").agg(F.max(F.struct(F.round("train_mrr", 12).alias("t"), (-F.col("alpha")).alias("na"))).alias("_b"))
    chosen = best.select("held", (-F.col("_b.na")).alias("alpha"), F.col("_b.t").alias("train_mrr"))
    return chosen.join(held, ["held", "alpha"])


def decision(df: DataFrame, floor: float, coverage: float) -> Column:
    """Adopt, reject or inconclusive from bounds fixed beforehand, over columns mean_delta, low, high and coverage."""
    return (F.when(F.col("coverage") < coverage, "inconclusive")
            .when((F.col("low") > 0) & (F.col("mean_delta") >= floor), "adopt")
            .when(F.col("high") < 0, "reject").otherwise("inconclusive"))
