"""The three end-to-end uses: identify query molecules, prepare training spectra, replay two ranking arms."""

from pyspark.sql import functions as F

from ..functions import peaks as pk
from ..functions import scalars
from ..operators import aggregates, evaluation, lists as li, skew
from ..sources import sinks
from .registry import query, table
from .stand_ins import ADDUCTS_SQL, PEAKS_SQL, SPECTRA_SQL, TRUTH_SQL, hot_lists, spectra, spectra_meta, truth_lists

BIT = "((('0x' || substr(sha256(c_name), 1 + 8 * (i // 32), 8))::BIGINT >> (i % 32)) & 1)"  # 64 bits of a fingerprint in two words


@query("workflow_identify_molecules", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL},
t AS (SELECT user_id, round(quantile_cont(nm, 0.5), 9) AS target FROM (SELECT user_id, (mz * abs_charge - shift_da) / n_mol AS nm FROM meta LEFT JOIN adducts USING (adduct)) WHERE nm > 0 GROUP BY user_id),
c AS (SELECT user_id, target, count(*) FILTER (c_acctbal BETWEEN target - target * (4000 / 1e6) AND target + target * (4000 / 1e6)) AS n, count(c_custkey) AS w FROM t LEFT JOIN customer ON c_acctbal > 0 AND c_acctbal BETWEEN target - target * (20000 / 1e6) AND target + target * (20000 / 1e6) GROUP BY ALL),
p AS (SELECT user_id, target, CASE WHEN n > 0 THEN 4000 WHEN w > 0 THEN 20000 END AS ppm, CASE WHEN n > 0 THEN n ELSE w END AS rows FROM c),
m AS (SELECT p.user_id, target, c_custkey, c_name, c_nationkey, c_acctbal FROM p JOIN customer ON c_acctbal BETWEEN target - target * (ppm / 1e6) AND target + target * (ppm / 1e6)),
s AS (SELECT m.user_id, c_custkey, c_nationkey, any_value(abs(c_acctbal - target)) AS dist, round(sum(embedding[i + 1]::DOUBLE * {BIT}), 9) AS score FROM m LEFT JOIN embeddings ON vec_id = m.user_id, (SELECT unnest(range(64)) AS i) GROUP BY ALL),
k AS (SELECT user_id, c_custkey, c_nationkey, CASE WHEN score IS NULL THEN -round(dist, 9) ELSE score END AS key FROM s),
b AS (SELECT user_id, c_nationkey, arg_max(c_custkey, (key, -c_custkey)) AS c_custkey, max(key) AS key FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY key DESC, c_custkey) AS rank FROM b)
SELECT t.user_id, coalesce(string_agg(c_custkey::VARCHAR, ';' ORDER BY rank), '') AS items FROM t LEFT JOIN r ON r.user_id = t.user_id AND rank <= 25 GROUP BY t.user_id""")
def identify(spark, d):
    spectra_rows = scalars.with_adduct(spectra_meta(spark, d)).select("user_id", scalars.neutral_mass(F.col("mz")).alias("nm")).filter("nm > 0 and not isnan(nm)")
    targets = aggregates.exact_quantiles(spectra_rows, ["user_id"], "nm", {"target": 0.5}).withColumn("target", F.round("target", 9))
    words = [F.conv(F.substring(F.sha2("c_name", 256), k, 8), 16, 10).cast("bigint") for k in (1, 9)]
    fp = words[0].bitwiseOR(F.call_function("shiftleft", words[1], F.lit(32)))
    cands = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal").select("c_custkey", "c_nationkey", "c_acctbal", fp.alias("fp"))
    logits = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("user_id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    asked = targets.join(logits, "user_id", "left")
    window = dict(query_mass="target", bank_mass="c_acctbal", narrow=4000.0, wide=20000.0, cap=None)
    # windows of any size: where a piece of one is, its best row of each identity is chosen, and no pair is shuffled
    scored = li.best_in_windows(asked, cands, query="user_id", identity="c_nationkey", row="c_custkey", logits="z", words="fp", n_bits=64, digits=9, **window)
    ranked = li.distinct_topk(scored, "user_id", "c_nationkey", "key", "c_custkey", 25)
    return sinks.ranked_submission(targets.select("user_id"), ranked, "user_id", "c_custkey", "rank", 25)


@query("workflow_prepare_spectra", f"""WITH {PEAKS_SQL},
f AS (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m FROM peaks WHERE mz <= 800 + vec_id % 200 + 1.5),
g AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id, floor(mz / 50) ORDER BY -it, i) AS br FROM f WHERE it >= 0.01::DOUBLE * m),
h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (br > 2)::INTEGER, -it, i) AS r FROM g), k AS (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m2 FROM h WHERE n <= 30 OR r <= 30)
SELECT vec_id, label, CASE WHEN ('0x' || substr(sha256('prep:' || label), 1, 16))::UBIGINT % 10000 < 8000 THEN 'train' ELSE 'dev' END AS split, count(*)::INTEGER AS n_peaks, round(sum(sqrt(it / m2)::FLOAT::DOUBLE), 5) AS total FROM k GROUP BY vec_id, label HAVING count(*) >= 3""")
def prepare(spark, d):
    prec = (F.lit(800) + F.col("vec_id") % 200).cast("double")
    split = F.when(scalars.hash_bucket(F.concat(F.lit("prep:"), F.col("label").cast("string")), 10000) < 8000, "train").otherwise("dev")
    ready = spectra(spark, d).select("vec_id", "label", split.alias("split"), pk.windowed(F.col("peaks"), prec, max_peaks=30, floor=0.01, per_window=2).alias("peaks"))
    path = sinks.scratch(spark, "prepared")
    ready.filter(F.size("peaks") >= 3).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    total = F.aggregate(F.transform("peaks", lambda p: p["intensity"].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", "label", "split", F.size("peaks").alias("n_peaks"), F.round(total, 5).alias("total"))


def arm_sql(name: str, weight: float) -> str:
    return f"""{name}z AS (SELECT *, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9) + {weight} * qty, 6) AS s FROM short WINDOW w AS (PARTITION BY q)),
{name}b AS (SELECT q, sup % 40 AS identity, max(s) AS s, max(y) AS y, max((tax < 0.02)::INTEGER) AS p FROM {name}z GROUP BY ALL), {name}t AS (SELECT q, max((s, identity)) AS t FROM {name}b WHERE y = 1 GROUP BY q),
{name} AS (SELECT q, CASE WHEN t IS NULL THEN 0 WHEN ahead < 25 THEN 1 / (ahead + 1) ELSE 0 END AS rr FROM (SELECT b.q, any_value(t) AS t, sum(coalesce(p = 0 AND (s > t[1] OR (s = t[1] AND identity < t[2])), false)::INTEGER) AS ahead FROM {name}b b LEFT JOIN {name}t USING (q) GROUP BY b.q))"""


@query("workflow_replay_two_arms", f"""WITH {TRUTH_SQL}, short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand, sup) AS a, row_number() OVER (PARTITION BY q ORDER BY tax DESC, cand, sup) AS b FROM rows) WHERE a <= 3 OR b <= 1),
{arm_sql('base', 0.0)}, {arm_sql('alt', 0.15)}
SELECT count(*) AS n, round(avg(base.rr), 8) AS mean_a, round(avg(alt.rr), 8) AS mean_b, round(avg(alt.rr - base.rr), 8) AS mean_delta, count(*) FILTER (alt.rr - base.rr > 1e-12) AS wins, count(*) FILTER (alt.rr - base.rr < -1e-12) AS losses,
 count(*) FILTER (abs(alt.rr - base.rr) <= 1e-12) AS ties FROM base JOIN alt USING (q)""")
def replay(spark, d):
    hot = hot_lists(spark, d)
    short = li.shortlist_union(truth_lists(spark, d, hot), "q", ["cand", "sup"], "score2", "tax", 3, 1, hot)
    # a shortlist holds at most four rows of a query; both arms share it, and nothing is dealt again
    blended = li.prior_blends(short, "q", "score", "qty", {"base": 0.0, "alt": 0.15}, skew.BOUNDED)
    rows = blended.select("q", (F.col("sup") % 40).alias("identity"), F.round("base", 6).alias("base"), F.round("alt", 6).alias("alt"), "y", (F.col("tax") < 0.02).alias("in_pool"))
    ranks = evaluation.pool_aware_ranks(rows, "q", "identity", {"_a": "base", "_b": "alt"}, "y", "in_pool", hot=skew.BOUNDED)
    out = evaluation.paired_delta(ranks, "rr_a", "rr_b", 1e-12)
    return out.select("n", *[F.round(c, 8).alias(c) for c in ("mean_a", "mean_b", "mean_delta")], "wins", "losses", "ties")
