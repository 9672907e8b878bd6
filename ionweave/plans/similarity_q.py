"""Spectral similarity and assignment M1-M9."""

from pyspark.sql import functions as F

from ..functions import peaks as pk
from ..operators import sampling, similarity, skew
from .registry import query, table
from .stand_ins import PEAKS_SQL, peaks_long, sample_sql, spectra

PREP_SQL = f"""{PEAKS_SQL},
pr0 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -it, mz, i) AS r FROM (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m FROM peaks) WHERE it >= 0.02::DOUBLE * m),
pr1 AS (SELECT vec_id, label, mz, i, sqrt(it) / sqrt(sum(sqrt(it) * sqrt(it)) OVER (PARTITION BY vec_id)) AS v FROM pr0 WHERE r <= 40),
prep AS (SELECT vec_id, any_value(label) AS label, list(mz ORDER BY mz, i) AS ms, list(v ORDER BY mz, i) AS vs, len(list(mz)) AS n FROM pr1 GROUP BY vec_id),
nm AS (SELECT vec_id, 500 + 100 * embedding[1]::DOUBLE AS nm FROM embeddings)"""


def walk_sql(name: str, shift: str) -> str:
    return f"""{name} AS (SELECT q, c, 1 AS i, 1 AS j, 0.0::DOUBLE AS dot FROM pairs
 UNION ALL SELECT w.q, w.c, CASE WHEN a.ms[i] - {shift} - b.ms[j] > 2.0::DOUBLE THEN i ELSE i + 1 END, CASE WHEN a.ms[i] - {shift} - b.ms[j] < -2.0::DOUBLE THEN j ELSE j + 1 END,
   dot + CASE WHEN abs(a.ms[i] - {shift} - b.ms[j]) <= 2.0::DOUBLE THEN a.vs[i] * b.vs[j] ELSE 0 END
 FROM {name} w JOIN prep a ON a.vec_id = w.q JOIN prep b ON b.vec_id = w.c JOIN nm x ON x.vec_id = w.q JOIN nm y ON y.vec_id = w.c WHERE i <= a.n AND j <= b.n)"""


def pairs_sql(condition: str) -> str:
    return f"""pairs AS (SELECT q.vec_id AS q, c.vec_id AS c FROM nm q JOIN nm c ON {condition} AND q.vec_id <> c.vec_id)"""


NARROW = "c.nm BETWEEN q.nm - q.nm * (150 / 1e6) AND q.nm + q.nm * (150 / 1e6)"
SCORES_SQL = f"""WITH RECURSIVE {PREP_SQL}, {{pairs}}, {walk_sql('dir', '0')}, {walk_sql('shf', '(x.nm - y.nm)')},
sim AS (SELECT q, c, max(d.dot) AS direct, max(s.dot) AS moved FROM (SELECT q, c, max(dot) AS dot FROM dir GROUP BY q, c) d JOIN (SELECT q, c, max(dot) AS dot FROM shf GROUP BY q, c) s USING (q, c) GROUP BY q, c)"""


def library(spark, d):
    return similarity.prepared(spectra(spark, d), "peaks", 0.02, 40).select("vec_id", "label", "mz", "it")


def masses(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select(
        "vec_id", (F.lit(500) + 100 * F.get("embedding", F.lit(0)).cast("double")).alias("nm"))


def scored_pairs(spark, d, ids):
    """Similarity of (q, c) id pairs; the peak arrays join after the pair list is known."""
    lib = library(spark, d)
    nm = masses(spark, d)
    side = lambda p, key: lib.join(nm, "vec_id").select(F.col("vec_id").alias(key), F.col("label").alias(p + "_label"), F.col("mz").alias(p + "_mz"),
                                                        F.col("it").alias(p + "_it"), F.col("nm").alias(p + "_nm"))
    full = ids.join(side("q", "q"), "q").join(side("c", "c"), "c")
    score = similarity.greedy_cosine(F.col("q_mz"), F.col("q_it"), F.col("c_mz"), F.col("c_it"), F.col("q_nm") - F.col("c_nm"), tol=2.0)
    return full.select("q", "c", "c_label", score.alias("sim"))


def window_cosines(spark, d, modified, key=None, keep=None):
    """Similarities of the pairs within 150 ppm, found where their masses meet."""
    rows = library(spark, d).join(masses(spark, d), "vec_id")
    side = lambda df, name: df.withColumnRenamed("vec_id", name)
    bank = rows if keep is None else rows.filter(keep)
    return similarity.window_cosines(side(rows, "q"), side(bank, "c"), query="q", cand="c", mass="nm", mz="mz", it="it", ppm=150.0, tol=2.0, modified=modified, key=key)


@query("M1_greedy_cosine", SCORES_SQL.format(pairs=pairs_sql(NARROW)) + " SELECT q, c, round(direct, 9) AS cosine FROM sim")
def m1(spark, d):
    return window_cosines(spark, d, modified=False).select("q", "c", F.round("sim", 9).alias("cosine"))


MODIFIED = "CASE WHEN abs(x.nm - y.nm) < 0.001 THEN direct ELSE greatest(direct, moved) END"


@query("M2_modified_cosine", SCORES_SQL.format(pairs=pairs_sql(NARROW)) + f" SELECT q, c, round({MODIFIED}, 9) AS cosine FROM sim JOIN nm x ON x.vec_id = q JOIN nm y ON y.vec_id = c")
def m2(spark, d):
    return window_cosines(spark, d, modified=True).select("q", "c", F.round("sim", 9).alias("cosine"))


@query("M3_library_best_by_key", SCORES_SQL.format(pairs=pairs_sql(NARROW)) + " SELECT q, label AS identity, round(max(direct), 9) AS best FROM sim JOIN prep ON vec_id = c WHERE label <> 3 GROUP BY ALL")
def m3(spark, d):
    scored = window_cosines(spark, d, modified=False, key="label", keep=F.col("label") != 3)
    best = similarity.best_by_key(scored, "q", "label", "sim")
    return best.select("q", F.col("label").alias("identity"), F.round("best", 9).alias("best"))


ANALOG_PAIRS = sample_sql("(SELECT vec_id AS q, nm AS m FROM nm)", "(SELECT vec_id AS c, nm AS m FROM nm)", 5.0, 6, "analog") + ", pairs AS (SELECT q, c FROM drawn)"


@query("M4_analog_best_by_key", SCORES_SQL.format(pairs=ANALOG_PAIRS) + f" SELECT q, label AS identity, round(max({MODIFIED}), 9) AS best FROM sim JOIN prep ON vec_id = c JOIN nm x ON x.vec_id = q JOIN nm y ON y.vec_id = c GROUP BY ALL")
def m4(spark, d):
    nm = masses(spark, d)
    q, c = nm.select(F.col("vec_id").alias("q"), F.col("nm").alias("qm")), nm.select(F.col("vec_id").alias("c"), F.col("nm").alias("cm"))
    ids = sampling.sampled_window(q, c, query_mass="qm", bank_mass="cm", query_id="q", bank_id="c", half_width=5.0, size=6, tag="analog")
    best = similarity.best_by_key(scored_pairs(spark, d, ids.select("q", "c")), "q", "c_label", "sim")
    return best.select("q", F.col("c_label").alias("identity"), F.round("best", 9).alias("best"))


@query("M5_entropy_similarity_binned", f"""WITH {PEAKS_SQL},
b AS (SELECT vec_id, floor(mz / 5)::BIGINT AS bin, max(it) AS v FROM peaks WHERE it > 0 GROUP BY ALL), n AS (SELECT vec_id, bin, v / sum(v) OVER (PARTITION BY vec_id) AS p FROM b),
j AS (SELECT coalesce(a.vec_id, b.vec_id - 1) AS vec_id, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb FROM n a FULL JOIN n b ON b.vec_id = a.vec_id + 1 AND a.bin = b.bin)
SELECT vec_id, round(1 - (2 * sum(CASE WHEN pa + pb > 0 THEN -(pa + pb) / 2 * ln((pa + pb) / 2) ELSE 0 END) - sum(CASE WHEN pa > 0 THEN -pa * ln(pa) ELSE 0 END)
  - sum(CASE WHEN pb > 0 THEN -pb * ln(pb) ELSE 0 END)) / ln(4), 9) AS similarity FROM j GROUP BY vec_id HAVING sum(pa) > 0 AND sum(pb) > 0""")
def m5_binned(spark, d):
    rows = peaks_long(spark, d).select("vec_id", F.floor(F.col("mz") / 5).alias("bin"), "it")
    out = similarity.binned_entropy_similarity(rows, rows.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "bin", "it")
    return out.withColumn("similarity", F.round("similarity", 9))


MATCH_SQL = f"""WITH RECURSIVE {PEAKS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -it, i) AS r FROM (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m FROM peaks WHERE it > 0) WHERE it >= 0.05::DOUBLE * m),
u AS (SELECT vec_id, mz, i, it / sum(it) OVER (PARTITION BY vec_id) AS p FROM f WHERE r <= 20),
e AS (SELECT vec_id, -sum(p * ln(p)) AS h FROM u GROUP BY vec_id),
w0 AS (SELECT vec_id, mz, i, CASE WHEN h < 3 THEN power(p, 0.25 + 0.25 * h) ELSE p END AS p FROM u JOIN e USING (vec_id)),
w AS (SELECT vec_id, mz, i, p / sum(p) OVER (PARTITION BY vec_id) AS p FROM w0),
s AS (SELECT vec_id, list(mz ORDER BY mz, i) AS ms, list(p ORDER BY mz, i) AS ps, list(mz ORDER BY round(p, 14) DESC, mz, i) AS om, list(p ORDER BY round(p, 14) DESC, mz, i) AS op, -sum(p * ln(p)) AS h, count(*) AS n FROM w GROUP BY vec_id),
wk AS (SELECT vec_id AS q, 1 AS k, []::BIGINT[] AS used, 0.0::DOUBLE AS hm FROM s WHERE vec_id + 1 IN (SELECT vec_id FROM s)
 UNION ALL SELECT q, k + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, hm - x * ln(x) FROM (
  SELECT q, k, used, hm, best, (op[k] + coalesce(bp[best], 0)) / 2 AS x FROM (
   SELECT wk.q, wk.k, wk.used, wk.hm, a.op, b.ps AS bp, list_sort(list_transform(list_filter(range(1, b.n + 1), lambda t: NOT list_contains(wk.used, t) AND abs(b.ms[t] - a.om[wk.k]) <= 3.0::DOUBLE),
     lambda t: {{'d': abs(b.ms[t] - a.om[wk.k]), 't': t}}))[1].t AS best FROM wk JOIN s a ON a.vec_id = wk.q JOIN s b ON b.vec_id = wk.q + 1 WHERE wk.k <= a.n))),
fin AS (SELECT q, arg_max(used, k) AS used, arg_max(hm, k) AS hm FROM wk GROUP BY q)
SELECT q AS vec_id, round(1 - (2 * (hm + list_sum(list_transform(range(1, b.n + 1), lambda t: CASE WHEN list_contains(used, t) THEN 0 ELSE -(b.ps[t] / 2) * ln(b.ps[t] / 2) END))) - a.h - b.h) / ln(4), 8) AS similarity
FROM fin JOIN s a ON a.vec_id = q JOIN s b ON b.vec_id = q + 1"""


def entropy_pairs(spark, d):
    clean = spectra(spark, d).withColumn("p", pk.clean_floor_topk(F.col("peaks"), 0.05, 20))
    clean = clean.select("vec_id", F.transform("p", lambda x: x["mz"]).alias("m"), F.transform("p", lambda x: x["intensity"]).alias("v"))
    other = clean.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    sim = similarity.entropy_similarity(F.col("m"), F.col("v"), F.col("m2"), F.col("v2"), tol=3.0)
    return clean.join(other, "vec_id").select("vec_id", sim.alias("similarity"))


@query("M5_entropy_similarity", MATCH_SQL)
def m5(spark, d):
    return entropy_pairs(spark, d).withColumn("similarity", F.round("similarity", 8))


@query("M6_condition_mean_similarity", f"""WITH sims AS ({MATCH_SQL})
SELECT q, cand, round(avg(similarity), 8) AS mean_similarity, count(similarity) AS n_scored FROM (SELECT DISTINCT vec_id // 10 AS q, vec_id % 3 AS cand FROM embeddings)
LEFT JOIN (SELECT vec_id // 10 AS q, vec_id % 3 AS cand, similarity FROM sims WHERE similarity > 0.5) USING (q, cand) GROUP BY ALL""")
def m6(spark, d):
    keys = [F.floor(F.col("vec_id") / 10).alias("q"), (F.col("vec_id") % 3).alias("cand")]
    roster = spectra(spark, d).select(*keys).distinct()
    scores = entropy_pairs(spark, d).withColumn("similarity", F.round("similarity", 8)).filter("similarity > 0.5").select(*keys, "similarity")
    out = similarity.condition_means(roster, scores, ["q", "cand"], "similarity")
    return out.withColumn("mean_similarity", F.round("mean_similarity", 8))


VIEWS_SQL = f"""{PEAKS_SQL},
v AS (SELECT vec_id, list(mz ORDER BY mz, i) AS ms, list(sqrt(it) ORDER BY mz, i) AS ws, count(*) AS n FROM peaks WHERE mz BETWEEN 200 AND 900 GROUP BY vec_id),
ions AS (SELECT vec_id // 3 AS g, list(DISTINCT mz ORDER BY mz) AS xs FROM peaks WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY vec_id // 3) AND mz BETWEEN 200 AND 900 GROUP BY 1),
cands AS (SELECT vec_id, vec_id // 3 AS g, k AS cand, ms, ws, v.n, xs, len(xs) AS ni FROM v, (VALUES (1), (2)) t(k) JOIN ions ON ions.g = vec_id // 3 + k),
dp AS (SELECT vec_id, cand, 1 AS k, list_transform(range(0, ni + 1), lambda j: 0.0::DOUBLE) AS prev, 0.0::DOUBLE AS ind FROM cands
 UNION ALL SELECT vec_id, cand, k + 1, list_transform(range(1, ni + 2), lambda j: list_max(step[1:j])), ind + CASE WHEN len(list_filter(xs, lambda x: abs(ms[k] - x) <= greatest(2.0::DOUBLE, ms[k] * (1000 * 1e-6)))) > 0 THEN ws[k] ELSE 0 END FROM (
  SELECT dp.vec_id, dp.cand, dp.k, dp.ind, c.ni, c.xs, c.ms, c.ws, list_transform(range(1, c.ni + 2), lambda j: CASE WHEN j = 1 THEN 0.0::DOUBLE WHEN abs(c.ms[dp.k] - c.xs[j - 1]) <= greatest(2.0::DOUBLE, c.ms[dp.k] * (1000 * 1e-6))
    THEN greatest(dp.prev[j], dp.prev[j - 1] + c.ws[dp.k]) ELSE dp.prev[j] END) AS step FROM dp JOIN cands c USING (vec_id, cand) WHERE dp.k <= c.n)),
ex AS (SELECT vec_id, cand, arg_max(prev, k)[-1] AS best, arg_max(ind, k) AS ind FROM dp GROUP BY vec_id, cand),
sc AS (SELECT vec_id, g, cand, ni, best / list_sum(ws) AS assignment, ind / list_sum(ws) AS independent FROM ex JOIN cands USING (vec_id, cand))"""


def view_scores(spark, d):
    sp = spectra(spark, d)
    inside = F.filter(pk.by_mz(F.col("peaks")), lambda p: p["mz"].between(200, 900))
    views = sp.select("vec_id", F.floor(F.col("vec_id") / 3).alias("g"), inside.alias("p"))
    views = views.select("vec_id", "g", F.transform("p", lambda x: x["mz"]).alias("m"), F.transform("p", lambda x: F.sqrt(x["intensity"])).alias("w"))
    # the first spectrum of a later group supplies a candidate's ion hypotheses
    first = views.groupBy("g").agg(F.min_by("m", "vec_id").alias("ions"))
    ions = first.select(F.col("g").alias("ion_g"), F.array_distinct("ions").alias("ions"))
    fan = views.withColumn("cand", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("ion_g", F.col("g") + F.col("cand"))
    both = fan.join(ions, "ion_g")
    out = both.withColumn("e", similarity.explained(F.col("ions"), F.col("m"), F.col("w"), 2.0, 1000.0))
    return out.select("vec_id", "g", "cand", "ions", F.size("ions").alias("n_ions"), "e.assignment", "e.independent")


@query("M7_assignment_explain", f"WITH RECURSIVE {VIEWS_SQL} SELECT vec_id, cand, round(assignment, 9) AS assignment, round(independent, 9) AS independent FROM sc")
def m7(spark, d):
    return view_scores(spark, d).select("vec_id", "cand", F.round("assignment", 9).alias("assignment"), F.round("independent", 9).alias("independent"))


COVER_SQL = """cb AS (SELECT g, greatest(200.0::DOUBLE, least(x - 2, x / (1 + 1000 * 1e-6))) AS l, least(900.0::DOUBLE, greatest(x + 2, x / (1 - 1000 * 1e-6))) AS r FROM (SELECT g, unnest(xs) AS x FROM ions)),
co AS (SELECT *, max(r) OVER (PARTITION BY g ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM cb WHERE r > l),
cov AS (SELECT g, sum(greatest(0, r - greatest(l, coalesce(e, -1e300)))) / 700 AS coverage FROM co GROUP BY g)"""


@query("M8_consensus_features", f"""WITH RECURSIVE {VIEWS_SQL}, {COVER_SQL},
f AS (SELECT sc.g, cand, ni, assignment, assignment - coverage AS excess, greatest(0, independent - assignment) AS gap, coverage FROM sc JOIN cov ON cov.g = sc.g + cand)
SELECT g, cand, round(max(assignment), 8) AS assignment_max, round(quantile_cont(assignment, 0.5), 8) AS assignment_median, round(quantile_cont(assignment, 0.25), 8) AS assignment_q25,
 round(avg(excess), 8) AS uniform_excess_mean, round(quantile_cont(excess, 0.25), 8) AS uniform_excess_q25, round(max(gap), 8) AS reuse_gap_max, round(avg(coverage), 8) AS coverage_mean,
 round(ln(1 + max(ni)), 8) AS hypothesis_count_log1p, count(*) AS view_count FROM f GROUP BY g, cand""")
def m8(spark, d):
    v = view_scores(spark, d).withColumn("coverage", pk.covered_fraction(F.col("ions"), F.lit(200.0), F.lit(900.0), 2.0, 1000.0))
    # a group is three consecutive spectra, so its views are bounded
    out = similarity.consensus_features(v, ["g", "cand"], "n_ions", hot=skew.BOUNDED)
    return out.select("g", "cand", "view_count", *[F.round(c, 8).alias(c) for c in out.columns if c not in ("g", "cand", "view_count")])


@query("M9_raw_column_ablation", f"""WITH RECURSIVE {VIEWS_SQL},
s AS (SELECT g, cand, avg(assignment) AS old, max(assignment) AS new FROM sc GROUP BY g, cand HAVING max(assignment) > 0.2),
b AS (SELECT g, cand, avg(assignment) + CASE WHEN g % 5 = 0 THEN 1e-3 ELSE 0 END AS frag FROM sc GROUP BY g, cand)
SELECT g, cand, round(new, 8) AS frag, coalesce(abs(frag - old) <= 1e-8, false) AS parity_ok FROM b LEFT JOIN s USING (g, cand)""")
def m9(spark, d):
    v = view_scores(spark, d)
    base = v.groupBy("g", "cand").agg(F.avg("assignment").alias("frag")).withColumn(
        "frag", F.col("frag") + F.when(F.col("g") % 5 == 0, 1e-3).otherwise(0.0))
    new = v.groupBy("g", "cand").agg(F.avg("assignment").alias("old"), F.max("assignment").alias("new")).filter("new > 0.2")
    return similarity.column_ablation(base, new, ["g", "cand"], "frag", "old", "new").withColumn("frag", F.round("frag", 8))
