"""Aggregations G1-G20."""

from pyspark.sql import functions as F

from ..functions.scalars import neutral_mass, with_adduct
from ..operators import aggregates as g
from ..operators import sweep
from .joins_q import j4
from .registry import ORACLES, query, table
from .stand_ins import ADDUCTS_SQL, BANK_SQL, BITS_SQL, SPECTRA_SQL, TRUTH_SQL, bank, spectra_meta, truth_lists


@query("G1_row_counts_by", f"""WITH {SPECTRA_SQL}
SELECT 'adduct' AS dimension, adduct AS value, count(*) AS n_rows FROM meta GROUP BY adduct
UNION ALL SELECT 'energy', energy::VARCHAR, count(*) FROM meta GROUP BY energy UNION ALL SELECT 'mode', mode, count(*) FROM meta GROUP BY mode""")
def g1(spark, d):
    return g.counts_by_each(spectra_meta(spark, d).select("adduct", "energy", "mode"), ["adduct", "energy", "mode"])


@query("G2_top_n_counts", f"WITH {SPECTRA_SQL} SELECT energy, count(*) AS n_rows FROM meta GROUP BY energy ORDER BY n_rows DESC, energy LIMIT 20")
def g2(spark, d):
    return g.top_counts(spectra_meta(spark, d), "energy", 20)


COVERAGE_SQL = f"""{SPECTRA_SQL}, s AS (SELECT DISTINCT user_id || '-' || (energy % 20) AS ident, event_type = 'click' AS direct,
  CASE event_type WHEN 'view' THEN 'ammonium' WHEN 'purchase' THEN 'dehydrated' END AS proxy, energy FROM meta),
t AS (SELECT ident, proxy, count(DISTINCT energy) AS ne FROM s WHERE proxy IS NOT NULL GROUP BY 1, 2),
i AS (SELECT ident, bool_or(direct) AS direct FROM s GROUP BY 1),
m AS (SELECT ident, direct, count(proxy) AS types, coalesce(bool_or(proxy = 'ammonium'), false) AS am, coalesce(bool_or(proxy = 'dehydrated'), false) AS de,
  coalesce(bool_or(ne >= 2 AND proxy = 'ammonium'), false) AS m_am, coalesce(bool_or(ne >= 2 AND proxy = 'dehydrated'), false) AS m_de FROM i LEFT JOIN t USING (ident) GROUP BY 1, 2)"""


def coverage(spark, d):
    df = spectra_meta(spark, d).select(F.concat_ws("-", "user_id", F.col("energy") % 20).alias("ident"), "event_type",
                                       F.col("energy").cast("string").alias("sig"))
    return g.identity_coverage(df, "ident", "event_type", "sig", "click", {"view": "ammonium", "purchase": "dehydrated"})


@query("G3_identity_coverage", f"""WITH {COVERAGE_SQL}
SELECT count(*) FILTER (direct) AS with_direct, count(*) FILTER (NOT direct) AS without_direct, count(*) FILTER (NOT direct AND types > 0) AS without_with_any_proxy,
 count(*) FILTER (NOT direct AND am) AS without_with_ammonium, count(*) FILTER (NOT direct AND de) AS without_with_dehydrated,
 count(*) FILTER (NOT direct AND types >= 2) AS without_with_both, count(*) FILTER (NOT direct AND (m_am OR m_de)) AS without_with_two_energies FROM m""")
def g3(spark, d):
    return coverage(spark, d)[0]


@query("G3_multi_energy_by_proxy", f"""WITH {COVERAGE_SQL}
SELECT 'ammonium' AS proxy, count(*) FILTER (NOT direct AND m_am) AS multi_energy_identities FROM m
UNION ALL SELECT 'dehydrated', count(*) FILTER (NOT direct AND m_de) FROM m""")
def g3_proxy(spark, d):
    return coverage(spark, d)[1]


@query("G4_equal_value_groups", f"WITH {BANK_SQL} SELECT mass, min(row_id) AS first_row, count(*) AS multiplicity FROM bank GROUP BY mass HAVING count(*) > 1")
def g4(spark, d):
    return g.equal_value_groups(bank(spark, d).select("mass", "row_id"), "mass", "row_id")


@query("G5_histogram_with_distinct", """
WITH b AS (SELECT floor(c_acctbal / 0.5)::BIGINT AS bin, count(*) AS n_rows, count(DISTINCT c_acctbal) AS n_distinct FROM customer GROUP BY 1)
SELECT s.bin, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct FROM (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) + 1 FROM b))) AS bin) s LEFT JOIN b USING (bin)""")
def g5(spark, d):
    return g.histogram_with_distinct(table(spark, d, "customer", "c_acctbal"), "c_acctbal", 0.5)


@query("G6_bank_profile", f"""WITH {BANK_SQL}, r AS (SELECT mass, count(*) AS n FROM bank GROUP BY mass)
SELECT min(mass) AS min_mass, max(mass) AS max_mass, sum(n)::BIGINT AS n_rows, count(*) AS distinct_masses, sum(n - 1)::BIGINT AS extra_duplicates, max(n) AS max_multiplicity FROM r""")
def g6(spark, d):
    return g.bank_profile(bank(spark, d).select("mass"), "mass")


@query("G7_condition_multiplicity", """
SELECT l_returnflag, l_linestatus, l_discount, l_tax, CASE WHEN l_quantity > 40 THEN NULL ELSE l_linenumber END AS line, count(*) AS occurrences FROM lineitem GROUP BY ALL""")
def g7(spark, d):
    df = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity", "l_linenumber")
    line = F.when(F.col("l_quantity") <= 40, F.col("l_linenumber")).alias("line")
    return df.groupBy("l_returnflag", "l_linestatus", "l_discount", "l_tax", line).agg(F.count(F.lit(1)).alias("occurrences"))


@query("G8_reference_evidence", f"""WITH {BANK_SQL},
st AS (SELECT p_partkey AS row_id, p_name || '|' || p_type AS key, p_retailprice AS mass FROM part),
rec AS (SELECT key, CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE l_orderkey::VARCHAR END AS sid, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey::VARCHAR END AS inst,
  l_returnflag, l_linestatus, l_discount FROM lineitem JOIN st ON row_id = l_partkey),
ev AS (SELECT key, count(*) AS occurrences, count(DISTINCT nullif(sid, '')) AS distinct_ids, count(DISTINCT inst) AS institutions,
  count(DISTINCT (l_returnflag, l_linestatus, l_discount)) AS conditions FROM rec GROUP BY key),
k AS (SELECT key, count(*) AS key_multiplicity, count(DISTINCT mass) > 1 AS mass_conflict FROM st GROUP BY key),
runs AS (SELECT mass AS bm, count(*) AS n FROM bank GROUP BY mass)
SELECT st.row_id, st.key, occurrences, distinct_ids, institutions, conditions, key_multiplicity, mass_conflict,
 (SELECT sum(n)::BIGINT FROM runs WHERE bm BETWEEN mass - mass * (30 / 1e6) AND mass + mass * (30 / 1e6)) AS rows_30,
 (SELECT sum(n)::BIGINT FROM runs WHERE bm BETWEEN mass - mass * (120 / 1e6) AND mass + mass * (120 / 1e6)) AS rows_120,
 (SELECT sum(n)::BIGINT FROM runs WHERE bm BETWEEN mass - mass * (240 / 1e6) AND mass + mass * (240 / 1e6)) AS rows_240
FROM st JOIN ev USING (key) JOIN k USING (key)""")
def g8(spark, d):
    st = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_retailprice").select(
        F.col("p_partkey").alias("row_id"), F.concat_ws("|", "p_name", "p_type").alias("key"), F.col("p_retailprice").alias("mass"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    rec = rows.join(st.select(F.col("row_id").alias("l_partkey"), "key"), "l_partkey")
    rec = rec.withColumn("sid", F.when(F.col("l_orderkey") % 10 == 0, "").otherwise(F.col("l_orderkey").cast("string")))
    rec = rec.withColumn("inst", F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string")))
    windows = sweep.window_counts(st.select("row_id", F.col("mass").alias("qm")), bank(spark, d), query_mass="qm", bank_mass="mass",
                                      ppms=[30.0, 120.0, 240.0]).drop("qm")
    return g.reference_evidence(rec, st, windows, key="key", spectrum_id="sid", institution="inst",
                                condition=["l_returnflag", "l_linestatus", "l_discount"], mass="mass", row="row_id").drop("mass")


@query("G9_duplicate_flagging", """
WITH f AS (SELECT user_id, min(event_id) AS fr, arg_min(event_type, event_id) AS fk FROM events GROUP BY 1)
SELECT event_id, fr < event_id AS seen_before, fr < event_id AND fk <> event_type AS seen_with_other_key FROM events JOIN f USING (user_id)""")
def g9(spark, d):
    return g.duplicate_flags(table(spark, d, "events", "event_id", "user_id", "event_type"), "event_id", "user_id", "event_type").select(
        "event_id", "seen_before", "seen_with_other_key")


@query("G10_median_target_mass", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL},
n AS (SELECT user_id, (mz * abs_charge - shift_da) / n_mol AS nm FROM meta LEFT JOIN adducts USING (adduct))
SELECT user_id, round(quantile_cont(nm, 0.5), 6) AS median_mass FROM n WHERE nm > 0 GROUP BY user_id""")
def g10(spark, d):
    df = with_adduct(spectra_meta(spark, d)).select("user_id", neutral_mass(F.col("mz")).alias("nm")).filter("nm > 0 and not isnan(nm)")
    return g.exact_quantiles(df, ["user_id"], "nm", {"median_mass": 0.5}).select("user_id", F.round("median_mass", 6).alias("median_mass"))


@query("G11_max_by_key", "SELECT l_orderkey, l_suppkey % 10 AS identity, max(l_extendedprice) AS best FROM lineitem GROUP BY ALL")
def g11(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_extendedprice")
    return df.groupBy("l_orderkey", (F.col("l_suppkey") % 10).alias("identity")).agg(F.max("l_extendedprice").alias("best"))


@query("G12_role_counts", """
WITH e AS (SELECT event_type AS library, CASE WHEN user_id % 10 < 8 THEN 'optimizer' WHEN user_id % 10 = 8 THEN 'checkpoint' ELSE 'test' END AS role, user_id, value > 1 AS observed FROM events)
SELECT coalesce(library, '*') AS library, coalesce(role, '*') AS role, count(*) AS spectra, count(DISTINCT user_id) AS structures, count(DISTINCT CASE WHEN observed THEN user_id END) AS observed_structures FROM e GROUP BY CUBE (library, role)""")
def g12(spark, d):
    u = F.col("user_id") % 10
    df = table(spark, d, "events", "event_type", "user_id", "value").select(
        F.col("event_type").alias("library"), F.when(u < 8, "optimizer").when(u == 8, "checkpoint").otherwise("test").alias("role"),
        "user_id", (F.col("value") > 1).alias("observed"))
    out = df.cube("library", "role").agg(F.count(F.lit(1)).alias("spectra"), F.count_distinct("user_id").alias("structures"),
                                         F.count_distinct(F.when(F.col("observed"), F.col("user_id"))).alias("observed_structures"))
    return out.withColumn("library", F.coalesce("library", F.lit("*"))).withColumn("role", F.coalesce("role", F.lit("*")))


@query("G13_component_histogram", "SELECT group_size, count(*) AS n_groups FROM (SELECT count(*) AS group_size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def g13(spark, d):
    return g.count_of_counts(table(spark, d, "lineitem", "l_orderkey"), ["l_orderkey"])


@query("G14_group_macro_mean", "SELECT round(avg(m), 6) AS macro_mean, count(*) AS n_groups FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_orderkey)")
def g14(spark, d):
    return g.macro_mean(table(spark, d, "lineitem", "l_orderkey", "l_discount"), ["l_orderkey"], F.col("l_discount")).withColumn(
        "macro_mean", F.round("macro_mean", 6))


@query("G15_energy_balanced_loss", f"""WITH {BITS_SQL},
m AS (SELECT vec_id // 6 AS mol, vec_id % 3 AS e, i, avg(x * 4) AS z FROM bits GROUP BY ALL),
q AS (SELECT mol, e, ln(sum(exp(z))) - max(CASE WHEN i = mol % 64 THEN z END) AS l FROM m GROUP BY ALL),
p AS (SELECT mol, ln(sum(exp(z))) - max(CASE WHEN i = mol % 64 THEN z END) AS l FROM (SELECT mol, i, avg(z) AS z FROM m GROUP BY ALL) GROUP BY ALL)
SELECT mol, round(el, 8) AS energy_loss, round(p.l, 8) AS pooled_loss, round(0.5 * p.l + 0.5 * el, 8) AS loss FROM (SELECT mol, avg(l) AS el FROM q GROUP BY mol) JOIN p USING (mol)""")
def g15(spark, d):
    df = table(spark, d, "embeddings", "vec_id", "embedding").select(
        F.floor(F.col("vec_id") / 6).alias("mol"), (F.col("vec_id") % 3).alias("e"), F.posexplode("embedding").alias("i", "x"))
    df = df.select("mol", "e", "i", (F.col("x").cast("double") * 4).alias("z"), (F.col("i") == F.col("mol") % 64).alias("pos"))
    out = g.energy_balanced_loss(df, "mol", "e", "i", "z", "pos")
    return out.select("mol", *[F.round(c, 8).alias(c) for c in ("energy_loss", "pooled_loss", "loss")])


def calibration_bins(spark, d):
    rows = table(spark, d, "embeddings")
    a = rows.select(F.col("vec_id").alias("example"), F.col("label").alias("structure"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"))
    b = rows.select((F.col("vec_id") - 1).alias("example"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("t"))
    j = a.join(b, "example").withColumn("m", F.array_max("p"))
    j = j.select("structure", "example", "t", "m", F.posexplode("p").alias("i", "v"))
    return j.select("structure", "example", (F.col("i") + 1).alias("bin"), (F.col("v") / F.col("m")).alias("ratio"),
                    F.get("t", F.col("i")).alias("target"), (F.lit(20.0) + (F.col("example") % 9) * 5).alias("energy"),
                    (F.lit(400.0) + F.col("example") % 50).alias("precursor"))


THETA = (0.3, -0.2, 0.1, 0.4)


@query("G16_calibration_gradient_step", f"""WITH {BITS_SQL},
b AS (SELECT label AS st, vec_id AS ex, i + 1 AS bin, abs(x) / max(abs(x)) OVER (PARTITION BY vec_id) AS ratio, (20 + (vec_id % 9) * 5 - 40) / 20.0::DOUBLE AS e, 400.0::DOUBLE + vec_id % 50 AS prec FROM bits),
j AS (SELECT b.*, abs(t.x) AS y FROM b JOIN bits t ON t.vec_id = ex + 1 AND t.i + 1 = bin),
r AS (SELECT *, (bin - 1.0::DOUBLE) * 1500.0::DOUBLE / 63.0::DOUBLE AS mz FROM j),
h AS (SELECT *, mz / (mz + prec) - 0.5 AS rr, tanh({THETA[0]} + {THETA[1]} * e) AS ht, tanh({THETA[2]} + {THETA[3]} * e) AS hr FROM r),
q AS (SELECT *, CASE WHEN ratio > 0 THEN exp((1 + 0.25 * ht) * ln(ratio) + 0.5 * hr * rr) ELSE 0 END AS q, CASE WHEN ratio > 0 THEN 0.25 * (1 - ht * ht) * ln(ratio) ELSE 0 END AS j0,
  CASE WHEN ratio > 0 THEN 0.5 * (1 - hr * hr) * rr ELSE 0 END AS j2 FROM h),
s AS (SELECT st, ex, sum(q * y) AS qy, sqrt(sum(q * q)) AS pn, sqrt(sum(y * y)) AS yn, sum(j0 * q * y) AS a0, sum(e * j0 * q * y) AS a1, sum(j2 * q * y) AS a2, sum(e * j2 * q * y) AS a3,
  sum(j0 * q * q) AS b0, sum(e * j0 * q * q) AS b1, sum(j2 * q * q) AS b2, sum(e * j2 * q * q) AS b3 FROM q GROUP BY ALL),
x AS (SELECT st, 1 - qy / (pn * yn) AS loss, -a0 / (pn * yn) + qy * b0 / (pn * pn * pn * yn) AS g0, -a1 / (pn * yn) + qy * b1 / (pn * pn * pn * yn) AS g1,
  -a2 / (pn * yn) + qy * b2 / (pn * pn * pn * yn) AS g2, -a3 / (pn * yn) + qy * b3 / (pn * pn * pn * yn) AS g3 FROM s)
SELECT round(avg(l), 9) AS loss, round(avg(g0), 9) AS g0, round(avg(g1), 9) AS g1, round(avg(g2), 9) AS g2, round(avg(g3), 9) AS g3
FROM (SELECT avg(loss) AS l, avg(g0) AS g0, avg(g1) AS g1, avg(g2) AS g2, avg(g3) AS g3 FROM x GROUP BY st)""")
def g16(spark, d):
    out = g.calibration_objective(calibration_bins(spark, d), THETA, 64, 1500.0)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("G17_merged_energy_mean", f"""WITH {SPECTRA_SQL}
SELECT user_id, adduct, mode, round(coalesce(avg(CASE WHEN energy >= 5 THEN energy END), 25.0), 9)::DOUBLE AS merged_energy FROM meta GROUP BY ALL""")
def g17(spark, d):
    mean = F.avg(F.when(F.col("energy") >= 5, F.col("energy")))
    return spectra_meta(spark, d).groupBy("user_id", "adduct", "mode").agg(F.round(F.coalesce(mean, F.lit(25.0)), 9).alias("merged_energy"))


@query("G18_stage_counts", f"""WITH p AS ({ORACLES['J4_window_with_fallback']})
SELECT count(*) AS queries, count(*) FILTER (status = 1) AS bad_mass, count(*) FILTER (status = 2) AS empty_window, count(*) FILTER (status = 3) AS over_cap,
 count(*) FILTER (status = 0 AND selected_ppm > 20) AS fallback_used, coalesce(sum(CASE WHEN status = 0 THEN CASE WHEN rows_20 > 0 THEN rows_20 ELSE rows_60 END END), 0)::BIGINT AS scored_rows FROM p""")
def g18(spark, d):
    policy = j4(spark, d).withColumn("selected_rows", F.when(F.col("rows_20") > 0, F.col("rows_20")).otherwise(F.col("rows_60")))
    return g.stage_counts(policy, 20.0)


@query("G19_median_group_size", "SELECT count(*) AS formulas, quantile_cont(n, 0.5) AS median_rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_type)")
def g19(spark, d):
    counts = table(spark, d, "part", "p_name", "p_type").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"))
    # sizes repeat, so the median is read off the count of counts
    sizes = counts.agg(F.count(F.lit(1)).alias("formulas"))
    return sizes.join(F.broadcast(g.exact_quantiles(counts, [], "n", {"median_rows": 0.5})))


@query("G20_regime_summary", f"""WITH {TRUTH_SQL},
g AS (SELECT q % 2 AS regime, q, count(*) AS n, max(CASE WHEN y = 1 THEN disc END) AS pos, max(CASE WHEN y = 0 THEN disc END) AS neg, (max(abs(disc)) = 0)::INTEGER AS z FROM rows GROUP BY ALL)
SELECT regime, count(*) AS n_groups, sum(n)::BIGINT AS candidates, round(avg(pos), 6) AS mean_positive, sum(z)::BIGINT AS all_zero_groups, round(avg(neg), 6) AS mean_best_negative FROM g GROUP BY regime""")
def g20(spark, d):
    df = truth_lists(spark, d).withColumn("regime", F.col("q") % 2)
    return g.regime_summary(df, "q", "regime", "y", "disc").withColumn("mean_positive", F.round("mean_positive", 6)).withColumn(
        "mean_best_negative", F.round("mean_best_negative", 6))
