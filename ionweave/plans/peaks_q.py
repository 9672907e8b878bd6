"""Peak and per-spectrum operations A1-A14."""

from pyspark.sql import functions as F

from ..functions import peaks as pk
from ..functions import scalars as s
from ..operators import aggregates, spectra_ops
from .registry import query
from .stand_ins import ADDUCTS_SQL, PEAKS_SQL, SPECTRA_SQL, peaks_long, spectra, spectra_meta


def exploded(df, *keys, peaks="peaks", digits=9):
    out = df.select(*keys, F.posexplode(peaks).alias("pos", "p"))
    return out.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.round(F.col("p.mz").cast("double"), 6).alias("mz"),
                      F.round(F.col("p.intensity").cast("double"), digits).alias("intensity"))


@query("A1_clean_peaks_floor_topk", f"""WITH {PEAKS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -it, i) AS r FROM (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m FROM peaks WHERE it > 0) WHERE it >= 0.05::DOUBLE * m)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY mz, i) - 1 AS pos, round(mz, 6) AS mz, round(it / sum(it) OVER (PARTITION BY vec_id), 9) AS intensity FROM f WHERE r <= 20""")
def a1(spark, d):
    return exploded(spectra(spark, d).withColumn("peaks", pk.clean_floor_topk(F.col("peaks"), 0.05, 20)), "vec_id")


@query("A2_prep_l2_sqrt", f"""WITH {PEAKS_SQL},
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -it, i) AS r FROM (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m FROM peaks) WHERE it >= 0.02::DOUBLE * m)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS pos, round(mz, 6) AS mz, round(sqrt(it) / sqrt(sum(sqrt(it) * sqrt(it)) OVER (PARTITION BY vec_id)), 9) AS intensity FROM f WHERE r <= 40""")
def a2(spark, d):
    return exploded(spectra(spark, d).withColumn("peaks", pk.sqrt_l2(F.col("peaks"), 0.02, 40)), "vec_id")


@query("A3_prep_peaks_windowed", f"""WITH {PEAKS_SQL},
f AS (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m, count(*) OVER (PARTITION BY vec_id) AS n0 FROM peaks WHERE mz <= 800 + vec_id % 200 + 1.5),
g AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id, floor(mz / 50) ORDER BY -it, i) AS br FROM f WHERE it >= 0.01::DOUBLE * m),
h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY (br > 2)::INTEGER, -it, i) AS r FROM g),
k AS (SELECT *, max(it) OVER (PARTITION BY vec_id) AS m2 FROM h WHERE n <= 30 OR r <= 30)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY mz, i) - 1 AS pos, round(mz::FLOAT::DOUBLE, 6) AS mz, round(sqrt(it / m2)::FLOAT::DOUBLE, 9) AS intensity FROM k""")
def a3(spark, d):
    prec = (F.lit(800) + F.col("vec_id") % 200).cast("double")
    return exploded(spectra(spark, d).withColumn("peaks", pk.windowed(F.col("peaks"), prec, max_peaks=30, floor=0.01, per_window=2)), "vec_id")


@query("A4_merge_peaks_max", f"""WITH {PEAKS_SQL},
s AS (SELECT vec_id // 4 AS q, vec_id % 4 AS v, i, mz, it / greatest(max(it) OVER (PARTITION BY vec_id), 1e-9) AS it FROM peaks),
n AS (SELECT *, lag(mz) OVER w AS pm, lag(it) OVER w AS pi, lead(mz) OVER w AS nm, lead(it) OVER w AS ni FROM s WINDOW w AS (PARTITION BY q ORDER BY mz, v, i))
SELECT q, count(*) AS n_kept, round(sum(it), 6) AS total, round(sum(mz), 5) AS mz_total FROM n WHERE NOT coalesce(mz - pm < 0.9 AND it < pi, false) AND NOT coalesce(nm - mz < 0.9 AND ni >= it, false) GROUP BY q""")
def a4(spark, d):
    views = spectra(spark, d).select(F.floor(F.col("vec_id") / 4).alias("q"), (F.col("vec_id") % 4).alias("v"), "peaks")
    merged = spectra_ops.merged_views(views, "q", "v", "peaks", gap=0.9)
    return merged.groupBy("q").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("intensity"), 6).alias("total"), F.round(F.sum("mz"), 5).alias("mz_total"))


CLUSTER_SQL = f"""WITH RECURSIVE {PEAKS_SQL}, p AS (SELECT vec_id, mz, it FROM peaks WHERE it > 0),
st AS (SELECT vec_id, min(mz) AS s FROM p GROUP BY vec_id UNION ALL SELECT vec_id, (SELECT min(p.mz) FROM p WHERE p.vec_id = st.vec_id AND p.mz - st.s > 14.0::DOUBLE) AS s FROM st
  WHERE EXISTS (SELECT 1 FROM p WHERE p.vec_id = st.vec_id AND p.mz - st.s > 14.0::DOUBLE)),
cl AS (SELECT p.vec_id, max(s) AS s, p.mz, p.it FROM p JOIN st ON st.vec_id = p.vec_id AND s <= p.mz GROUP BY p.vec_id, p.mz, p.it),
m AS (SELECT vec_id, s AS mz, AGG(it) AS it FROM cl GROUP BY vec_id, s),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -it, mz) AS r FROM m)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY mz) - 1 AS pos, round(mz, 6) AS mz, round(it / sum(it) OVER (PARTITION BY vec_id), 9) AS intensity FROM t WHERE r <= 25"""


@query("A5_merge_predicted_max", CLUSTER_SQL.replace("AGG(", "max("))
def a5(spark, d):
    return exploded(spectra(spark, d).withColumn("peaks", pk.merge_predicted(F.col("peaks"), 14.0, 25, "max")), "vec_id")


@query("A5_merge_predicted_sum", CLUSTER_SQL.replace("AGG(", "sum("))
def a5_sum(spark, d):
    return exploded(spectra(spark, d).withColumn("peaks", pk.merge_predicted(F.col("peaks"), 14.0, 25, "sum")), "vec_id")


@query("A6_mass_basis_round", f"WITH {PEAKS_SQL} SELECT vec_id // 3 AS q, round_even(mz, 1) AS mz, max(it) AS intensity FROM peaks WHERE it > 0 GROUP BY ALL")
def a6(spark, d):
    rows = peaks_long(spark, d).withColumn("q", F.floor(F.col("vec_id") / 3))
    return spectra_ops.mass_basis(rows, ["q"], "mz", "it", decimals=1).withColumnRenamed("it", "intensity")


@query("A7_ce_mixture", f"""WITH {PEAKS_SQL},
b AS (SELECT vec_id // 3 AS q, vec_id % 3 AS e, round_even(mz, 0) AS mz, max(it) AS it FROM peaks WHERE it > 0 GROUP BY ALL),
n AS (SELECT q, mz, it / max(it) OVER (PARTITION BY q, e) / count(*) FILTER (f) OVER (PARTITION BY q) AS it FROM (SELECT *, row_number() OVER (PARTITION BY q, e ORDER BY mz) = 1 AS f FROM b)),
m AS (SELECT q, mz, sum(it) AS it FROM n GROUP BY q, mz),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY -round(it, 12), mz) AS r FROM m)
SELECT q, mz::FLOAT::DOUBLE AS mz, round((it / max(it) OVER (PARTITION BY q))::FLOAT::DOUBLE, 6) AS intensity FROM t WHERE r <= 50""")
def a7(spark, d):
    rows = peaks_long(spark, d).select(F.floor(F.col("vec_id") / 3).alias("q"), (F.col("vec_id") % 3).alias("e"), "mz", "it")
    out = spectra_ops.energy_mixture(rows, "q", "e", "mz", "it", top=50, decimals=0)
    return out.select("q", F.col("mz").cast("float").cast("double").alias("mz"), F.round(F.col("it").cast("float").cast("double"), 6).alias("intensity"))


@query("A8_intensity_calibration", f"""WITH {PEAKS_SQL},
r AS (SELECT vec_id, i + 1 AS bin, it / max(it) OVER (PARTITION BY vec_id) AS ratio, (20 + (vec_id % 9) * 5 - 40) / 20.0::DOUBLE AS e, i * 1500.0::DOUBLE / 63.0::DOUBLE AS m, 400.0::DOUBLE + vec_id % 50 AS prec FROM peaks WHERE it > 0),
l AS (SELECT vec_id, bin, (1 + 0.25 * tanh(0.3 + -0.2 * e)) * ln(ratio) + 0.5 * tanh(0.1 + 0.4 * e) * (m / (m + prec) - 0.5) AS z FROM r)
SELECT vec_id, bin, round(exp(z - max(z) OVER (PARTITION BY vec_id)), 9) AS calibrated FROM l""")
def a8(spark, d):
    df = spectra(spark, d).withColumn("peaks", pk.base_scaled(pk.finite_positive(F.transform("peaks", lambda p, i: F.struct(
        (i + 1).cast("double").alias("mz"), p["intensity"].alias("intensity"))))))
    energy, prec = F.lit(20.0) + (F.col("vec_id") % 9) * 5, F.lit(400.0) + F.col("vec_id") % 50
    logs = F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), pk.calibrated(
        p["intensity"], p["mz"], energy, prec, (0.3, -0.2, 0.1, 0.4), 64, 1500.0).alias("intensity")))
    shifted = pk.let(logs, lambda ps: pk.let(pk.highest(ps), lambda m: F.transform(
        ps, lambda p: F.struct(p["mz"].alias("mz"), F.exp(p["intensity"] - m).alias("intensity")))))
    out = df.select("vec_id", F.explode(shifted).alias("p"))
    return out.select("vec_id", F.col("p.mz").cast("int").alias("bin"), F.round("p.intensity", 9).alias("calibrated"))


@query("A9_acquisition_window_status", f"""WITH {PEAKS_SQL},
a AS (SELECT vec_id, min(mz) AS lo, max(mz) AS hi, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 5 = 1 THEN 1100.0::DOUBLE ELSE 90.0::DOUBLE END AS wlo, 1040.0::DOUBLE + vec_id % 20 AS whi FROM peaks GROUP BY vec_id)
SELECT vec_id, CASE WHEN wlo IS NULL THEN 'HOLD_NO_ACQUISITION_WINDOW' WHEN whi <= wlo OR lo < wlo OR hi > whi THEN 'INVALID_WINDOW' ELSE 'DECLARED_ACQUISITION_WINDOW' END AS window_status FROM a""")
def a9(spark, d):
    m = F.col("vec_id") % 5
    lo = F.when(m == 0, F.lit(None).cast("double")).when(m == 1, 1100.0).otherwise(90.0)
    return spectra(spark, d).select("vec_id", pk.window_status(F.col("peaks"), lo, F.lit(1040.0) + F.col("vec_id") % 20).alias("window_status"))


@query("A10_overlapping_adjacent_peaks", f"""WITH {PEAKS_SQL},
n AS (SELECT vec_id, mz, lead(mz) OVER (PARTITION BY vec_id ORDER BY mz, i) AS nx FROM peaks)
SELECT vec_id, sum((mz + greatest(2.0::DOUBLE, mz * (8000 * 1e-6)) >= nx - greatest(2.0::DOUBLE, nx * (8000 * 1e-6)))::INTEGER)::INTEGER AS overlapping_pairs FROM n GROUP BY vec_id""")
def a10(spark, d):
    return spectra(spark, d).select("vec_id", pk.overlapping_neighbours(F.col("peaks"), 2.0, 8000.0).alias("overlapping_pairs"))


@query("A11_interval_union_coverage", f"""WITH {PEAKS_SQL},
b AS (SELECT vec_id, greatest(200.0::DOUBLE, least(mz - 3, mz / (1 + 4000 * 1e-6))) AS l, least(900.0::DOUBLE, greatest(mz + 3, mz / (1 - 4000 * 1e-6))) AS r FROM peaks),
o AS (SELECT *, max(r) OVER (PARTITION BY vec_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM b WHERE r > l)
SELECT vec_id, round(sum(greatest(0, r - greatest(l, coalesce(e, -1e300)))) / 700, 9) AS coverage FROM o GROUP BY vec_id""")
def a11(spark, d):
    ions = F.transform("peaks", lambda p: p["mz"])
    return spectra(spark, d).select("vec_id", F.round(pk.covered_fraction(ions, F.lit(200.0), F.lit(900.0), 3.0, 4000.0), 9).alias("coverage"))


@query("A12_compatible_groups", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL},
v AS (SELECT user_id, event_id, adduct, mode, abs_charge, n_mol, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'qtof' END AS ins, CASE WHEN energy >= 50 THEN energy // 10 END AS en FROM meta JOIN adducts USING (adduct))
SELECT user_id, adduct, mode, min(event_id) AS first_view, count(*) AS n_views FROM v GROUP BY user_id, adduct, mode, abs_charge, n_mol, ins, en, CASE WHEN ins IS NULL OR en IS NULL THEN event_id END""")
def a12(spark, d):
    v = s.with_adduct(spectra_meta(spark, d)).filter(F.col("n_mol").isNotNull())
    v = v.withColumn("ins", F.when(F.col("event_id") % 3 != 0, "qtof")).withColumn("en", F.when(F.col("energy") >= 50, F.floor(F.col("energy") / 10)))
    out = spectra_ops.compatible_groups(v, "user_id", ["adduct", "mode", "abs_charge", "n_mol"], ["ins", "en"], "event_id")
    return out.select("user_id", "adduct", "mode", "first_view", "n_views")


@query("A13_prediction_conditions", f"""WITH {SPECTRA_SQL}
SELECT user_id, adduct, greatest(5.0, round_even(energy / 5.0, 0) * 5.0)::DOUBLE AS energy_bucket, count(*) AS n_spectra, round(quantile_cont(mz, 0.5), 6) AS median_precursor
FROM meta WHERE mode = 'positive' AND adduct IN ('[M+H]+', '[M+Na]+') GROUP BY ALL""")
def a13(spark, d):
    covered = spectra_meta(spark, d).filter((F.col("mode") == "positive") & F.col("adduct").isin("[M+H]+", "[M+Na]+"))
    covered = covered.withColumn("energy_bucket", s.energy_bucket(F.col("energy").cast("double")))
    keys = ["user_id", "adduct", "energy_bucket"]
    medians = aggregates.exact_quantiles(covered, keys, "mz", {"median_precursor": 0.5})
    counts = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spectra"))
    return counts.join(medians, keys).withColumn("median_precursor", F.round("median_precursor", 6))


U = "(('0x' || substr(sha256({0}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"


def _normal(tag):
    base = f"'s7:' || vec_id || ':' || i || ':{tag}:"
    return f"sqrt(-2.0::DOUBLE * ln({U.format(base + 'u' + chr(39))})) * cos(6.283185307179586::DOUBLE * {U.format(base + 'v' + chr(39))})"


RATE = U.format("'s7:' || vec_id || ':rate'")
KEEP = U.format("'s7:' || vec_id || ':' || i || ':keep'")


@query("A14_augment_peaks", f"""WITH {PEAKS_SQL}
SELECT vec_id, i AS pos, round(mz * (1.0 + 5e-6::DOUBLE * {_normal('mz')}), 7) AS mz, round(it * exp(0.25::DOUBLE * {_normal('it')}), 9) AS intensity
FROM peaks WHERE {KEEP} > {RATE} * 0.3::DOUBLE""")
def a14(spark, d):
    df = spectra(spark, d).select("vec_id", F.explode(pk.augmented(F.col("peaks"), F.col("vec_id").cast("string"), "s7")).alias("p"))
    return df.select("vec_id", F.col("p.pos").alias("pos"), F.round("p.mz", 7).alias("mz"), F.round("p.intensity", 9).alias("intensity"))
