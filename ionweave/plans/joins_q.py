"""Joins J1-J17 over the stand-in tables."""

from pyspark.sql import functions as F

from ..functions import bits, scalars
from ..operators import joins, rangejoin, sampling, sweep
from .registry import query, table
from .stand_ins import ADDUCTS_SQL, BANK_SQL, PEAKS_SQL, SPECTRA_SQL, bank, peaks_long, sample_sql, spectra_meta


@query("J1_mass_window_join", """
SELECT s_suppkey, c_custkey, round((c_acctbal - s_acctbal) / s_acctbal * 1e6, 4) AS signed_ppm
FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - s_acctbal * (500 / 1e6) AND s_acctbal + s_acctbal * (500 / 1e6)
WHERE s_acctbal > 0""")
def j1(spark, d):
    pairs = rangejoin.mass_window_join(
        table(spark, d, "supplier", "s_suppkey", "s_acctbal"), table(spark, d, "customer", "c_custkey", "c_acctbal"),
        query_mass="s_acctbal", bank_mass="c_acctbal", query_id="s_suppkey", bank_id="c_custkey", ppm=500.0)
    ppm = scalars.signed_ppm(F.col("s_acctbal"), F.col("c_acctbal"))
    return pairs.select("s_suppkey", "c_custkey", F.round(ppm, 4).alias("signed_ppm"))


@query("J1_side_window_join", """
SELECT s_suppkey, c_custkey FROM supplier JOIN customer
ON c_acctbal BETWEEN s_acctbal * (1 - 200 / 1e6) AND s_acctbal * (1 + 900 / 1e6) WHERE s_acctbal > 0""")
def j1_side(spark, d):
    lo, hi = rangejoin.side_bounds(F.col("s_acctbal"), 200.0, 900.0)
    queries = (table(spark, d, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0")
               .withColumn("lo", lo).withColumn("hi", hi))
    return rangejoin.window_pairs(queries, table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_acctbal",
                                  query_id="s_suppkey", bank_id="c_custkey", max_ppm=900.0).select("s_suppkey", "c_custkey")


@query("J2_precursor_window_join", f"""
WITH {SPECTRA_SQL}, {ADDUCTS_SQL},
q AS (SELECT event_id, (mz * abs_charge - shift_da) / n_mol AS nm, mz * (300 / 1e6) * abs_charge / n_mol AS half
      FROM meta JOIN adducts USING (adduct))
SELECT event_id, c_custkey, round(c_acctbal - nm, 6) AS error_da FROM q JOIN customer
ON c_acctbal BETWEEN nm - half AND nm + half WHERE c_acctbal > 0""")
def j2(spark, d):
    q = scalars.with_adduct(spectra_meta(spark, d)).filter(F.col("n_mol").isNotNull())
    half = F.col("mz") * F.lit(300.0 / 1e6) * F.col("abs_charge") / F.col("n_mol")
    q = q.select("event_id", scalars.neutral_mass(F.col("mz")).alias("nm"), half.alias("half"))
    q = q.withColumn("lo", F.col("nm") - F.col("half")).withColumn("hi", F.col("nm") + F.col("half"))
    pairs = rangejoin.window_pairs(q, table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_acctbal",
                                   query_id="event_id", bank_id="c_custkey", max_ppm=400.0)
    return pairs.select("event_id", "c_custkey", F.round(F.col("c_acctbal") - F.col("nm"), 6).alias("error_da"))


@query("J3_window_union", """
WITH est AS (SELECT s_suppkey, s_acctbal AS m FROM supplier UNION ALL SELECT s_suppkey, s_acctbal * 1.5 FROM supplier
             UNION ALL SELECT s_suppkey, NULL FROM supplier)
SELECT DISTINCT s_suppkey, c_custkey FROM (
  SELECT s_suppkey, s_suppkey * 7 AS c_custkey FROM supplier
  UNION ALL SELECT s_suppkey, c_custkey FROM est JOIN customer
    ON c_acctbal BETWEEN m - m * 400 / 1e6 AND m + m * 400 / 1e6 WHERE m > 0)""")
def j3(spark, d):
    supplier = table(spark, d, "supplier", "s_suppkey", "s_acctbal")
    m = F.col("s_acctbal")
    estimates = supplier.select("s_suppkey", F.explode(F.array(m, m * 1.5, F.lit(None).cast("double"))).alias("m"))
    baseline = supplier.select("s_suppkey", (F.col("s_suppkey") * 7).alias("c_custkey"))
    return rangejoin.window_union(estimates, baseline, table(spark, d, "customer", "c_custkey", "c_acctbal"),
                                  query_id="s_suppkey", estimate="m", bank_mass="c_acctbal", bank_id="c_custkey", ppm=400.0)


@query("J4_window_with_fallback", f"""
WITH {BANK_SQL}, q AS (SELECT row_id, CASE WHEN prior = 50 THEN NULL ELSE mass * (1 + prior * 2e-6) END AS qm FROM bank),
runs AS (SELECT mass, count(*) AS n FROM bank GROUP BY mass),
c AS (SELECT row_id, qm, CAST(sum(CASE WHEN mass BETWEEN qm - qm * (20 / 1e6) AND qm + qm * (20 / 1e6) THEN n ELSE 0 END) AS BIGINT) AS r20,
      CAST(sum(CASE WHEN mass IS NULL THEN 0 ELSE n END) AS BIGINT) AS r60
      FROM q LEFT JOIN runs ON mass BETWEEN qm - qm * (60 / 1e6) AND qm + qm * (60 / 1e6) GROUP BY row_id, qm)
SELECT row_id, CASE WHEN qm IS NULL THEN NULL ELSE r20 END AS rows_20, CASE WHEN qm IS NULL THEN NULL ELSE r60 END AS rows_60,
  CASE WHEN r20 > 0 THEN 20.0::DOUBLE WHEN r60 > 0 THEN 60.0::DOUBLE END AS selected_ppm,
  CASE WHEN qm IS NULL THEN 1 WHEN r60 = 0 THEN 2
       WHEN (CASE WHEN r20 > 0 THEN r20 ELSE r60 END) > 40 THEN 3 ELSE 0 END AS status FROM c""")
def j4(spark, d):
    b = bank(spark, d)
    q = b.select("row_id", F.when(F.col("prior") != 50, F.col("mass") * (1 + F.col("prior") * F.lit(2e-6))).alias("qm"))
    counted = sweep.window_counts(q, b, query_mass="qm", bank_mass="mass", ppms=[20.0, 60.0])
    out = sweep.policy(counted, query_mass="qm", narrow=20.0, wide=60.0, cap=40)
    return out.select("row_id", "rows_20", "rows_60", "selected_ppm", "status")


POLICY_SQL = f"""{BANK_SQL},
near AS (SELECT a.row_id, a.mass, a.grp, b.grp AS og, count(*) AS n, b.mass AS bm FROM bank a JOIN bank b ON b.grp <> a.grp
   AND b.mass BETWEEN a.mass - a.mass * (150 / 1e6) AND a.mass + a.mass * (150 / 1e6) GROUP BY a.row_id, a.mass, a.grp, b.grp, b.mass),
pol AS (SELECT bank.row_id, bank.mass, bank.grp,
   CAST(coalesce(sum(n) FILTER (bm BETWEEN bank.mass - bank.mass * (50 / 1e6) AND bank.mass + bank.mass * (50 / 1e6)), 0) AS BIGINT) AS rows_50,
   count(DISTINCT og) FILTER (bm BETWEEN bank.mass - bank.mass * (50 / 1e6) AND bank.mass + bank.mass * (50 / 1e6)) AS groups_50,
   CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_150, count(DISTINCT og) AS groups_150
   FROM bank LEFT JOIN near USING (row_id) GROUP BY bank.row_id, bank.mass, bank.grp),
policy AS (SELECT *, CASE WHEN rows_50 > 0 THEN 50.0::DOUBLE WHEN rows_150 > 0 THEN 150.0::DOUBLE END AS selected_ppm,
   CASE WHEN rows_50 > 0 THEN rows_50 ELSE rows_150 END AS selected_rows FROM pol)"""


def atlas_policy(spark, d, cap=4096, only=None):
    b = bank(spark, d)
    queries = b if only is None else b.join(only, "row_id", "left_semi")
    counted = sweep.window_counts(queries, b, query_mass="mass", bank_mass="mass", ppms=[50.0, 150.0], group="grp")
    return sweep.policy(counted, query_mass="mass", narrow=50.0, wide=150.0, cap=cap)


@query("J5_group_excluded_join", f"""WITH {POLICY_SQL}
SELECT row_id, rows_50, groups_50, rows_150, groups_150, selected_ppm, selected_rows,
  CASE WHEN selected_rows = 0 THEN 2 WHEN selected_rows > 4096 THEN 3 ELSE 0 END AS status FROM policy""")
def j5(spark, d):
    return atlas_policy(spark, d).select("row_id", "rows_50", "groups_50", "rows_150", "groups_150", "selected_ppm",
                                         "selected_rows", "status")


def atlas_sides(spark, d, cap=4096, only=None, more=None):
    """Queries, bank and settings of the sweep for confuser pairs; windows over ``cap`` are held, not cut.

    ``more``: rows of further columns by ``row_id``, which pairs carry with the prefixes ``q_`` and ``c_``.
    """
    b = bank(spark, d)
    b = b if more is None else b.join(more, "row_id")
    extra = [] if more is None else [c for c in more.columns if c != "row_id"]
    queries = b if only is None else b.join(only, "row_id", "left_semi")

    def side(df, row, prefix):
        return df.select(F.col("row_id").alias(row), F.col("mass").alias(f"{prefix}m"), F.col("grp").alias(f"{prefix}g"), F.col("fp").alias(f"{prefix}fp"),
                         *[F.col(c).alias(f"{prefix}_{c}") for c in extra])

    return side(queries, "query_row", "q"), side(b, "candidate_row", "c"), dict(query_mass="qm", bank_mass="cm", narrow=50.0, wide=150.0, cap=cap, query_group="qg", bank_group="cg")


def atlas_pairs(spark, d, cap=4096, only=None):
    """Confuser pairs with bit-set similarities."""
    queries, rows, window = atlas_sides(spark, d, cap, only)
    pairs = sweep.selected_pairs(queries, rows, **window)
    a, c = F.array("qfp"), F.array("cfp")
    pairs = (pairs.withColumn("intersection_on_bits", bits.intersection(a, c)).withColumn("union_on_bits", bits.union(a, c))
             .withColumn("query_on_bits", F.bit_count("qfp")).withColumn("candidate_on_bits", F.bit_count("cfp")))
    inter = F.col("intersection_on_bits")
    return pairs.select(
        "query_row", "candidate_row", "selected_ppm", "intersection_on_bits", "union_on_bits", "query_on_bits",
        "candidate_on_bits", scalars.signed_ppm(F.col("qm"), F.col("cm")).alias("signed_ppm"),
        bits.tanimoto(inter, F.col("union_on_bits")).alias("jaccard"),
        bits.binary_cosine(inter, F.col("query_on_bits"), F.col("candidate_on_bits")).alias("binary_cosine"))


PAIRS_SQL = f"""{POLICY_SQL},
pairs AS (SELECT p.row_id AS query_row, b.row_id AS candidate_row, p.selected_ppm, bit_count(a.fp & b.fp)::INTEGER AS inter,
   bit_count(a.fp | b.fp)::INTEGER AS uni, bit_count(a.fp)::INTEGER AS qa, bit_count(b.fp)::INTEGER AS ca,
   (b.mass - p.mass) / p.mass * 1e6 AS signed_ppm, a.fp AS qfp, b.fp AS cfp
   FROM policy p JOIN bank a USING (row_id) JOIN bank b ON b.grp <> p.grp
   AND b.mass BETWEEN p.mass - p.mass * (p.selected_ppm / 1e6) AND p.mass + p.mass * (p.selected_ppm / 1e6)
   WHERE p.selected_rows BETWEEN 1 AND 4096)"""


@query("J5_confuser_pairs", f"""WITH {PAIRS_SQL}
SELECT query_row, candidate_row, selected_ppm, inter AS intersection_on_bits, uni AS union_on_bits, qa AS query_on_bits,
  ca AS candidate_on_bits, round(signed_ppm, 6) AS signed_ppm, round(CASE WHEN uni > 0 THEN inter::DOUBLE / uni END, 9) AS jaccard,
  round(CASE WHEN qa > 0 AND ca > 0 THEN inter / sqrt(qa::DOUBLE * ca::DOUBLE) END, 9) AS binary_cosine FROM pairs""")
def j5_pairs(spark, d):
    pairs = atlas_pairs(spark, d)
    return (pairs.withColumn("signed_ppm", F.round("signed_ppm", 6)).withColumn("jaccard", F.round("jaccard", 9))
            .withColumn("binary_cosine", F.round("binary_cosine", 9)))


@query("J6_capped_window", f"""WITH {BANK_SQL}, runs AS (SELECT mass, count(*) AS n FROM bank GROUP BY mass),
c AS (SELECT row_id, CAST(sum(n) AS BIGINT) AS rows_150 FROM bank q JOIN runs r
  ON r.mass BETWEEN q.mass - q.mass * (150 / 1e6) AND q.mass + q.mass * (150 / 1e6) GROUP BY row_id)
SELECT row_id, rows_150, CASE WHEN rows_150 > 5 THEN 'HOLD_OVER_CAP' ELSE 'OK' END AS window_status FROM c""")
def j6(spark, d):
    b = bank(spark, d)
    out = sweep.window_counts(b.select("row_id", F.col("mass").alias("qm")), b, query_mass="qm", bank_mass="mass", ppms=[150.0])
    return out.select("row_id", "rows_150", F.when(F.col("rows_150") > 5, "HOLD_OVER_CAP").otherwise("OK").alias("window_status"))


@query("J7_wide_analog_window", f"""WITH RECURSIVE {sample_sql("(SELECT s_suppkey AS q, s_acctbal AS m FROM supplier)", "(SELECT c_custkey AS c, c_acctbal AS m FROM customer)", 200.0, 60, "analog")}
SELECT q AS s_suppkey, c AS c_custkey, draw, round(c_acctbal - s_acctbal, 6) AS shift_da FROM drawn JOIN supplier ON s_suppkey = q JOIN customer ON c_custkey = c""")
def j7(spark, d):
    pairs = sampling.sampled_window(
        table(spark, d, "supplier", "s_suppkey", "s_acctbal"), table(spark, d, "customer", "c_custkey", "c_acctbal"),
        query_mass="s_acctbal", bank_mass="c_acctbal", query_id="s_suppkey", bank_id="c_custkey", half_width=200.0,
        size=60, tag="analog")
    return pairs.select("s_suppkey", "c_custkey", "draw", F.round(F.col("c_acctbal") - F.col("s_acctbal"), 6).alias("shift_da"))


@query("J8_exact_key_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size AS value, p_size IS NOT NULL AS matched
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey""")
def j8(spark, d):
    values = table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("value"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.exact_key_lookup(rows, values, "l_partkey")


@query("J9_strict_one_to_one_join", """
WITH b AS (SELECT coalesce(o_orderkey, l_orderkey) AS k, a, b FROM
  (SELECT o_orderkey, count(*) AS a FROM orders GROUP BY 1) FULL JOIN
  (SELECT l_orderkey, count(*) AS b FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS left_only,
  count(*) FILTER (a IS NULL) AS right_only, count(*) FILTER (a > 1) AS left_repeated, count(*) FILTER (b > 1) AS right_repeated,
  count(*) FILTER (a IS NULL OR b IS NULL OR a > 1 OR b > 1) = 0 AS one_to_one FROM b""")
def j9(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    right = table(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("k"))
    return joins.one_to_one_report(left, right, ["k"])


@query("J10_ordered_row_join", """
WITH j AS (SELECT a.c_name = b.n AS same FROM customer a FULL JOIN
  (SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN c_mktsegment ELSE 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') END AS n FROM customer) b USING (c_custkey))
SELECT count(*) AS n_rows, count(*) FILTER (same IS NOT TRUE) AS mismatches,
  (SELECT count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids,
  count(*) > 0 AND count(*) FILTER (same IS NOT TRUE) = 0 AS aligned FROM j""")
def j10(spark, d):
    left = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    built = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    right = left.select("c_custkey", F.when(F.col("c_acctbal") < -900, F.col("c_mktsegment")).otherwise(built).alias("c_name"))
    return joins.ordered_row_report(left, right, "c_custkey", "c_name")


@query("J11_complete_cross_coverage", f"""WITH {SPECTRA_SQL}
SELECT user_id, energy FROM (SELECT DISTINCT user_id FROM meta), (SELECT DISTINCT energy FROM meta)
EXCEPT SELECT user_id, energy FROM meta""")
def j11(spark, d):
    return joins.missing_combinations(spectra_meta(spark, d), "user_id", "energy")


@query("J12_new_only_antijoin", """
SELECT doc_id, lang FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def j12(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    held = joins.members_only(docs, table(spark, d, "labels", "doc_id"), "doc_id")
    return joins.new_only(docs, held, "key").select("doc_id", "lang")


@query("J13_membership_semijoin", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j13(spark, d):
    return joins.members_only(table(spark, d, "documents", "doc_id", "source"), table(spark, d, "labels", "doc_id"), "doc_id")


@query("J14_exclusion_overlap", """
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000),
 c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 50000)
SELECT c_custkey, CASE WHEN o.o_custkey IS NOT NULL AND c.o_custkey IS NOT NULL THEN 'both'
  WHEN o.o_custkey IS NOT NULL THEN 'optimizer' WHEN c.o_custkey IS NOT NULL THEN 'checkpoint' ELSE 'disjoint' END AS overlap
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""")
def j14(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderpriority").withColumnRenamed("o_custkey", "c_custkey")
    return joins.overlap_labels(table(spark, d, "customer", "c_custkey"), "c_custkey", orders.filter("o_totalprice > 450000"),
                                orders.filter("o_orderpriority = '1-URGENT' and o_totalprice < 50000"))


@query("J15_map_via_distinct", "SELECT p_partkey, upper(regexp_replace(p_name, '[^a-z]', '', 'g')) AS mapped_key FROM part")
def j15(spark, d):
    key = lambda text: F.upper(F.regexp_replace(text, "[^a-z]", ""))
    return joins.map_via_distinct(table(spark, d, "part", "p_partkey", "p_name"), "p_name", key, "mapped_key", native=True).select("p_partkey", "mapped_key")


@query("J16_proximity_match", f"""WITH {PEAKS_SQL},
m AS (SELECT o.vec_id, o.i, o.it FROM peaks o JOIN peaks p ON p.vec_id = o.vec_id + 1
  AND abs(p.mz - o.mz) <= greatest(2.0::DOUBLE, o.mz * (2000 * 1e-6)))
SELECT vec_id, count(*) AS matches, count(DISTINCT i) AS explained_peaks FROM m GROUP BY vec_id""")
def j16(spark, d):
    peaks = peaks_long(spark, d)
    observed = peaks.select("vec_id", F.col("i").alias("oi"), F.col("mz").alias("omz"))
    predicted = peaks.select((F.col("vec_id") - 1).alias("vec_id"), F.col("i").alias("pi"), F.col("mz").alias("pmz"))
    pairs = rangejoin.peak_matches(observed, predicted, on=("vec_id",), observed_mz="omz", predicted_mz="pmz",
                                   observed_id="oi", predicted_id="pi", abs_tol=2.0, ppm=2000.0)
    per_peak = pairs.groupBy("vec_id", "oi").agg(F.count(F.lit(1)).alias("n"))
    return per_peak.groupBy("vec_id").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("explained_peaks"))


@query("J17_eligibility_match", """
SELECT c_custkey, count(*) AS matched, min(s_suppkey) AS first_observation
FROM customer JOIN supplier ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= c_acctbal * 10000.0::DOUBLE / 1e6
WHERE c_acctbal > 0 AND s_acctbal > 0 GROUP BY c_custkey""")
def j17(spark, d):
    tol = F.col("c_acctbal") * F.lit(10000.0) / F.lit(1e6)
    cands = (table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").filter("c_acctbal > 0")
             .withColumnRenamed("c_nationkey", "nation").withColumn("tol", tol)
             .withColumn("lo", F.col("c_acctbal") - tol * 1.000001).withColumn("hi", F.col("c_acctbal") + tol * 1.000001))
    obs = (table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").filter("s_acctbal > 0")
           .withColumnRenamed("s_nationkey", "nation"))
    pairs = rangejoin.window_pairs(cands, obs, "s_acctbal", query_id="c_custkey", bank_id="s_suppkey", max_ppm=10001.0, on=("nation",))
    pairs = pairs.filter(F.abs(F.col("s_acctbal") - F.col("c_acctbal")) <= F.col("tol"))
    return pairs.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("matched"), F.min("s_suppkey").alias("first_observation"))
