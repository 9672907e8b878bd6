"""Sorts, limits, top-k and deduplicated lists T1-T14, and set operations U1-U5."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lists as li
from ..operators import sets, skew
from .joins_q import POLICY_SQL, atlas_pairs, atlas_policy
from .registry import query, table
from .stand_ins import BANK_SQL, LISTS_SQL, TRUTH_SQL, bank, lists, truth_lists

ROW = ["q", "cand", "sup"]


@query("T1_stable_ranking", f"WITH {LISTS_SQL} SELECT q, cand, sup, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand, sup) AS rank FROM lists")
def t1(spark, d):
    return skew.numbered(lists(spark, d).select(*ROW, "score"), ["q"], [-F.col("score"), F.col("cand"), F.col("sup")], "rank").drop("score")


TOPK_SQL = f"""{LISTS_SQL}, best AS (SELECT q, sup % 5 AS identity, max(score) AS score, arg_max(cand, (score, -cand)) AS cand FROM lists WHERE tax > 0.02 GROUP BY ALL),
topk AS (SELECT q, identity, score, cand, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM best QUALIFY rank <= 3)"""


def topk(spark, d):
    df = lists(spark, d).withColumn("identity", F.when(F.col("tax") > 0.02, F.col("sup") % 5))
    return li.distinct_topk(df, "q", "identity", "score", "cand", 3)


@query("T2_distinct_topk", f"WITH {TOPK_SQL} SELECT * FROM topk")
def t2(spark, d):
    return topk(spark, d)


SHORT_SQL = f"""{LISTS_SQL}, short AS (SELECT q, cand, sup, score, qty FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand, sup) AS a, row_number() OVER (PARTITION BY q ORDER BY tax DESC, cand, sup) AS b FROM lists) WHERE a <= 3 OR b <= 1)"""


def shortlist(spark, d):
    return li.shortlist_union(lists(spark, d), "q", ["cand", "sup"], "score2", "tax", 3, 1)


@query("T3_shortlist_union", f"WITH {SHORT_SQL} SELECT q, cand, sup FROM short")
def t3(spark, d):
    return shortlist(spark, d).select(*ROW)


@query("T4_prior_blend_rank", f"""WITH {SHORT_SQL}, b AS (SELECT q, cand, sup, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9) + 0.15 * qty, 6) AS blended FROM short WINDOW w AS (PARTITION BY q))
SELECT *, row_number() OVER (PARTITION BY q ORDER BY -blended, cand, sup) AS rank FROM b""")
def t4(spark, d):
    b = li.prior_blend(shortlist(spark, d), "q", "score", "qty").select(*ROW, F.round("blended", 6).alias("blended"))
    # a shortlist holds at most n_partial + n_prior rows per query
    return skew.numbered(b, ["q"], [-F.col("blended"), F.col("cand"), F.col("sup")], "rank", hot=skew.BOUNDED)


@query("T5_mass_distance_fallback_rank", f"""WITH {LISTS_SQL}, m AS (SELECT *, max(tax) OVER (PARTITION BY q) >= 0.06 AS usable, avg(qty) OVER (PARTITION BY q) AS target FROM lists)
SELECT q, cand, sup, CASE WHEN usable THEN 'score' ELSE 'mass_distance' END AS source, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN usable THEN -score ELSE round(abs(qty - target), 9) END, cand, sup) AS rank FROM m""")
def t5(spark, d):
    df = skew.group_stats(lists(spark, d), ["q"], (F.max("tax") >= 0.06).alias("usable"), F.avg("qty").alias("target"))
    key = F.when(F.col("usable"), -F.col("score")).otherwise(F.round(F.abs(F.col("qty") - F.col("target")), 9))
    df = df.select(*ROW, F.when(F.col("usable"), "score").otherwise("mass_distance").alias("source"), key.alias("_key"))
    return skew.numbered(df, ["q"], [F.col("_key"), F.col("cand"), F.col("sup")], "rank").drop("_key")


@query("T6_stratified_round_robin", """
WITH e AS (SELECT o_orderkey, least(floor((o_totalprice / 300 - 80) * 64 / 1320), 63)::INTEGER AS bin, sha256('rr:' || o_orderkey) AS key FROM orders WHERE o_totalprice / 300 BETWEEN 80 AND 1400),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY key) AS turn FROM e)
SELECT o_orderkey, bin, row_number() OVER (ORDER BY turn, bin) AS pos FROM r ORDER BY pos LIMIT 500""")
def t6(spark, d):
    mass = F.col("o_totalprice") / 300
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("bin", scalars.mass_bin(mass)).filter("bin is not null")
    df = df.select("o_orderkey", "bin", F.sha2(F.concat(F.lit("rr:"), F.col("o_orderkey").cast("string")), 256).alias("key"))
    return li.round_robin(df, "bin", "key", 500).drop("key")


@query("T7_slot_merge", f"""WITH {LISTS_SQL}, one AS (SELECT q, cand, max(score) AS score, max(score2) AS score2, max(tax) AS tax FROM lists GROUP BY ALL),
tier AS (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand) AS t FROM one WHERE tax > 0.06 QUALIFY t <= 2),
rest AS (SELECT o.q, o.cand, row_number() OVER (PARTITION BY o.q ORDER BY score DESC, o.cand) AS k FROM one o LEFT JOIN tier USING (q, cand) WHERE tier.t IS NULL),
n AS (SELECT q, count(*) AS m FROM tier GROUP BY q),
p AS (SELECT q, cand, 2 * t AS pos FROM tier UNION ALL SELECT rest.q, cand, CASE coalesce(m, 0) WHEN 0 THEN k WHEN 1 THEN CASE WHEN k < 2 THEN k ELSE k + 1 END ELSE CASE WHEN k < 2 THEN 1 WHEN k = 2 THEN 3 ELSE k + 2 END END FROM rest LEFT JOIN n USING (q))
SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY pos) AS rank FROM p QUALIFY rank <= 10""")
def t7(spark, d):
    one = lists(spark, d).groupBy("q", "cand").agg(F.max("score").alias("score"), F.max("score2").alias("score2"), F.max("tax").alias("tax"))
    base = one.select("q", "cand", F.struct(-F.col("score"), F.col("cand")).alias("r"))
    tier = one.filter("tax > 0.06").select("q", "cand", F.struct(-F.col("score2"), F.col("cand")).alias("r"))
    return li.slot_merge(base, tier, "q", "cand", "r", [2, 4], 10)


POSITION = "rank() OVER (PARTITION BY q ORDER BY {0} DESC) - 1 + (count(*) OVER (PARTITION BY q, {0}) + 1) / 2"


@query("T8_rrf_fusion", f"WITH {LISTS_SQL} SELECT q, cand, sup, round(1 / (60 + {POSITION.format('tax')}) + 1 / (60 + {POSITION.format('qty')}), 9) AS rrf FROM lists")
def t8(spark, d):
    out = li.rrf(lists(spark, d), "q", ["cand", "sup"], ["tax", "qty"])
    return out.withColumn("rrf", F.round("rrf", 9))


@query("T9_promote_leading", f"""WITH {TOPK_SQL}, l AS (SELECT q, list(identity ORDER BY rank) AS fin FROM topk GROUP BY q),
x AS (SELECT q, max(tax) * 12 AS lib, arg_max(sup % 5, (score2, cand, sup)) AS lead, min(qty) AS mq, sum(disc) = 0 AS nodisc, stddev_pop(score2) > 1e-9 AND min(tax) > 0 AS sound FROM lists GROUP BY q),
r AS (SELECT x.q, fin, lead, CASE WHEN mq <= 2 THEN 'tier_uninvoked' WHEN nodisc THEN 'policy_unapproved' WHEN lib >= 0.9 THEN 'strong_library_match' WHEN fin IS NULL THEN 'final_list_invalid' WHEN NOT sound THEN 'tier_metadata_invalid' END AS reason FROM x LEFT JOIN l USING (q))
SELECT q, reason, array_to_string(CASE WHEN reason IS NULL THEN list_slice(list_concat([lead], list_filter(fin, lambda v: v <> lead)), 1, 3) ELSE fin END, ';') AS ranked FROM r""")
def t9(spark, d):
    final = topk(spark, d).groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "identity"))), lambda r: r["identity"]).alias("fin"))
    lead = F.max(F.struct("score2", "cand", "sup"))
    facts = lists(spark, d).groupBy("q").agg((F.max("tax") * 12).alias("lib"), lead.alias("lead"), F.min("qty").alias("mq"), (F.sum("disc") == 0).alias("nodisc"),
                                            F.max("score2").alias("raw"), F.avg("score2").alias("mean"), F.stddev_pop("score2").alias("std"), F.max("qty").alias("pop"), F.min("tax").alias("nt"))
    # stored statistics of the leading item, off by a thousandth where an untaxed line is present
    facts = facts.withColumn("z", F.try_divide(F.col("raw") - F.col("mean"), F.col("std")))
    facts = facts.withColumn("combined", F.col("z") + 0.25 * F.col("pop") + F.when(F.col("nt") > 0, 0.0).otherwise(1e-3))
    j = facts.join(final, "q", "left").withColumn("lead", F.col("lead.sup") % 5)
    reason = li.first_reason([("tier_uninvoked", F.col("mq") <= 2), ("policy_unapproved", F.col("nodisc")),
                              ("strong_library_match", F.col("lib") >= 0.9), ("final_list_invalid", F.col("fin").isNull()),
                              ("tier_metadata_invalid", ~F.coalesce(li.evidence_consistent(F.col("raw"), F.col("mean"), F.col("std"), F.col("z"), F.col("pop"), F.col("combined")), F.lit(False)))])
    j = j.withColumn("reason", reason)
    return j.select("q", "reason", F.array_join(li.promoted(F.col("fin"), F.col("lead"), F.col("reason"), 3), ";").alias("ranked"))


@query("T10_gated_route", f"""WITH {LISTS_SQL}, g AS (SELECT *, CASE WHEN max(qty) OVER w > 49 THEN qty / 50 ELSE avg(disc) OVER w * 10 END AS gate FROM lists WINDOW w AS (PARTITION BY q)),
h AS (SELECT *, min(round(gate, 6)) OVER w AS lo, max(round(gate, 6)) OVER w AS hi FROM g WINDOW w AS (PARTITION BY q))
SELECT q, cand, sup, CASE WHEN lo <> hi THEN 'invalid_gate' WHEN hi < 0.5 THEN 'head_mean' ELSE 'baseline' END AS route, round(CASE WHEN lo <> hi THEN NULL WHEN hi < 0.5 THEN (score + score2) / 2 ELSE qty END, 7) AS routed_score FROM h""")
def t10(spark, d):
    df = skew.group_stats(lists(spark, d), ["q"], F.max("qty").alias("mq"), F.avg("disc").alias("md"))
    df = df.withColumn("gate", F.round(F.when(F.col("mq") > 49, F.col("qty") / 50).otherwise(F.col("md") * 10), 6))
    out = li.gated_route(df, "q", "gate", 0.5, "qty", ("score", "score2"))
    return out.select(*ROW, "route", F.round("routed_score", 7).alias("routed_score"))


@query("T11_identity_gate", f"""WITH {TRUTH_SQL}, a AS (SELECT q, arg_max(sup, (score, -cand)) % 5 AS top_a, arg_max(sup, (tax, -cand)) % 5 AS top_b, max(y * score) / max(score) AS ma, max(y * tax) / nullif(max(tax), 0) AS mb FROM rows GROUP BY q)
SELECT q, top_a = top_b AS accepted, round(CASE WHEN top_a = top_b THEN coalesce(mb, 0) ELSE coalesce(ma, 0) END, 9) AS gated_metric FROM a""")
def t11(spark, d):
    # of rows equal in score and candidate the first in the order that fixes the truth (line, candidate, supplier)
    top = lambda s: F.max(F.struct(F.col(s), (-F.col("cand")).alias("n"), (-F.col("line")).alias("l"), (-F.col("sup")).alias("sup")))
    tops = truth_lists(spark, d).groupBy("q").agg(
        top("score").alias("a"), top("tax").alias("b"),
        (F.max(F.col("y") * F.col("score")) / F.max("score")).alias("ma"), F.try_divide(F.max(F.col("y") * F.col("tax")), F.max("tax")).alias("mb"))
    same = -F.col("a.sup") % 5 == -F.col("b.sup") % 5
    return tops.select("q", same.alias("accepted"), F.round(F.when(same, F.coalesce("mb", F.lit(0.0))).otherwise(F.coalesce("ma", F.lit(0.0))), 9).alias("gated_metric"))


@query("T12_candidate_supplement", f"""WITH {LISTS_SQL}, known AS (SELECT q, sup % 20 AS key FROM lists WHERE disc < 0.03),
k AS (SELECT q, sup % 20 AS key, l.line || '/' || cand AS provenance, round((score2 - score) / score * 100, 6) AS residual FROM lists l WHERE abs(round((score2 - score) / score * 100, 6)) <= 8),
n AS (SELECT k.* FROM k LEFT JOIN known USING (q, key) WHERE known.q IS NULL),
f AS (SELECT q, key, min(provenance) AS provenance, arg_min(residual, (provenance, residual)) AS residual FROM n GROUP BY q, key)
SELECT *, row_number() OVER (PARTITION BY q ORDER BY abs(residual), key) AS pos FROM f""")
def t12(spark, d):
    rows = lists(spark, d).withColumn("key", F.col("sup") % 20)
    gen = rows.select("q", "key", F.concat_ws("/", "line", "cand").alias("provenance"), F.round((F.col("score2") - F.col("score")) / F.col("score") * 100, 6).alias("residual"))
    return li.supplement(gen, rows.filter("disc < 0.03"), "q", "key", "provenance", "residual", 8.0)


@query("T13_stress_canary", f"""WITH {LISTS_SQL}, s AS (SELECT q, count(*) AS peaks, sum(qty) AS density FROM lists GROUP BY q),
p AS ((SELECT q, 0 AS pri, '' AS h FROM s ORDER BY peaks DESC, q LIMIT 16) UNION ALL (SELECT q, 1, '' FROM s ORDER BY density DESC, q LIMIT 16) UNION ALL (SELECT q, 2, sha256('stress|' || q) AS h FROM s ORDER BY h, q LIMIT 64))
SELECT q, min(pri)::INTEGER AS priority FROM p GROUP BY q ORDER BY min((pri, h)), q LIMIT 64""")
def t13(spark, d):
    stats = lists(spark, d).groupBy("q").agg(F.count(F.lit(1)).alias("peaks"), F.sum("qty").alias("density"))
    return li.stress_canary(stats, "q", ["peaks", "density"], 16, 64, "stress|")


@query("T14_confuser_lookup", f"""WITH {POLICY_SQL}, req AS (SELECT s_suppkey AS row_id FROM supplier),
pr AS (SELECT p.row_id, b.row_id AS candidate_row, p.selected_rows FROM policy p JOIN req USING (row_id) JOIN bank b ON b.grp <> p.grp AND b.mass BETWEEN p.mass - p.mass * (p.selected_ppm / 1e6) AND p.mass + p.mass * (p.selected_ppm / 1e6)),
t AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS total, row_number() OVER (PARTITION BY row_id ORDER BY candidate_row) AS pos FROM pr)
SELECT row_id AS query_row, candidate_row, pos, total, total = selected_rows AS total_matches FROM t WHERE pos <= 1""")
def t14(spark, d):
    requests = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_row"))
    only = requests.withColumnRenamed("query_row", "row_id")
    totals = atlas_policy(spark, d, only=only).select(F.col("row_id").alias("query_row"), "selected_rows")
    return li.list_lookup(requests, atlas_pairs(spark, d, only=only).select("query_row", "candidate_row"), totals, "query_row", "candidate_row", "selected_rows", 1)


@query("U1_catalogue_union", f"""WITH {BANK_SQL} SELECT row_id, mass, 0 AS source FROM bank UNION ALL
SELECT s_suppkey + 1000000000, s_acctbal, 1 FROM supplier WHERE s_acctbal > 0 AND s_acctbal NOT IN (SELECT mass FROM bank)""")
def u1(spark, d):
    old = bank(spark, d).select("row_id", "mass")
    new = table(spark, d, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal > 0").select((F.col("s_suppkey") + 1000000000).alias("row_id"), F.col("s_acctbal").alias("mass"))
    return sets.catalogue_union(old, new, "mass", "mass")


@query("U2_range_overlap", """
WITH r AS (SELECT c_custkey, c_acctbal::BIGINT AS a0, c_acctbal::BIGINT + c_nationkey * 10 AS a1, c_acctbal::BIGINT + 60 AS b0, c_acctbal::BIGINT + 180 AS b1 FROM (SELECT c_custkey, floor(c_acctbal) AS c_acctbal, c_nationkey FROM customer)),
x AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) AS i FROM r)
SELECT c_custkey, i AS shared, (a1 - a0) + (b1 - b0) - i AS union_size, (a1 - a0) - i AS left_only, (b1 - b0) - i AS right_only, round(i / nullif((a1 - a0) + (b1 - b0) - i, 0), 9) AS jaccard FROM x""")
def u2(spark, d):
    lo = F.floor("c_acctbal")
    r = table(spark, d, "customer", "c_custkey", "c_acctbal", "c_nationkey").select(
        "c_custkey", lo.alias("a0"), (lo + F.col("c_nationkey") * 10).alias("a1"), (lo + 60).alias("b0"), (lo + 180).alias("b1"))
    return sets.range_overlap(r, "a0", "a1", "b0", "b1").select("c_custkey", "shared", "union_size", "left_only", "right_only", F.round("jaccard", 9).alias("jaccard"))


@query("U3_disjointness_assert", """
WITH r AS (SELECT DISTINCT o_orderpriority AS role, o_custkey AS member FROM orders)
SELECT a.role AS left_role, b.role AS right_role, count(*) AS shared FROM r a JOIN r b ON a.member = b.member AND a.role < b.role GROUP BY ALL""")
def u3(spark, d):
    rows = table(spark, d, "orders", "o_orderpriority", "o_custkey")
    return sets.role_overlaps(rows.select(F.col("o_orderpriority").alias("role"), F.col("o_custkey").alias("member")), "role", "member")


@query("U4_permutation_check", """
SELECT (SELECT count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT ALL SELECT l_orderkey, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN -1 ELSE l_partkey END FROM lineitem)) AS missing,
 (SELECT count(*) FROM (SELECT l_orderkey, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN -1 ELSE l_partkey END FROM lineitem EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem)) AS extra, false AS is_permutation""")
def u4(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_tax", "l_discount")
    moved = F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1), F.lit(-1)).otherwise(F.col("l_partkey"))
    return sets.permutation_report(rows.select("l_orderkey", "l_partkey"), rows.select("l_orderkey", moved.alias("l_partkey")))


@query("U5_common_bins", """
WITH e AS (SELECT user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 5 AS bin, max(value) AS v FROM events GROUP BY ALL)
SELECT a.user_id, a.bin::BIGINT AS bin, a.v AS left_value, b.v AS right_value FROM e a JOIN e b ON a.user_id = b.user_id AND a.bin = b.bin AND a.event_type = 'click' AND b.event_type = 'view'""")
def u5(spark, d):
    v = table(spark, d, "events", "user_id", "event_type", "value", "props").select(
        "user_id", "event_type", F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("int") / 5).alias("bin"), "value")
    return sets.common_bins(v.filter("event_type = 'click'"), v.filter("event_type = 'view'"), ["user_id", "bin"], "value")
