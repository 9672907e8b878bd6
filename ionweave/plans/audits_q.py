"""Contract and audit operators C1-C14."""

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import aggregates, audits, ranking, skew
from .joins_q import POLICY_SQL, atlas_policy
from .registry import query, table
from .scalars_q import CHANNELS_SQL
from .splits_q import ROLE_SQL, roles
from .stand_ins import BANK_SQL, LISTS_SQL, bank, lists


@query("C1_validate_bank", f"""WITH {BANK_SQL}, b AS (SELECT row_id, grp || '/' || src || '/' || prior AS ident, CASE WHEN prior = 50 THEN -mass WHEN prior = 49 THEN NULL ELSE mass END AS m, fp FROM bank),
l AS (SELECT *, lag(m) OVER (ORDER BY row_id) AS p FROM b)
SELECT count(*) AS n_rows, count(*) FILTER (m IS NULL) AS nonfinite_mass, count(*) FILTER (m <= 0) AS nonpositive_mass, count(*) FILTER (fp >> 58 <> 0) AS dirty_padding,
 (SELECT count(*) FROM (SELECT ident FROM b GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, count(*) FILTER (p > m) AS order_falls, false AS valid FROM l""")
def c1(spark, d):
    b = bank(spark, d).select("row_id", F.concat_ws("/", "grp", "src", "prior").alias("ident"),
                              F.when(F.col("prior") == 50, -F.col("mass")).when(F.col("prior") != 49, F.col("mass")).alias("m"), "fp")
    return audits.bank_report(b, "row_id", "m", "ident", F.shiftright("fp", 58) == 0)


@query("C2_feature_contract_match", """
WITH a AS (SELECT p_brand AS bank, 'types' AS field, count(DISTINCT p_type)::VARCHAR AS value FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'max_size', max(p_size)::VARCHAR FROM part GROUP BY 1),
b AS (SELECT p_brand AS bank, 'types' AS field, count(DISTINCT p_type)::VARCHAR AS value FROM part WHERE p_size < 50 GROUP BY 1 UNION ALL SELECT p_brand, 'max_size', max(p_size)::VARCHAR FROM part WHERE p_size < 50 GROUP BY 1)
SELECT *, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def c2(spark, d):
    def contract(df):
        g = df.groupBy(F.col("p_brand").alias("bank")).agg(F.count_distinct("p_type").cast("string").alias("types"), F.max("p_size").cast("string").alias("max_size"))
        return g.select("bank", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("types", "max_size")])).alias("f")).select("bank", "f.field", "f.value")

    part = table(spark, d, "part", "p_brand", "p_type", "p_size")
    return audits.contract_differences(contract(part), contract(part.filter("p_size < 50")))


@query("C3_ion_matrix_alignment", f"""WITH {CHANNELS_SQL}
SELECT channel, count(*) AS n_rows, count(*) FILTER ((n_mol * p_retailprice + shift_da) / abs_charge <> p_retailprice * n_mol / abs_charge + shift_da / abs_charge) AS mismatches FROM part, ch GROUP BY channel""")
def c3(spark, d):
    m = scalars.with_channels(table(spark, d, "part", "p_retailprice"))
    stored = F.col("p_retailprice") * F.col("n_mol") / F.col("abs_charge") + F.col("shift_da") / F.col("abs_charge")
    return audits.formula_mismatches(m, "channel", stored, scalars.precursor_mz(F.col("p_retailprice")))


@query("C4_array_csv_alignment", """
WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_totalprice < 10000 THEN '6-OTHER' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_totalprice > 2000)
SELECT count(b.o_orderkey) AS matched_rows, count(*) FILTER (b.o_orderkey IS NULL) AS left_only, 0::BIGINT AS right_only, count(*) FILTER (b.o_custkey <> o.o_custkey) AS differs_o_custkey, count(*) FILTER (b.o_orderstatus <> o.o_orderstatus) AS differs_o_orderstatus,
 count(*) FILTER (b.o_totalprice <> o.o_totalprice) AS differs_o_totalprice, count(*) FILTER (b.o_orderpriority <> o.o_orderpriority) AS differs_o_orderpriority FROM orders o LEFT JOIN b USING (o_orderkey)""")
def c4(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    b = o.filter("o_totalprice > 2000").withColumn("o_orderpriority", F.when(F.col("o_totalprice") < 10000, "6-OTHER").otherwise(F.col("o_orderpriority")))
    return audits.column_alignment(o, b, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("C5_count_inequalities", f"""WITH {POLICY_SQL} SELECT count(*) AS n_rows, count(*) FILTER (groups_50 > rows_50) AS groups_50_above_rows_50, count(*) FILTER (rows_50 > rows_150) AS rows_50_above_rows_150 FROM policy""")
def c5(spark, d):
    return audits.monotone_violations(atlas_policy(spark, d), ["groups_50", "rows_50", "rows_150"])


RECORD_SQL = f"""{LISTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS ra, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand) AS rb FROM lists),
rec AS (SELECT q, max(tax) * 12.5 AS lib_max, max(tax) < 0.06 AS gate_open, round(sum(disc), 6) > 0.3 AS fired, list(cand ORDER BY ra) FILTER (ra <= 25) AS output, CASE WHEN max(qty) > 45 THEN list(cand ORDER BY rb) FILTER (rb <= 25) ELSE list(cand ORDER BY ra) FILTER (ra <= 25) END AS counterfactual,
 CASE WHEN min(qty) < 2 THEN list(cand ORDER BY rb) FILTER (rb <= 25) ELSE list(cand ORDER BY ra) FILTER (ra <= 25) END AS submitted, CASE WHEN count(*) >= 8 THEN list(cand ORDER BY rb) FILTER (rb <= 25) ELSE list(cand ORDER BY ra) FILTER (ra <= 25) END AS historical FROM r GROUP BY q),
codes AS (SELECT q, unnest(list_filter([CASE WHEN gate_open <> (lib_max < 0.8) THEN 'recorded_gate_disagrees' END, CASE WHEN fired AND lib_max >= 0.8 THEN 'fired_outside_open_gate' END, CASE WHEN output <> submitted THEN 'audit_output_disagrees_with_submission' END,
 CASE WHEN lib_max >= 0.8 AND output <> counterfactual THEN 'protected_complete_order_changed' END, CASE WHEN lib_max >= 0.8 AND output <> historical THEN 'protected_historical_complete_order_changed' END], lambda x: x IS NOT NULL)) AS code FROM rec)"""


@query("C6_protected_order_audit", f"WITH {RECORD_SQL} SELECT code, count(*) AS n_rows FROM codes GROUP BY code")
def c6(spark, d):
    rows = lists(spark, d)

    def top(score, name):
        first = ranking.top_ranked(rows, ["q"], [F.desc(score), F.col("cand")], 25)
        return first.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]).alias(name))

    facts = rows.groupBy("q").agg(F.max("tax").alias("mt"), F.sum("disc").alias("sd"), F.max("qty").alias("xq"), F.min("qty").alias("nq"), F.count(F.lit(1)).alias("n"))
    j = facts.join(top("score", "output"), "q").join(top("score2", "other"), "q")
    pick = lambda c: F.when(c, F.col("other")).otherwise(F.col("output"))
    rec = j.select("q", (F.col("mt") * 12.5).alias("lib_max"), (F.col("mt") < 0.06).alias("gate_open"), (F.round("sd", 6) > 0.3).alias("fired"), "output",
                   pick(F.col("xq") > 45).alias("counterfactual"), pick(F.col("nq") < 2).alias("submitted"), pick(F.col("n") >= 8).alias("historical"))
    codes = rec.select(F.explode(audits.protected_order_codes(rec, 0.8)).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))


@query("C7_slot_change_audit", f"""WITH {LISTS_SQL}, p AS (SELECT q, sup % 3 AS g, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand, sup) AS c, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand, sup) AS t FROM lists),
f AS (SELECT a.q, sum((a.g <> b.g)::INTEGER)::BIGINT AS foreign_group_slots FROM p a JOIN p b ON a.q = b.q AND a.c = b.t GROUP BY a.q)
SELECT q, sum((c <> t)::INTEGER)::BIGINT AS changed_slots, sum(CASE WHEN t <= 3 THEN abs(t - c) ELSE 0 END)::BIGINT AS head_rank_distance, max((c = 1 AND t <> 1)::INTEGER) AS top1_changed, sum((c > 3 AND c <> t)::INTEGER)::BIGINT AS tail_changes, any_value(foreign_group_slots) AS foreign_group_slots FROM p JOIN f USING (q) GROUP BY q""")
def c7(spark, d):
    order = lambda s: [-F.col(s), F.col("cand"), F.col("sup")]
    p = skew.numbered_many(lists(spark, d), ["q"], {"c": order("score"), "t": order("score2")}).select("q", (F.col("sup") % 3).alias("g"), "c", "t")
    return audits.slot_changes(p, "q", "g", "c", "t", 3)


@query("C8_submission_format_audit", f"""WITH {LISTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand, sup) AS r FROM lists),
s AS (SELECT q, string_agg(CASE WHEN qty = 1 THEN ' ' ELSE cand::VARCHAR END, ';' ORDER BY r) AS items FROM k WHERE r <= 25 GROUP BY q),
j AS (SELECT o_orderkey, CASE WHEN s.q IS NOT NULL AND o_totalprice < 5000 THEN o_orderkey + 1 ELSE o_orderkey END AS got, s.q, CASE WHEN o_totalprice > 498000 THEN '' ELSE items END AS items FROM orders LEFT JOIN s ON s.q = o_orderkey),
c AS (SELECT unnest(list_filter([CASE WHEN q IS NULL THEN 'missing' END, CASE WHEN q IS NOT NULL AND got <> o_orderkey THEN 'order' END, CASE WHEN q IS NOT NULL AND items = '' THEN 'empty_list' END, CASE WHEN q IS NOT NULL AND len(string_split(items, ';')) > 8 THEN 'too_many' END,
 CASE WHEN q IS NOT NULL AND items <> '' AND len(list_filter(string_split(items, ';'), lambda x: trim(x) = '')) > 0 THEN 'blank_item' END], lambda x: x IS NOT NULL)) AS problem FROM j)
SELECT problem, count(*) AS n_rows FROM c GROUP BY problem""")
def c8(spark, d):
    rows = lists(spark, d).withColumn("item", F.when(F.col("qty") == 1, " ").otherwise(F.col("cand").cast("string")))
    first = ranking.top_ranked(rows, ["q"], [F.desc("score"), F.col("cand"), F.col("sup")], 25)  # the longest list a submission may have
    sub = first.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]), ";").alias("items"))
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumnRenamed("o_orderkey", "q")
    sub = sub.join(o, "q").select("q", F.when(F.col("o_totalprice") < 5000, F.col("q") + 1).otherwise(F.col("q")).alias("pos"),
                                  F.when(F.col("o_totalprice") > 498000, "").otherwise(F.col("items")).alias("items"))
    return audits.submission_problems(o.select("q", F.col("q").alias("pos")), sub, "q", "pos", "items", 8)


@query("C9_duplicate_slot_audit", f"WITH {LISTS_SQL} SELECT q, count(*) AS slots, count(*) - count(DISTINCT sup % 20) AS duplicate_slots FROM lists GROUP BY q HAVING count(*) > count(DISTINCT sup % 20)")
def c9(spark, d):
    return audits.duplicate_slots(lists(spark, d).select("q", (F.col("sup") % 20).alias("identity")), "q", "identity")


@query("C10_split_release_audit", f"""WITH {ROLE_SQL}, pub AS (SELECT g, CASE WHEN bucket = 17 THEN 18 ELSE bucket END AS bucket, CASE WHEN reason = 'historical' THEN 'final_test' ELSE role END AS role, reason FROM roles WHERE bucket > 20 OR bucket = 17)
SELECT 'left_only' AS check, count(*) FILTER (pub.g IS NULL) AS n_keys FROM roles r LEFT JOIN pub USING (g) UNION ALL SELECT 'right_only', 0 UNION ALL SELECT 'differs_bucket', count(*) FILTER (pub.bucket <> r.bucket) FROM roles r JOIN pub USING (g)
UNION ALL SELECT 'differs_role', count(*) FILTER (pub.role <> r.role) FROM roles r JOIN pub USING (g) UNION ALL SELECT 'differs_reason', count(*) FILTER (pub.reason <> r.reason) FROM roles r JOIN pub USING (g)""")
def c10(spark, d):
    r = roles(spark, d)
    pub = r.filter("bucket > 20 or bucket = 17").withColumn("role", F.when(F.col("reason") == "historical", "final_test").otherwise(F.col("role"))).withColumn(
        "bucket", F.when(F.col("bucket") == 17, 18).otherwise(F.col("bucket")))
    return audits.release_differences(r, pub, "g", ["bucket", "role", "reason"])


@query("C11_shard_audit", """WITH s AS (SELECT doc_id, sha256(text) AS h, lang FROM documents), old AS (SELECT DISTINCT sha256(text) AS h FROM benchmark)
SELECT lang, count(*) AS n_rows, count(*) - count(DISTINCT s.h) AS repeated, count(*) FILTER (old.h IS NOT NULL) AS in_old_bank FROM s LEFT JOIN old USING (h) GROUP BY lang""")
def c11(spark, d):
    s = table(spark, d, "documents", "lang", "text").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    old = table(spark, d, "benchmark", "text").select(F.sha2("text", 256).alias("h")).distinct().withColumn("held", F.lit(True))
    j = s.join(old, "h", "left")
    return j.groupBy("lang").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("in_old_bank"))


@query("C12_record_schema_check", """
WITH r AS (SELECT event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, CASE WHEN value < 1 THEN 'n/a' WHEN value < 2 THEN '-' || value ELSE value::VARCHAR END AS mass FROM events)
SELECT CASE WHEN k >= 95 THEN 'no_star' WHEN event_type = 'error' THEN 'not_released' WHEN try_cast(mass AS DECIMAL(38, 18)) IS NULL THEN 'bad_decimal' WHEN try_cast(mass AS DECIMAL(38, 18)) <= 0 THEN 'nonpositive_mass' ELSE 'admit' END AS disposition, count(*) AS n_rows FROM r GROUP BY 1""")
def c12(spark, d):
    ev = table(spark, d, "events", "event_type", "value", "props")
    text = F.col("value").cast("string")
    mass = F.when(F.col("value") < 1, "n/a").when(F.col("value") < 2, F.concat(F.lit("-"), text)).otherwise(text)
    record = F.struct(F.from_json("props", "k int").alias("props"), F.col("event_type").alias("state"), mass.alias("mass"))
    r = ev.select(F.from_json(F.to_json(record), "props struct<k:int>, state string, mass string").alias("r")).select("r.*")
    dec = F.col("mass").try_cast("decimal(38,18)")
    return aggregates.disposition_counts(r, [("no_star", F.col("props.k") >= 95), ("not_released", F.col("state") == "error"), ("bad_decimal", dec.isNull()), ("nonpositive_mass", dec <= 0)])


@query("C13_novelty_reason", """
WITH p AS (SELECT c_custkey, c_mktsegment || floor(c_acctbal / 20)::BIGINT AS key, c_acctbal AS m FROM customer), f AS (SELECT key, min(c_custkey) AS f FROM p GROUP BY key), old AS (SELECT DISTINCT c_mktsegment || floor(s_acctbal / 20)::BIGINT AS key FROM supplier, (SELECT min(c_mktsegment) AS c_mktsegment FROM customer))
SELECT c_custkey, CASE WHEN old.key IS NOT NULL THEN 'in_old_bank' WHEN c_custkey <> f THEN 'duplicate' WHEN m NOT BETWEEN 100 AND 9000 THEN 'outside_range' ELSE 'eligible' END AS reason FROM p JOIN f USING (key) LEFT JOIN old ON old.key = p.key""")
def c13(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    p = c.select("c_custkey", F.concat(F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 20).cast("string")).alias("key"), F.col("c_acctbal").alias("m"))
    segment = c.agg(F.min("c_mktsegment").alias("seg"))
    old = table(spark, d, "supplier", "s_acctbal").join(F.broadcast(segment)).select(F.concat(F.col("seg"), F.floor(F.col("s_acctbal") / 20).cast("string")).alias("key"))
    return audits.novelty(p, old, "key", "c_custkey", "m", 100.0, 9000.0).select("c_custkey", "reason")


@query("C14_ranked_list_diff", f"""WITH {LISTS_SQL}, a AS (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand, sup) AS r FROM lists), b AS (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY score2 DESC, cand, sup) AS r FROM lists)
SELECT a.q, min(CASE WHEN a.cand <> b.cand THEN a.r END) AS first_difference, count(*) FILTER (a.cand <> b.cand) AS differing_ranks, max((a.r = 1 AND a.cand = b.cand)::INTEGER) AS top_agrees FROM a JOIN b ON a.q = b.q AND a.r = b.r WHERE a.r <= 25 GROUP BY a.q HAVING count(*) FILTER (a.cand <> b.cand) > 0""")
def c14(spark, d):
    rows = lists(spark, d).select("q", "cand", "sup", "score", "score2")
    run = lambda s: ranking.top_ranked(rows, ["q"], [F.desc(s), F.col("cand"), F.col("sup")], 25)
    return audits.list_differences(run("score"), run("score2"), "q", "cand", "rank")
