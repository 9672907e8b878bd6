"""Splits, components, negatives and samplers K1-K14."""

from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket
from ..operators import components as cc
from ..operators import joins, splits
from ..sources.sinks import scratch
from .joins_q import PAIRS_SQL, atlas_sides
from .registry import query, table
from .stand_ins import BANK_SQL, SPECTRA_SQL, bank, spectra_meta

BUCKET = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT % {1}"
ROLE_SQL = f"""b AS (SELECT o_custkey AS g, ({BUCKET.format("'role:' || o_custkey", 10000)})::INTEGER AS bucket, max(o_totalprice) > 499000 AS hist, min(o_totalprice) < 2000 AS prior FROM orders GROUP BY o_custkey),
roles AS (SELECT g, bucket, CASE WHEN hist OR (prior AND bucket >= 9500) THEN 'optimizer' WHEN bucket < 8000 THEN 'optimizer' WHEN bucket < 9000 THEN 'checkpoint_selection' WHEN bucket < 9500 THEN 'fusion_selection' ELSE 'final_test' END AS role,
 CASE WHEN hist THEN 'historical' WHEN prior AND bucket >= 9500 THEN 'prior_selection' ELSE 'fixed_hash' END AS reason FROM b)"""


def roles(spark, d):
    g = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("g")).agg(
        (F.max("o_totalprice") > 499000).alias("hist"), (F.min("o_totalprice") < 2000).alias("prior"))
    return splits.hash_role(g, "g", "role", F.col("hist"), F.col("prior")).drop("hist", "prior")


@query("K1_hash_role_split", f"WITH {ROLE_SQL} SELECT * FROM roles")
def k1(spark, d):
    return roles(spark, d)


@query("K2_train_dev_split", f"SELECT c_custkey, CASE WHEN {BUCKET.format(chr(39) + 'dev:' + chr(39) + ' || c_custkey', 10000)} < 8000 THEN 'train' ELSE 'dev' END AS split FROM customer")
def k2(spark, d):
    b = hash_bucket(F.concat(F.lit("dev:"), F.col("c_custkey").cast("string")), 10000)
    return table(spark, d, "customer", "c_custkey").select("c_custkey", F.when(b < 8000, "train").otherwise("dev").alias("split"))


@query("K3_propagate_group_role", f"""WITH {ROLE_SQL}, all_roles AS (SELECT g, role FROM roles UNION ALL SELECT g, 'final_test' FROM b WHERE prior)
SELECT c_custkey, CASE WHEN lo IS NULL THEN 'missing' WHEN lo <> hi THEN 'conflict' ELSE lo END AS role FROM customer LEFT JOIN (SELECT g, min(role) AS lo, max(role) AS hi FROM all_roles GROUP BY g) ON g = c_custkey""")
def k3(spark, d):
    again = table(spark, d, "orders", "o_custkey", "o_totalprice").filter("o_totalprice < 2000").select(F.col("o_custkey").alias("g"), F.lit("final_test").alias("role"))
    rows = table(spark, d, "customer", "c_custkey").select("c_custkey", F.col("c_custkey").alias("g"))
    return splits.propagate_role(rows, roles(spark, d).select("g", "role").unionByName(again), "g").drop("g")


@query("K4_forced_plus_sampled_holdout", """
WITH p AS (SELECT o_custkey, max(o_totalprice) > 495000 AS forced FROM orders GROUP BY 1), x AS (SELECT o_custkey FROM p WHERE NOT forced ORDER BY sha256('hold:' || o_custkey), o_custkey LIMIT 200)
SELECT p.o_custkey, CASE WHEN forced THEN 'forced' WHEN x.o_custkey IS NOT NULL THEN 'sampled' ELSE 'train' END AS split FROM p LEFT JOIN x USING (o_custkey)""")
def k4(spark, d):
    return splits.forced_plus_sampled(table(spark, d, "orders", "o_custkey", "o_totalprice"), "o_custkey", F.col("o_totalprice") > 495000, 200, "hold:")


def digest_sql(comp: str, member: str, source: str) -> str:
    return f"SELECT {comp}, sha256(sum(('0x' || substr(sha256({member}::VARCHAR), 1, 15))::HUGEINT)::VARCHAR || ':' || count(*)) AS digest, count(*) AS size FROM {source} GROUP BY {comp}"


@query("K5_connected_component_split", f"""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS s, floor(o_totalprice)::BIGINT AS f FROM orders),
link AS (SELECT DISTINCT a.s AS a, b.s AS b FROM e a JOIN e b USING (f)), reach AS (SELECT s AS a, s AS b FROM e UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS o_custkey, min(b) AS c FROM reach GROUP BY a), dg AS ({digest_sql('c', 'o_custkey', 'comp')}),
o AS (SELECT c, size, row_number() OVER (ORDER BY sha256('split:' || digest), c) AS pos, count(*) OVER () AS n FROM dg)
SELECT o_custkey, size, CASE WHEN pos <= n // 2 THEN 'fit' WHEN pos <= n // 2 + greatest(1, n // 4) THEN 'dev' ELSE 'test' END AS split FROM comp JOIN o USING (c)""")
def k5(spark, d):
    e = table(spark, d, "orders", "o_custkey", "o_totalprice").select("o_custkey", F.floor("o_totalprice").alias("f")).distinct()
    return splits.component_split(e, "o_custkey", "f", "split")


def linked_rows(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", F.floor(F.col("c_acctbal") * 2).alias("key1"), F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 3)).alias("key2"),
        F.col("c_acctbal").alias("m"))


def component_folds(spark, d):
    rows = linked_rows(spark, d)
    alias = cc.connected_components(cc.key_edges(rows, "c_custkey", ["key1", "key2"]), "a", "b")
    comp = cc.merged_components(alias, splits.mass_chain(rows, "c_custkey", "m", 40.0))
    digests = cc.set_digest(comp, "component", "node")
    out = rows.join(alias.select(F.col("node").alias("c_custkey"), F.col("component").alias("alias")), "c_custkey")
    out = out.join(comp.withColumnRenamed("node", "c_custkey"), "c_custkey").join(digests, "component")
    return out.withColumn("fold", splits.fold_of(F.concat(F.lit("fold:"), F.col("digest"))))


COMPONENT_SQL = f"""WITH RECURSIVE r AS (SELECT c_custkey AS id, floor(c_acctbal * 2)::BIGINT AS key1, c_nationkey || '|' || c_mktsegment || '|' || floor(c_acctbal / 3)::BIGINT AS key2, c_acctbal AS m FROM customer),
k AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.key1 = b.key1 UNION SELECT a.id, b.id FROM r a JOIN r b ON a.key2 = b.key2),
near AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.m > 0 AND b.m BETWEEN a.m - a.m * (40 / 1e6) AND a.m + a.m * (40 / 1e6)),
l AS (SELECT * FROM k UNION SELECT * FROM near UNION SELECT b, a FROM near),
ra AS (SELECT id AS a, id AS b FROM r UNION SELECT ra.a, k.b FROM ra JOIN k ON ra.b = k.a), rc AS (SELECT id AS a, id AS b FROM r UNION SELECT rc.a, l.b FROM rc JOIN l ON rc.b = l.a),
al AS (SELECT a AS c_custkey, min(b) AS alias FROM ra GROUP BY a), co AS (SELECT a AS c_custkey, min(b) AS component FROM rc GROUP BY a), dg AS ({digest_sql('component', 'c_custkey', 'co')}),
folds AS (SELECT c_custkey, alias, component, size, CASE {BUCKET.format("'fold:' || digest", 10)} WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS fold FROM al JOIN co USING (c_custkey) JOIN dg USING (component))"""


@query("K6_multi_key_component_split", COMPONENT_SQL + " SELECT c_custkey, alias, component, size, fold FROM folds")
def k6(spark, d):
    return component_folds(spark, d).select("c_custkey", "alias", "component", "size", "fold")


@query("K6_fold_crossings", COMPONENT_SQL + """ SELECT key, sum(x)::BIGINT AS crossing_values, count(*) AS n_values FROM (SELECT 'key1' AS key, key1::VARCHAR AS v, (min(fold) <> max(fold))::INTEGER AS x FROM r JOIN folds ON id = c_custkey GROUP BY key1
 UNION ALL SELECT 'key2', key2, (min(fold) <> max(fold))::INTEGER FROM r JOIN folds ON id = c_custkey GROUP BY key2 UNION ALL SELECT 'alias', alias::VARCHAR, (min(fold) <> max(fold))::INTEGER FROM folds GROUP BY alias) GROUP BY key""")
def k6_crossings(spark, d):
    return splits.crossing_values(component_folds(spark, d), ["key1", "key2", "alias"], "fold")


NEGATIVE_SQL = f"""{PAIRS_SQL}, nm AS (SELECT p_partkey, p_name, p_type, split_part(p_name, ' ', 1) AS alias FROM part),
d0 AS (SELECT query_row, candidate_row, inter, uni, c.alias, CASE WHEN a.p_name = c.p_name THEN 'same_connectivity' WHEN a.p_type = c.p_type THEN 'same_group' WHEN qfp = cfp THEN 'identical_fingerprint' WHEN a.alias = c.alias THEN 'same_alias' END AS r0
  FROM pairs JOIN nm a ON a.p_partkey = query_row JOIN nm c ON c.p_partkey = candidate_row),
d1 AS (SELECT *, CASE WHEN r0 IS NULL THEN row_number() OVER (PARTITION BY query_row, alias, r0 IS NULL ORDER BY candidate_row) END AS k FROM d0),
disp AS (SELECT query_row, candidate_row, coalesce(r0, CASE WHEN k > 1 THEN 'redundant_alias' END) AS reason, CASE WHEN r0 IS NULL AND k = 1 THEN CASE WHEN 4 * inter < uni THEN 0 WHEN 2 * inter < uni THEN 1 ELSE 2 END END AS stage, inter, uni FROM d1)"""


NEGATIVES = splits.Negatives("query_row", "candidate_row", "c_alias", ("qfp", "cfp"), [
    ("same_connectivity", "q_name", "c_name"), ("same_group", "q_type", "c_type"), ("identical_fingerprint", "qfp", "cfp"), ("same_alias", "q_alias", "c_alias")])


def negative_sides(spark, d):
    names = table(spark, d, "part", "p_partkey", "p_name", "p_type").select(
        F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("alias"))
    return atlas_sides(spark, d, more=names)


@query("K7_hard_negative_select", f"""WITH {NEGATIVE_SQL}
SELECT query_row, candidate_row, reason, stage, CASE WHEN stage IS NOT NULL THEN row_number() OVER (PARTITION BY query_row, stage IS NULL ORDER BY inter / uni DESC, candidate_row) END AS pos FROM disp""")
def k7(spark, d):
    queries, rows, window = negative_sides(spark, d)
    return splits.ranked_negatives(queries, rows, NEGATIVES, **window)


@query("K8_staged_negative_pools", f"""WITH {NEGATIVE_SQL} SELECT query_row, count(*) AS pairs, coalesce(sum((stage <= 0)::INTEGER), 0)::BIGINT AS pool_0, coalesce(sum((stage <= 1)::INTEGER), 0)::BIGINT AS pool_1,
 coalesce(sum((stage <= 2)::INTEGER), 0)::BIGINT AS pool_2 FROM disp GROUP BY query_row""")
def k8(spark, d):
    queries, rows, window = negative_sides(spark, d)
    return splits.staged_pools(queries, rows, NEGATIVES, **window)


def modulus_sql(token: str, n: str) -> str:
    """256-bit sha256 modulo n by eight 32-bit Horner steps."""
    r = "0::HUGEINT"
    for i in range(8):
        r = f"(({r}) * 4294967296 + ('0x' || substr(sha256({token}), {1 + 8 * i}, 8))::BIGINT) % {n}"
    return f"({r})"


@query("K9_deterministic_negative_sample", f"""WITH {NEGATIVE_SQL}, p AS (SELECT query_row, candidate_row, row_number() OVER (PARTITION BY query_row ORDER BY candidate_row) - 1 AS k, count(*) OVER (PARTITION BY query_row) AS pool_size FROM disp WHERE stage <= 1)
SELECT query_row, candidate_row, pool_size FROM p WHERE k = {modulus_sql("'neg:' || query_row || ':1:3'", 'pool_size')}""")
def k9(spark, d):
    queries, rows, window = negative_sides(spark, d)
    return splits.sampled_negative(queries, rows, NEGATIVES, "neg", 1, 3, **window)


DECOY_SQL = f"""{BANK_SQL}, po AS (SELECT row_id, mass, row_number() OVER (ORDER BY mass, row_id) - 1 AS pos FROM bank), tot AS (SELECT count(*) AS n FROM bank),
rg AS (SELECT Q.id, Q.own, (SELECT count(*) FROM po WHERE mass < Q.m - Q.m * (100 / 1e6)) AS f, (SELECT count(*) FROM po WHERE mass <= Q.m + Q.m * (100 / 1e6)) AS l FROM Q),
dr AS (SELECT rg.*, draw, po.pos AS ownpos, CASE WHEN l - f <= 1 THEN {modulus_sql("'SEED:' || id || ':' || draw", '(SELECT n FROM tot)')} ELSE f + {modulus_sql("'SEED:' || id || ':' || draw", 'greatest(l - f, 1)')} END AS c FROM rg, (SELECT unnest(range(DRAWS)) AS draw) LEFT JOIN po ON po.row_id = own),
st AS (SELECT id, draw, CASE WHEN l - f <= 1 OR c <> coalesce(ownpos, -1) THEN c WHEN c + 1 < l THEN c + 1 ELSE f END AS pos FROM dr),
decoys AS (SELECT id, draw::INTEGER AS draw, row_id AS decoy_row FROM st JOIN po USING (pos))"""


@query("K10_window_decoys", f"WITH {DECOY_SQL.replace('SEED', 'decoy').replace('DRAWS', '63').replace('rg AS', 'Q AS (SELECT row_id AS id, row_id AS own, mass AS m FROM bank), rg AS', 1)} SELECT id AS query_row, draw, decoy_row, 'OK' AS status FROM decoys")
def k10(spark, d):
    b = bank(spark, d)
    q = b.select(F.col("row_id").alias("query_row"), F.col("mass").alias("qm")).withColumn("own", F.col("query_row"))
    return splits.window_decoys(q, b, query_id="query_row", query_mass="qm", own_row="own", mass="mass", row="row_id", ppm=100.0, draws=63, seed="decoy")


@query("K11_structure_uniform_sample", """
SELECT user_id, arg_min(event_id, (sha256('s5:row:' || event_id), event_id)) AS event_id FROM events GROUP BY user_id ORDER BY sha256('s5:structure:' || user_id), user_id LIMIT 64""")
def k11(spark, d):
    return splits.structure_uniform(table(spark, d, "events", "event_id", "user_id"), "user_id", "event_id", "s5", 64)


@query("K12_compatible_peers", f"""WITH {SPECTRA_SQL}, m AS (SELECT user_id, adduct, mode, event_id, row_number() OVER (PARTITION BY user_id, adduct, mode ORDER BY sha256('peer:' || event_id), event_id) AS p, count(*) OVER (PARTITION BY user_id, adduct, mode) AS n FROM meta),
w AS (SELECT *, CASE WHEN n < 2 THEN 1 ELSE 2 + {modulus_sql("'peer:size:' || event_id", 'greatest(least(n, 4) - 1, 1)')} END AS want FROM m), s AS (SELECT *, unnest(range(want::BIGINT)) AS k FROM w)
SELECT s.user_id, s.adduct, s.mode, s.event_id AS anchor, m.event_id AS peer FROM s JOIN m ON m.user_id = s.user_id AND m.adduct = s.adduct AND m.mode = s.mode AND m.p = (s.p - 1 + s.k) % s.n + 1""")
def k12(spark, d):
    return splits.compatible_peers(spectra_meta(spark, d), ["user_id", "adduct", "mode"], "event_id", "peer")


@query("K13_optimizer_reference_view", f"""WITH {ROLE_SQL}, held AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 480000)
SELECT o_orderkey, o_custkey FROM orders JOIN roles ON g = o_custkey WHERE role = 'optimizer' AND o_custkey NOT IN (SELECT o_custkey FROM held)""")
def k13(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    keep = roles(spark, d).filter("role = 'optimizer'").select(F.col("g").alias("o_custkey"))
    held = orders.filter("o_orderpriority = '1-URGENT' and o_totalprice > 480000")
    return joins.new_only(joins.members_only(orders, keep, "o_custkey"), held, "o_custkey").select("o_orderkey", "o_custkey")


@query("K14_fixed_validation_panel", f"""WITH {DECOY_SQL.replace('SEED', 'panel').replace('DRAWS', '63').replace('rg AS', '''fs AS (SELECT l_partkey AS st, min(l_orderkey * 1000000 + l_partkey) AS id FROM lineitem GROUP BY 1),
Q AS (SELECT st AS own, id, mass AS m FROM (SELECT * FROM fs ORDER BY sha256('panel:' || st), st LIMIT 2048) JOIN bank ON row_id = st), rg AS''', 1)} SELECT own AS st, decoys.id, draw, decoy_row, 'OK' AS status FROM decoys JOIN Q ON Q.id = decoys.id""")
def k14(spark, d):
    masses = bank(spark, d).select(F.col("row_id").alias("st"), F.col("mass").alias("sm"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_partkey").alias("st"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"))
    return splits.validation_panel(rows.join(masses, "st"), bank(spark, d), structure="st", row="id", size=2048, seed="panel", structure_mass="sm", mass="mass",
                                   bank_row="row_id", ppm=100.0, draws=63, path=scratch(spark, "panel"))
