"""Projections, filters and scalar functions P1-P28."""

from pyspark.sql import functions as F

from ..functions import constants as k
from ..functions import scalars as s
from ..operators import digests
from .registry import query, table
from .stand_ins import ADDUCTS_SQL, SPECTRA_SQL, spectra_meta


@query("P1_neutral_mass", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL}
SELECT event_id, adduct, round((mz * abs_charge - shift_da) / n_mol, 9) AS neutral_mass FROM meta LEFT JOIN adducts USING (adduct)""")
def p1(spark, d):
    df = s.with_adduct(spectra_meta(spark, d))
    return df.select("event_id", "adduct", F.round(s.neutral_mass(F.col("mz")), 9).alias("neutral_mass"))


@query("P2_precursor_mz", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL}
SELECT event_id, round((n_mol * mz * 2 + shift_da) / abs_charge, 9) AS precursor_mz FROM meta LEFT JOIN adducts USING (adduct)""")
def p2(spark, d):
    df = s.with_adduct(spectra_meta(spark, d))
    return df.select("event_id", F.round(s.precursor_mz(F.col("mz") * 2), 9).alias("precursor_mz"))


@query("P3_adduct_polarity_guard", f"""WITH {SPECTRA_SQL}, {ADDUCTS_SQL},
r AS (SELECT event_id, (mz * abs_charge - shift_da) / n_mol AS nm, CASE WHEN adduct = '[M-2H]-' THEN 'ambiguous_charge'
  WHEN n_mol IS NULL THEN 'unsupported_adduct' WHEN mode NOT IN ('positive', 'negative') THEN 'unknown_mode'
  WHEN mode <> polarity THEN 'polarity_disagreement' WHEN mz <= 0 THEN 'bad_precursor_mz'
  WHEN (mz * abs_charge - shift_da) / n_mol <= 0 THEN 'nonpositive_neutral_mass' END AS hold_reason
  FROM meta LEFT JOIN adducts USING (adduct))
SELECT event_id, hold_reason, CASE WHEN hold_reason IS NULL THEN round(nm, 9) END AS neutral_mass FROM r""")
def p3(spark, d):
    df = s.with_adduct(spectra_meta(spark, d))
    df = df.withColumn("hold_reason", s.polarity_hold(F.col("adduct"), F.col("mode"), F.col("mz")))
    return df.select("event_id", "hold_reason",
                     F.when(F.col("hold_reason").isNull(), F.round(s.neutral_mass(F.col("mz")), 9)).alias("neutral_mass"))


CHANNELS_SQL = ("ch(channel, n_mol, abs_charge, shift_da, polarity) AS (VALUES " + ", ".join(
    f"('{a}', {n}, {abs(z)}, {p * k.PROTON_CODATA!r}::DOUBLE, '{'positive' if z > 0 else 'negative'}')"
    for a, n, p, z in k.PROTON_CHANNELS) + ")")


@query("P4_ion_channel_fanout", f"""WITH {CHANNELS_SQL}
SELECT p_partkey, channel, round((n_mol * p_retailprice + shift_da) / abs_charge, 9) AS mz FROM part, ch""")
def p4(spark, d):
    fanned = s.with_channels(table(spark, d, "part", "p_partkey", "p_retailprice"))
    return fanned.select("p_partkey", "channel", F.round(s.precursor_mz(F.col("p_retailprice")), 9).alias("mz"))


@query("P5_fragment_ion_hypotheses", f"""
WITH f AS (SELECT p_partkey, unnest([p_retailprice / 2, p_retailprice / 3]) AS m FROM part WHERE p_type = 'ECONOMY'),
x AS (SELECT DISTINCT p_partkey, m + h * {k.H!r}::DOUBLE + {k.NA - k.ELECTRON!r}::DOUBLE AS ion FROM f, (SELECT unnest([-2, -1, 0, 1, 2]) AS h))
SELECT p_partkey, round(ion, 6) AS ion_mz, row_number() OVER (PARTITION BY p_partkey ORDER BY ion) - 1 AS pos FROM x""")
def p5(spark, d):
    df = table(spark, d, "part", "p_partkey", "p_retailprice", "p_type")
    adduct = F.when(F.col("p_type") == "ECONOMY", "[M+Na]+").otherwise("[M+H]+")
    df = df.filter(s.family_allowed("sodium_retained", adduct, F.lit("positive")))
    masses = F.array(F.col("p_retailprice") / 2, F.col("p_retailprice") / 3)
    ions = df.select("p_partkey", F.posexplode(s.fragment_ions(masses, "sodium_retained")).alias("pos", "ion"))
    return ions.select("p_partkey", F.round("ion", 6).alias("ion_mz"), F.col("pos").cast("bigint").alias("pos"))


@query("P6_ppm_half_width", """
SELECT o_orderkey, o_totalprice * (7 / 1e6) AS half_scaled, o_totalprice * 7 / 1e6 AS half_sequential,
  o_totalprice * (7 / 1e6) <> o_totalprice * 7 / 1e6 AS differs FROM orders""")
def p6(spark, d):
    m = F.col("o_totalprice")
    a, b = m * F.lit(7 / 1e6), m * F.lit(7) / F.lit(1e6)
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", a.alias("half_scaled"), b.alias("half_sequential"), (a != b).alias("differs"))


@query("P7_signed_ppm", """
SELECT l_orderkey, l_partkey, l_suppkey, round((l_extendedprice * (1 - l_discount) - l_extendedprice) / l_extendedprice * 1e6, 3) AS signed_ppm FROM lineitem""")
def p7(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    price = F.col("l_extendedprice")
    return df.select("l_orderkey", "l_partkey", "l_suppkey",
                     F.round(s.signed_ppm(price, price * (1 - F.col("l_discount"))), 3).alias("signed_ppm"))


@query("P8_interpretation_window", f"""
WITH {CHANNELS_SQL}, names(ix, channel) AS (VALUES {', '.join(f"({i}, '{r[0]}')" for i, r in enumerate(k.PROTON_CHANNELS))}),
v AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS x, n_mol, abs_charge, shift_da FROM part JOIN names ON ix = p_partkey % 8 JOIN ch USING (channel)),
w AS (SELECT *, x - x * (10 / 1e6) AS a, x + x * (10 / 1e6) AS b FROM v),
r AS (SELECT p_partkey, 'neutral_monomer_mass' AS basis, x AS c, a AS lo, b AS hi FROM w
 UNION ALL SELECT p_partkey, 'ion_total_mass', (x - shift_da) / n_mol, (a - shift_da) / n_mol, (b - shift_da) / n_mol FROM w
 UNION ALL SELECT p_partkey, 'precursor_mz', (abs_charge * x - shift_da) / n_mol, (abs_charge * a - shift_da) / n_mol, (abs_charge * b - shift_da) / n_mol FROM w)
SELECT p_partkey, basis, CASE WHEN c <= 0 OR lo > c OR c > hi THEN 'HOLD_NONPOSITIVE_OR_INVALID_CENTER' ELSE 'CONDITIONAL_NUMERICAL_WINDOW' END AS status,
  round(c, 9) AS center_da, round(lo, 9) AS lower_da, round(hi, 9) AS upper_da FROM r""")
def p8(spark, d):
    df = table(spark, d, "part", "p_partkey", "p_size")
    names = F.array(*[F.lit(r[0]) for r in k.PROTON_CHANNELS])
    df = df.withColumn("channel", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")))
    df = df.select("p_partkey", F.explode(s.interpretation_windows(F.col("p_size") / F.lit(10.0), F.col("channel"), 10.0)).alias("w"))
    return df.select("p_partkey", "w.basis", "w.status", *[F.round(f"w.{c}", 9).alias(c) for c in ("center_da", "lower_da", "upper_da")])


@query("P9_instrument_family", """
WITH n AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Bruker timsTOF Pro' WHEN 1 THEN 'Q Exactive HF' WHEN 2 THEN 'LC-ESI-QTOF'
  WHEN 3 THEN 'Linear Ion Trap' WHEN 4 THEN 'LC-ESI-QqQ' WHEN 5 THEN c_mktsegment ELSE NULL END AS name FROM customer)
SELECT c_custkey, CASE WHEN contains(lower(name), 'timstof') THEN 0 WHEN regexp_matches(lower(name), 'orbitrap|qft|ftms|hybrid ft|itft|exactive') THEN 1
  WHEN contains(lower(name), 'tof') THEN 2 WHEN regexp_matches(lower(name), 'trap|qq') THEN 3 ELSE 4 END AS family FROM n""")
def p9(spark, d):
    names = F.array(F.lit("Bruker timsTOF Pro"), F.lit("Q Exactive HF"), F.lit("LC-ESI-QTOF"), F.lit("Linear Ion Trap"),
                    F.lit("LC-ESI-QqQ"), F.col("c_mktsegment"), F.lit(None))
    name = F.element_at(names, (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").select("c_custkey", s.instrument_family(name).alias("family"))


@query("P10_adduct_index", f"""WITH {SPECTRA_SQL}
SELECT event_id, coalesce(ix, 25)::INTEGER AS adduct_ix FROM meta LEFT JOIN (VALUES {', '.join(f"('{a}', {i})" for i, a in enumerate(k.ADDUCT_INDEX[:-1]))}) v(adduct, ix) USING (adduct)""")
def p10(spark, d):
    return spectra_meta(spark, d).select("event_id", s.adduct_index(F.col("adduct")).alias("adduct_ix"))


@query("P11_mean_collision_energy", f"""WITH {SPECTRA_SQL},
l AS (SELECT event_id, CASE energy % 10 WHEN 0 THEN NULL WHEN 1 THEN []::DOUBLE[] ELSE [energy::DOUBLE, energy + 2.5, energy * 2.0] END AS es FROM meta),
m AS (SELECT event_id, coalesce(list_sum(es) / nullif(len(es), 0), -1.0)::DOUBLE AS mean_energy FROM l)
SELECT event_id, round(mean_energy, 9) AS mean_energy, round(CASE WHEN mean_energy < 0 THEN 25.0 ELSE mean_energy END::DOUBLE, 9) AS served_energy FROM m""")
def p11(spark, d):
    e = F.col("energy").cast("double")
    es = (F.when(F.col("energy") % 10 == 0, F.lit(None).cast("array<double>"))
          .when(F.col("energy") % 10 == 1, F.array().cast("array<double>")).otherwise(F.array(e, e + 2.5, e * 2)))
    df = spectra_meta(spark, d).select("event_id", s.mean_energy(es).alias("mean_energy"))
    served = F.when(F.col("mean_energy") < 0, F.lit(25.0)).otherwise(F.col("mean_energy"))
    return df.select("event_id", F.round("mean_energy", 9).alias("mean_energy"), F.round(served, 9).alias("served_energy"))


@query("P12_ce_bucket", f"""WITH {SPECTRA_SQL}
SELECT event_id, greatest(5.0, round_even(energy / 2.0 / 5.0, 0) * 5.0)::DOUBLE AS bucket FROM meta""")
def p12(spark, d):
    return spectra_meta(spark, d).select("event_id", s.energy_bucket(F.col("energy") / F.lit(2.0)).alias("bucket"))


SIGNATURE_SQL = """CASE energy % 6 WHEN 0 THEN NULL WHEN 1 THEN energy || ', ' || (energy / 2.0::DOUBLE) WHEN 2 THEN energy || '.50, none,nan'
  WHEN 3 THEN ' Unknown , ' || energy || ' eV' WHEN 4 THEN (energy * 1000000)::VARCHAR ELSE '0.0000' || energy END"""


def energy_text():
    e = F.col("energy").cast("string")
    kind = F.col("energy") % 6
    return (F.when(kind == 0, F.lit(None).cast("string"))
            .when(kind == 1, F.concat(e, F.lit(", "), (F.col("energy") / F.lit(2.0)).cast("string")))
            .when(kind == 2, F.concat(e, F.lit(".50, none,nan"))).when(kind == 3, F.concat(F.lit(" Unknown , "), e, F.lit(" eV")))
            .when(kind == 4, (F.col("energy") * 1000000).cast("string")).otherwise(F.concat(F.lit("0.0000"), e)))


@query("P13_energy_signature", f"""WITH {SPECTRA_SQL}, t AS (SELECT event_id, coalesce({SIGNATURE_SQL}, '') AS txt, CASE event_type WHEN 'click' THEN 'ev' WHEN 'view' THEN 'unknown' ELSE 'nce' END AS unit FROM meta),
u AS (SELECT event_id, trim(tok) AS tok, ord FROM (SELECT event_id, unnest(string_split(txt, ',')) AS tok, generate_subscripts(string_split(txt, ','), 1) AS ord FROM t)),
g AS (SELECT event_id, ord, CASE WHEN try_cast(tok AS DOUBLE) IS NULL THEN tok ELSE printf('%g', try_cast(tok AS DOUBLE)) END AS tok FROM u
  WHERE tok <> '' AND lower(tok) NOT IN ('none', 'nan', 'unknown'))
SELECT t.event_id, coalesce(string_agg(tok, ',' ORDER BY ord), '') AS signature, any_value(unit) AS unit FROM t LEFT JOIN g USING (event_id) GROUP BY t.event_id""")
def p13(spark, d):
    kind = F.col("event_type")
    unit = F.when(kind == "click", " eV ").when(kind != "view", "NCE")
    return spectra_meta(spark, d).select("event_id", s.energy_signature(energy_text()).alias("signature"), s.energy_unit(unit).alias("unit"))


@query("P14_identity_group_id", """
SELECT p_partkey, sha256('[[["C",' || p_size || '],["N",' || (p_partkey % 5 + 1) || '],["O",' || (p_size % 7 + 1) || ']],"' ||
  upper(substr(sha256(p_name), 1, 14)) || '"]') AS group_id FROM part""")
def p14(spark, d):
    atom = lambda symbol, count: F.struct(F.lit(symbol).alias("symbol"), count.cast("int").alias("count"))
    comp = F.array(atom("O", F.col("p_size") % 7 + 1), atom("C", F.col("p_size")), atom("N", F.col("p_partkey") % 5 + 1))
    key = F.upper(F.substring(F.sha2("p_name", 256), 1, 14))
    return table(spark, d, "part", "p_partkey", "p_name", "p_size").select("p_partkey", s.identity_group_id(comp, key).alias("group_id"))


@query("P15_hash_bucket", """
SELECT c_custkey, (('0x' || substr(sha256('split:' || c_custkey), 1, 16))::UBIGINT % 10000)::INTEGER AS bucket,
  (('0x' || substr(sha256('split:' || c_custkey), 1, 16))::UBIGINT % 10)::INTEGER AS fold FROM customer""")
def p15(spark, d):
    text = F.concat(F.lit("split:"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer", "c_custkey").select("c_custkey", s.hash_bucket(text, 10000).alias("bucket"), s.hash_bucket(text, 10).alias("fold"))


@query("P16_stable_hash_order", """
SELECT c_custkey, row_number() OVER (ORDER BY sha256('canary|' || c_custkey)) AS pos FROM customer ORDER BY pos LIMIT 64""")
def p16(spark, d):
    return digests.hash_ordered(table(spark, d, "customer", "c_custkey"), "c_custkey", "canary|", 64)


@query("P17_mass_bin_index", """
SELECT o_orderkey, CASE WHEN m BETWEEN 80 AND 1400 THEN least(floor((m - 80) * 64 / 1320), 63)::INTEGER END AS bin
FROM (SELECT o_orderkey, o_totalprice / 300 AS m FROM orders)""")
def p17(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", s.mass_bin(F.col("o_totalprice") / 300).alias("bin"))


KEY_SQL = """docs AS (SELECT doc_id, sha256(text) AS digest, translate(upper(substr(sha256(text), 1, 25)), '0123456789', 'GHIJKLMNOP') AS letters FROM documents),
keys AS (SELECT doc_id, digest, CASE WHEN doc_id % 5 = 0 THEN lower(letters) ELSE substr(letters, 1, 14) || '-' || substr(letters, 15, 10) || '-' || substr(letters, 25, 1) END AS full_key,
  CASE WHEN doc_id % 4 = 0 THEN substr(letters, 1, 13) ELSE substr(letters, 1, 14) END AS block_key FROM docs)"""


@query("P18_key_syntax_valid", f"""WITH {KEY_SQL}
SELECT doc_id, regexp_full_match(full_key, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') AS full_valid, regexp_full_match(block_key, '[A-Z]{{14}}') AS block_valid,
  regexp_full_match(digest, '[0-9a-f]{{64}}') AS digest_valid FROM keys""")
def p18(spark, d):
    digest = F.sha2("text", 256)
    letters = F.translate(F.upper(F.substring(digest, 1, 25)), "0123456789", "GHIJKLMNOP")
    full = F.when(F.col("doc_id") % 5 == 0, F.lower("letters")).otherwise(
        F.concat_ws("-", F.substring("letters", 1, 14), F.substring("letters", 15, 10), F.substring("letters", 25, 1)))
    block = F.substring(F.col("letters"), F.lit(1), F.when(F.col("doc_id") % 4 == 0, 13).otherwise(14))
    df = table(spark, d, "documents", "doc_id", "text").select("doc_id", digest.alias("digest"), letters.alias("letters"))
    return df.select("doc_id", full.rlike(s.FULL_KEY).alias("full_valid"), block.rlike(s.BLOCK_KEY).alias("block_valid"),
                     F.col("digest").rlike(s.DIGEST_KEY).alias("digest_valid"))


@query("P19_clean_key", """
WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN '  ' ELSE ' ' || source || ' ' END AS a,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS b FROM documents)
SELECT doc_id, CASE WHEN a IS NOT NULL AND lower(trim(a)) NOT IN ('', 'nan') THEN trim(a)
  WHEN b IS NOT NULL AND lower(trim(b)) NOT IN ('', 'nan') THEN trim(b) ELSE '' END AS key FROM p""")
def p19(spark, d):
    m = F.col("doc_id") % 4
    a = (F.when(m == 0, F.lit(None).cast("string")).when(m == 1, "NaN").when(m == 2, "  ")
         .otherwise(F.concat(F.lit(" "), F.col("source"), F.lit(" "))))
    b = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, d, "documents", "doc_id", "source", "lang").select("doc_id", s.clean_key(a, b).alias("key"))


@query("P20_log_popularity", """
SELECT l_orderkey, l_partkey, l_suppkey, p_partkey IS NOT NULL AS matched, round(ln(1 + coalesce(p_size, 0)::DOUBLE) + ln(1 + coalesce(p_partkey % 17, 0)::DOUBLE), 9) AS popularity
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 20) ON p_partkey = l_partkey""")
def p20(spark, d):
    from ..operators.joins import exact_key_lookup
    prior = table(spark, d, "part", "p_partkey", "p_size").filter("p_size > 20").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("sid"), (F.col("p_partkey") % 17).alias("pmid"))
    joined = exact_key_lookup(table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"), prior, "l_partkey")
    return joined.select("l_orderkey", "l_partkey", "l_suppkey", "matched",
                         F.round(s.log_popularity(F.col("sid"), F.col("pmid")), 9).alias("popularity"))


@query("P21_usable_spectrum", """
SELECT vec_id, (vec_id % 7 <> 0 AND vec_id % 11 <> 0 AND vec_id % 13 <> 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
  AND (100 + (vec_id % 5 - 1) * 60)::DOUBLE + 60 * embedding[1]::DOUBLE > 0) AS usable FROM embeddings""")
def p21(spark, d):
    first = (F.lit(100) + (F.col("vec_id") % 5 - 1) * 60).cast("double") + F.lit(60) * F.get("embedding", F.lit(0)).cast("double")
    mz = F.transform("embedding", lambda x, i: F.when((i == 3) & (F.col("vec_id") % 7 == 0), F.lit(float("nan")))
                     .when(i == 0, first).otherwise(F.lit(100.0) + i))
    it = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    it = F.when(F.col("vec_id") % 11 == 0, F.slice(it, 1, 60)).otherwise(it)
    mode = F.when(F.col("vec_id") % 13 == 0, 0.0).otherwise(1.0)
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", s.usable_spectrum(mz, it, mode, F.lit(25.0)).alias("usable"))


@query("P22_quality_filter", f"""WITH {SPECTRA_SQL}
SELECT event_id, round(mz, 6) AS mz FROM meta WHERE energy // 10 >= 3 AND event_type <> 'error' AND NOT coalesce(mode <> 'unknown' AND abs(mz - 130) > 20, false)""")
def p22(spark, d):
    df = spectra_meta(spark, d)
    error = F.when(F.col("mode") != "unknown", F.col("mz") - 130)
    kept = df.filter(s.quality_filter(F.col("mz"), F.floor(F.col("energy") / 10), error, F.col("event_type") != "error"))
    return kept.select("event_id", F.round("mz", 6).alias("mz"))


@query("P23_range_filter", """
SELECT o_orderkey, o_totalprice / 300 AS mass FROM orders WHERE o_totalprice / 300 BETWEEN 80 AND 1400 AND o_custkey % 130 BETWEEN 5 AND 120""")
def p23(spark, d):
    mass = F.col("o_totalprice") / 300
    df = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return df.filter(s.finite(mass) & mass.between(80, 1400) & (F.col("o_custkey") % 130).between(5, 120)).select("o_orderkey", mass.alias("mass"))


@query("P24_license_source_filter", """
SELECT doc_id, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'license' WHEN source IS NULL OR trim(source) = '' OR regexp_matches(lower(source), 'src1[0-9]') THEN 'source' ELSE 'kept' END AS disposition FROM documents""")
def p24(spark, d):
    return table(spark, d, "documents", "doc_id", "lang", "source").select(
        "doc_id", digests.license_disposition(F.col("lang"), "en", F.col("source"), "src1[0-9]").alias("disposition"))


@query("P25_feature32", "SELECT l_orderkey, l_partkey, l_suppkey, (l_extendedprice * 1.1::DOUBLE)::FLOAT::DOUBLE AS feature FROM lineitem")
def p25(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    value = (F.col("l_extendedprice") * F.lit(1.1)).cast("float").cast("double")
    return df.select("l_orderkey", "l_partkey", "l_suppkey", value.alias("feature")).filter(s.finite(F.col("feature")))


@query("P26_admit_or_hold", f"""WITH {SPECTRA_SQL}
SELECT CASE WHEN adduct = '[M+Zz]+' THEN 'hold_adduct' WHEN mode = 'unknown' THEN 'hold_mode' WHEN energy < 10 THEN 'hold_energy' ELSE 'admit' END AS disposition,
  count(*) AS n_rows FROM meta GROUP BY 1""")
def p26(spark, d):
    from ..operators.aggregates import disposition_counts
    rules = [("hold_adduct", F.col("adduct") == "[M+Zz]+"), ("hold_mode", F.col("mode") == "unknown"), ("hold_energy", F.col("energy") < 10)]
    return disposition_counts(spectra_meta(spark, d), rules)


@query("P27_canonical_json_digest", """
SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' || CASE WHEN c_custkey % 9 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END
  || ',"c_nationkey":' || c_nationkey || '}') AS digest FROM customer""")
def p27(spark, d):
    df = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    df = df.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")))
    return df.select("c_custkey", s.canonical_json_digest("c_nationkey", "c_custkey", "c_mktsegment").alias("digest"))


def tree_sql(fan_out: int, levels: int) -> str:
    """CTEs d0, d1, ... of (lang, b, h): digests of blocks, of blocks of blocks, up to one for each language."""
    first = f"d0 AS (SELECT lang, doc_id // {fan_out} AS b, sha256(string_agg(octet_length(encode(text)) || ':' || sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2)"
    return ", ".join([first, *[f"d{k} AS (SELECT lang, b // {fan_out} AS b, sha256(string_agg('64:' || h, '' ORDER BY b)) AS h FROM d{k - 1} GROUP BY 1, 2)" for k in range(1, levels)]])


@query("P28_sequence_digest", f"""WITH {tree_sql(256, 8)}
SELECT lang, h AS sequence_digest, (SELECT sum(('0x' || substr(sha256(text), 1, 15))::HUGEINT)::VARCHAR FROM documents x WHERE x.lang = c.lang) AS multiset_digest FROM d7 c""")
def p28(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    ordered = digests.sequence_digest(docs, ["lang"], "doc_id", "text", fan_out=256)
    return ordered.join(digests.multiset_digest(docs, ["lang"], "text"), "lang")
