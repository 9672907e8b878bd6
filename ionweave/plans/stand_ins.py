"""Domain-shaped views of the input tables, each with the SQL text of the same view for the oracle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ADDUCTS
from ..operators import skew
from .registry import table

BANK_SQL = """bank AS (SELECT p_partkey AS row_id, p_retailprice AS mass, p_brand AS grp, p_type AS src,
    p_size AS prior, ('0x' || substr(sha256(p_name || '|' || p_type), 1, 15))::BIGINT AS fp FROM part)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate bank: mass, group, source, prior and a 60-bit fingerprint word."""
    word = F.conv(F.substring(F.sha2(F.concat_ws("|", "p_name", "p_type"), 256), 1, 15), 16, 10).cast("bigint")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("mass"), F.col("p_brand").alias("grp"),
        F.col("p_type").alias("src"), F.col("p_size").alias("prior"), word.alias("fp"))


EVENT_ADDUCTS = [("click", "[M+H]+"), ("view", "[M+Na]+"), ("signup", "[M-H]-"), ("error", "[M-2H]-"),
                 ("purchase", "[M+Zz]+")]
SPECTRA_SQL = """meta AS (SELECT event_id, user_id, event_type, 100 + value AS mz,
    CASE event_type WHEN 'click' THEN '[M+H]+' WHEN 'view' THEN '[M+Na]+' WHEN 'signup' THEN '[M-H]-'
         WHEN 'error' THEN '[M-2H]-' ELSE '[M+Zz]+' END AS adduct,
    CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_type = 'signup' OR user_id % 5 = 0 THEN 'negative'
         ELSE 'positive' END AS mode,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS energy FROM events)"""
ADDUCTS_SQL = ("adducts(adduct, n_mol, abs_charge, shift_da, polarity) AS (VALUES "
               + ", ".join(f"('{a}', {n}, {z}, {s!r}::DOUBLE, '{p}')" for a, n, z, s, p in ADDUCTS) + ")")


def spectra_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum metadata: precursor m/z, adduct, mode and collision energy."""
    kind = F.col("event_type")
    adduct = F.lit("[M+Zz]+")
    for event, label in EVENT_ADDUCTS[:-1]:
        adduct = F.when(kind == event, label).otherwise(adduct)
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props").select(
        "event_id", "user_id", "event_type", (F.lit(100) + F.col("value")).alias("mz"), adduct.alias("adduct"),
        F.when(F.col("event_id") % 7 == 0, "unknown")
        .when((kind == "signup") | (F.col("user_id") % 5 == 0), "negative").otherwise("positive").alias("mode"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("energy"))


PEAKS_SQL = """peaks AS (SELECT vec_id, label, i, 100 + i * 15 + embedding[i + 1]::DOUBLE * 60 AS mz,
    abs(embedding[i + 1]::DOUBLE) AS it FROM embeddings, (SELECT unnest(range(64)) AS i))"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spectrum with its peaks as an array of (mz, intensity)."""
    pair = F.transform("embedding", lambda x, i: F.struct(
        (F.lit(100) + i * 15 + x.cast("double") * 60).alias("mz"), F.abs(x.cast("double")).alias("intensity")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", pair.alias("peaks"))


def peaks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per peak."""
    return spectra(spark, sf_dir).select("vec_id", "label", F.posexplode("peaks").alias("i", "p")).select(
        "vec_id", "label", "i", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("it"))


BITS_SQL = """bits AS (SELECT vec_id, label, i, (embedding[i + 1] > 0)::INTEGER AS b, embedding[i + 1]::DOUBLE AS x
    FROM embeddings, (SELECT unnest(range(64)) AS i))"""

# one query per order, one candidate per line; score, truth and a second scorer
LISTS_SQL = """lists AS (SELECT l_orderkey AS q, l_partkey AS cand, l_suppkey AS sup, l_extendedprice AS score,
    l_extendedprice * (1 - l_discount) AS score2, l_linenumber AS line, l_tax AS tax, l_quantity AS qty,
    l_discount AS disc FROM lineitem)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists: query, candidate, two scores."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("cand"), F.col("l_suppkey").alias("sup"),
        F.col("l_extendedprice").alias("score"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score2"),
        F.col("l_linenumber").alias("line"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"))


TRUTH_SQL = LISTS_SQL + """,
rows AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY line, cand, sup) = 1)::INTEGER AS y FROM lists)"""


def truth_lists(spark: SparkSession, sf_dir: str, hot: DataFrame | str | None = None) -> DataFrame:
    """Candidate lists with exactly one positive per query: the lowest (line, candidate, supplier); ``hot`` from ``hot_lists`` saves a join."""
    rows = lists(spark, sf_dir)
    ident = F.struct("line", "cand", "sup")
    if hot is skew.BOUNDED:
        return skew.with_stats(rows.filter("q is not null"), ["q"], {"_t": F.min(ident)}, hot).withColumn("y", (ident == F.col("_t")).cast("int")).drop("_t")
    first = rows.groupBy("q").agg(F.min(ident).alias("_t"))
    return rows.join(first, "q").withColumn("y", (ident == F.col("_t")).cast("int")).drop("_t")


def hot_lists(spark: SparkSession, sf_dir: str) -> DataFrame | str:
    """Queries with very long lists, from one count over their column alone; it holds for whatever keeps or drops rows of lists."""
    return skew.find_hot(lists(spark, sf_dir).select("q"), ["q"])


def sample_sql(queries: str, bank: str, width: float, size: int, tag: str) -> str:
    """CTEs that end in ``drawn`` (q, draw, c): the keyed draws from ``queries`` (q, m) and ``bank`` (c, m)."""
    half, mask = "greatest((length(bin(n - 1)) + 1) // 2, 1)", "((1::BIGINT << h) - 1)"
    left, right = "(x >> h)", f"(x & {mask})"
    for turn in range(4):
        left, right = right, f"xor({left}, ((({right} + k + {turn * 40503}) * 2654435761) >> 11) & {mask})"
    walked = f"(({left} << h) | {right})"
    return f"""pos AS (SELECT c, m, row_number() OVER (ORDER BY m, c) - 1 AS p FROM {bank}),
rng AS (SELECT q, count(*) FILTER (pos.m < s.m - {width}::DOUBLE) AS f, count(*) FILTER (pos.m <= s.m + {width}::DOUBLE) AS l FROM {queries} s, pos GROUP BY q),
dr AS (SELECT q, f, l - f AS n, ('0x' || substr(sha256('{tag}:' || q), 1, 7))::BIGINT AS k, unnest(range(least({size}, l - f))) AS d FROM rng WHERE l > f),
wk AS (SELECT q, f, n, k, d, {half} AS h, d::BIGINT AS x, false AS moved FROM dr
  UNION ALL SELECT q, f, n, k, d, h, {walked} AS x, true FROM wk WHERE NOT moved OR x >= n),
drawn AS (SELECT q, d + 1 AS draw, c FROM wk JOIN pos ON p = f + x WHERE moved AND x < n)"""
