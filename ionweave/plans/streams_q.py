"""Streaming forms X1-X3."""

from pyspark.sql import functions as F

from ..operators import rangejoin
from ..sources.sinks import scratch
from ..streaming import coverage, streams
from .aggregates_q import COVERAGE_SQL
from .registry import query, table


@query("X1_stream_window_lookup", """
SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_acctbal BETWEEN s_acctbal - s_acctbal * (500 / 1e6) AND s_acctbal + s_acctbal * (500 / 1e6) WHERE s_acctbal > 0""")
def x1(spark, d):
    bank = rangejoin.store_bank(table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_acctbal", 500.0, scratch(spark, "bank"))
    look = lambda batch: rangejoin.lookup(batch.select("s_suppkey", "s_acctbal"), bank, "s_acctbal", 500.0).select("s_suppkey", "c_custkey")
    return streams.window_lookup(streams.table_stream(spark, d, "supplier"), look)


@query("X2_incremental_scoring", "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS score FROM orders")
def x2(spark, d):
    done = scratch(spark, "scored")
    score = lambda df: df.select("o_orderkey", F.round(F.log1p("o_totalprice"), 9).alias("score"))
    orders = streams.table_stream(spark, d, "orders")
    # three runs into one folder: two disjoint halves, then everything; no row is lost or scored twice
    for part in (orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1")):
        streams.incremental_scores(part, "o_orderkey", score, done)
    return streams.incremental_scores(orders, "o_orderkey", score, done)


@query("X3_incremental_coverage", f"""WITH {COVERAGE_SQL}
SELECT count(*) FILTER (direct) AS with_direct, count(*) FILTER (NOT direct) AS without_direct, count(*) FILTER (NOT direct AND types > 0) AS without_with_any_proxy,
 count(*) FILTER (NOT direct AND am) AS without_with_ammonium, count(*) FILTER (NOT direct AND de) AS without_with_dehydrated,
 count(*) FILTER (NOT direct AND types >= 2) AS without_with_both, count(*) FILTER (NOT direct AND (m_am OR m_de)) AS without_with_two_energies FROM m""")
def x3(spark, d):
    energy = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    events = streams.table_stream(spark, d, "events").select(
        F.concat_ws("-", "user_id", energy % 20).alias("ident"), "event_type", energy.cast("string").alias("sig"))
    return coverage.incremental_coverage(events, "ident", "event_type", "sig", "click", {"view": "ammonium", "purchase": "dehydrated"})[0]
