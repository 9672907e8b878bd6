"""Scans, sources and sinks S1-S15; written data is derived from the input tables and read back."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking, sets
from ..sources import digests, npy, readers, sinks
from .registry import query, table
from .stand_ins import LISTS_SQL, lists


@query("S1_scan_spectra", "SELECT vec_id, label, len(embedding) AS n_peaks, round(list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)), 9) AS total FROM embeddings")
def s1(spark, d):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = readers.scan_spectra(spark, f"{d}/embeddings.parquet", schema, ["vec_id", "label", "embedding"])
    total = F.aggregate(F.transform("embedding", lambda x: F.abs(x).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", "label", F.size("embedding").cast("bigint").alias("n_peaks"), F.round(total, 9).alias("total"))


@query("S2_scan_required_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def s2(spark, d):
    return readers.require_columns(table(spark, d, "orders"), {"o_orderkey": "bigint", "o_totalprice": "double"})


@query("S3_scan_npy", "SELECT i AS place, round(embedding[i]::DOUBLE, 6) AS value, count(*) AS n_rows FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i) GROUP BY ALL")
def s3(spark, d):
    path = sinks.scratch(spark, "npy")
    written = npy.write_npy(table(spark, d, "embeddings", "embedding").repartition(4), "embedding", path)
    written.agg(F.sum("rows")).first()
    back = npy.scan_npy(spark, path, rows_per_partition=100)
    every = back.select(F.posexplode("value").alias("i", "v"))
    return every.groupBy((F.col("i") + 1).cast("bigint").alias("place"), F.round(F.col("v").cast("double"), 6).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("S3_scan_npz", """
WITH x AS (SELECT (l_linenumber % 2 = 0) AS even, l_quantity AS half, l_linenumber AS short, l_orderkey AS word, l_orderkey::HUGEINT + 9223372036854775808 AS long FROM lineitem)
SELECT 'even' AS member, count(*) AS n_rows, min(even::INTEGER)::VARCHAR AS low, max(even::INTEGER)::VARCHAR AS high FROM x UNION ALL SELECT 'half', count(*), min(half::INTEGER)::VARCHAR, max(half::INTEGER)::VARCHAR FROM x
UNION ALL SELECT 'short', count(*), min(short)::VARCHAR, max(short)::VARCHAR FROM x UNION ALL SELECT 'word', count(*), min(word)::VARCHAR, max(word)::VARCHAR FROM x UNION ALL SELECT 'long', count(*), min(long)::VARCHAR, max(long)::VARCHAR FROM x""")
def s3_zip(spark, d):
    path, types = sinks.scratch(spark, "npz"), {"even": "?", "half": "f2", "short": "u2", "word": "u4", "long": "u8"}
    rows = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_linenumber")
    big = (F.col("l_orderkey").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)")
    columns = rows.select((F.col("l_linenumber") % 2 == 0).alias("even"), F.col("l_quantity").cast("float").alias("half"), F.col("l_linenumber").alias("short"), F.col("l_orderkey").alias("word"), big.alias("long"), "l_orderkey")
    for odd in (0, 1):  # half of the archives deflated, half stored
        npy.write_npz(columns.filter(F.col("l_orderkey") % 2 == odd), types, path, deflate=bool(odd)).agg(F.sum("rows")).first()
    out = None
    for member in types:
        value = F.col("value").cast("int") if member in ("even", "half") else F.col("value")
        part = npy.scan_npy(spark, path, rows_per_partition=5000, member=f"{member}.npy").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(value).cast("string").alias("low"), F.max(value).cast("string").alias("high")).select(F.lit(member).alias("member"), "n_rows", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


@query("S4_scan_offsets_blob", "SELECT sha256(text) AS digest, count(*) AS n_rows FROM documents GROUP BY 1")
def s4(spark, d):
    path = sinks.scratch(spark, "blob")
    npy.write_blob(table(spark, d, "documents", "text").repartition(4), "text", path).agg(F.sum("rows")).first()
    back = npy.scan_npy(spark, path, kind="blob", rows_per_partition=100)
    return back.groupBy(F.sha2("value", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("S5_scan_delimited", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_nationkey = 3 THEN 'NA' ELSE c_mktsegment END AS segment FROM customer")
def s5(spark, d):
    path = sinks.scratch(spark, "csv")
    segment = F.when(F.col("c_nationkey") == 3, "NA").otherwise(F.col("c_mktsegment")).alias("segment")
    table(spark, d, "customer").select("c_custkey", segment).write.option("header", True).option("compression", "gzip").csv(path)
    return readers.scan_delimited(spark, path, ["c_custkey", "segment"])


@query("S6_scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def s6(spark, d):
    path = sinks.scratch(spark, "jsonl")
    table(spark, d, "conversations").write.json(path)
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return readers.scan_jsonl(spark, path, schema)


@query("S7_scan_strict_json", """SELECT event_id, CASE event_type WHEN 'error' THEN 'repeated key' WHEN 'signup' THEN 'constant NaN' WHEN 'view' THEN 'not_object' WHEN 'purchase' THEN 'malformed' ELSE 'ok' END AS status FROM events""")
def s7(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    text = (F.when(kind == "error", F.concat(F.rtrim(props, F.lit("}")), F.lit(', "k": 0}'))).when(kind == "signup", F.concat(F.rtrim(props, F.lit("}")), F.lit(', "v": NaN}')))
            .when(kind == "view", F.concat(F.lit("["), props, F.lit("]"))).when(kind == "purchase", F.concat(props, F.lit("}"))).otherwise(props))
    return table(spark, d, "events", "event_id", "event_type", "props").select("event_id", readers.strict_json_status(text).alias("status"))


@query("S8_scan_role_table", "SELECT c_custkey AS position, (c_nationkey % 4)::INTEGER AS role FROM customer")
def s8(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey").select("c_custkey", (F.col("c_nationkey") % 4).alias("role"))
    blocks = readers.encode_roles(rows, "c_custkey", "role", 1024)
    decoded = readers.scan_roles(blocks, "block", "payload", 1024)
    return decoded.join(rows.select(F.col("c_custkey").alias("position")), "position", "left_semi")  # drop the padding of the last block


@query("S9_byte_manifest_audit", """
WITH s AS (SELECT DISTINCT c_mktsegment AS seg FROM customer), n AS (SELECT seg, row_number() OVER (ORDER BY seg) AS k FROM s)
SELECT 'seg=' || seg AS folder, CASE k WHEN 1 THEN 'unlisted' WHEN 2 THEN 'size' WHEN 3 THEN 'digest' ELSE 'ok' END AS status FROM n UNION ALL SELECT 'seg=GHOST', 'missing'""")
def s9(spark, d):
    path = sinks.scratch(spark, "audit")
    # one task, so each segment's folder has one file and all have the same base name
    table(spark, d, "customer").withColumn("seg", F.col("c_mktsegment")).repartition(1).write.partitionBy("seg").parquet(path)
    files = digests.file_manifest(spark, path, "*.parquet").checkpoint()
    folder = F.split_part("name", F.lit("/"), F.lit(1))
    segments = table(spark, d, "customer", "c_mktsegment").distinct().select(
        F.concat(F.lit("seg="), "c_mktsegment").alias("folder"), F.row_number().over(Window.orderBy("c_mktsegment")).alias("k"))
    # a listing with planted faults: one file left out, one of another size, one of another digest, one that is not there
    listed = files.withColumn("folder", folder).join(segments, "folder").filter("k <> 1").select(
        "name", (F.col("bytes") + (F.col("k") == 2).cast("int")).alias("bytes"), F.when(F.col("k") == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    ghost = spark.range(1).select(F.lit("seg=GHOST/part-0.parquet").alias("name"), F.lit(1).cast("bigint").alias("bytes"), F.lit("0").alias("sha256"))
    return readers.manifest_audit(digests.file_manifest(spark, path, "*.parquet"), listed.unionByName(ghost)).select(folder.alias("folder"), "status")


@query("S10_before_after_binding", "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, true AS is_permutation, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS nations")
def s10(spark, d):
    path = sinks.scratch(spark, "bound")
    rows = table(spark, d, "supplier")
    rows.write.parquet(path)
    before = digests.file_manifest(spark, path, "*.parquet").checkpoint()
    work = spark.read.parquet(path).agg(F.count_distinct("s_nationkey").alias("nations"))
    after = digests.file_manifest(spark, path, "*.parquet")
    return sets.permutation_report(before, after).join(F.broadcast(work))  # one row each


@query("S11_sink_parquet_verified", "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, true AS is_permutation")
def s11(spark, d):
    return sinks.write_verified(table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"), sinks.scratch(spark, "verified"))


@query("S12_sink_pairs_csv_gz", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice / nullif(l_tax, 0) AS ratio FROM lineitem")
def s12(spark, d):
    path = sinks.scratch(spark, "pairs")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.try_divide(F.col("l_extendedprice"), F.col("l_tax")).alias("ratio"))
    sinks.write_pairs_csv(df, path, ["ratio"])
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("S13_sink_ranked_submission", f"""WITH {LISTS_SQL}, r AS (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM lists)
SELECT o_orderkey AS q, coalesce(string_agg(cand::VARCHAR, ';' ORDER BY rank), '') AS items FROM orders LEFT JOIN r ON q = o_orderkey AND rank <= 3 GROUP BY o_orderkey""")
def s13(spark, d):
    path = sinks.scratch(spark, "submission")
    ranked = ranking.top_ranked(lists(spark, d), ["q"], [F.desc("score"), F.col("cand")], 3)
    out = sinks.ranked_submission(table(spark, d, "orders").select(F.col("o_orderkey").alias("q")), ranked, "q", "cand", "rank", 3)
    sinks.write_submission(out, path, "q")
    back = spark.read.schema("q bigint, items string").option("header", True).csv(path)
    return back.withColumn("items", F.coalesce("items", F.lit("")))


@query("S14_fail_if_exists", "SELECT true AS first_written, false AS second_written, count(*) AS n_rows FROM nation")
def s14(spark, d):
    path = sinks.scratch(spark, "once")
    rows = table(spark, d, "nation")
    first, second = sinks.write_exclusive(rows, path), sinks.write_exclusive(rows, path)
    return spark.read.parquet(path).agg(F.lit(first).alias("first_written"), F.lit(second).alias("second_written"), F.count(F.lit(1)).alias("n_rows"))


@query("S15_row_at_position", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT s_suppkey * 3 FROM supplier)")
def s15(spark, d):
    requests = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("doc_id"))
    return readers.rows_at(table(spark, d, "documents", "doc_id", "lang", "n_chars"), "doc_id", requests)
