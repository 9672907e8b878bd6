"""Bit sets and fingerprints B1-B16."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import fingerprints as fp
from ..operators import sweep
from ..operators.ranking import half_up
from .registry import query, table
from .stand_ins import BITS_SQL

SIGNED = "CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN ({0} - 18446744073709551616::HUGEINT)::BIGINT ELSE {0}::BIGINT END"


def fingerprints(spark, d):
    """Fingerprint bits, the packed word, and the row's values as logits."""
    b = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", "label", b.alias("bits"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def neighbour_pairs(spark, d):
    """(v, v + 1) word pairs."""
    f = fingerprints(spark, d).select("vec_id", bits.pack_words(F.col("bits"), 64).alias("a"))
    other = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    j = f.join(other, "vec_id")
    return j.select("vec_id", bits.intersection(F.col("a"), F.col("b")).alias("inter"), bits.union(F.col("a"), F.col("b")).alias("uni"),
                    bits.popcount(F.col("a")).alias("on_a"), bits.popcount(F.col("b")).alias("on_b"))


NEIGHBOUR_SQL = f"""{BITS_SQL}, nb AS (SELECT a.vec_id, sum(a.b & b.b)::INTEGER AS inter, sum(a.b | b.b)::INTEGER AS uni, sum(a.b)::INTEGER AS on_a, sum(b.b)::INTEGER AS on_b
  FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id)"""


@query("B1_pack_unpack_bits", f"""WITH {BITS_SQL}, p AS (SELECT vec_id, sum(b::HUGEINT * (1::HUGEINT << i)) AS lo, sum(b::HUGEINT * (1::HUGEINT << (63 - i))) AS hi FROM bits GROUP BY vec_id)
SELECT vec_id, {SIGNED.format('lo')} AS little_word, {SIGNED.format('hi')} AS big_word, true AS round_trip FROM p""")
def b1(spark, d):
    little, big = bits.pack_bits(F.col("bits")), bits.pack_bits(F.col("bits"), big_endian=True)
    df = fingerprints(spark, d).select("vec_id", "bits", little.alias("little_word"), big.alias("big_word"))
    return df.select("vec_id", "little_word", "big_word", (bits.unpack_bits(F.col("little_word"), 64) == F.col("bits")).alias("round_trip"))


@query("B2_popcount", f"WITH {BITS_SQL} SELECT vec_id, sum(b)::INTEGER AS on_bits FROM bits GROUP BY vec_id")
def b2(spark, d):
    return fingerprints(spark, d).select("vec_id", bits.popcount(bits.pack_words(F.col("bits"), 64)).alias("on_bits"))


@query("B3_intersection_union", f"WITH {NEIGHBOUR_SQL} SELECT vec_id, inter, uni FROM nb")
def b3(spark, d):
    return neighbour_pairs(spark, d).select("vec_id", "inter", "uni")


@query("B4_tanimoto", f"WITH {NEIGHBOUR_SQL} SELECT vec_id, round(inter::DOUBLE / uni, 9) AS tanimoto FROM nb")
def b4(spark, d):
    return neighbour_pairs(spark, d).select("vec_id", F.round(bits.tanimoto(F.col("inter"), F.col("uni"), 0.0), 9).alias("tanimoto"))


@query("B5_binary_cosine", f"WITH {NEIGHBOUR_SQL} SELECT vec_id, round(inter / sqrt(on_a::DOUBLE * on_b), 9) AS cosine FROM nb")
def b5(spark, d):
    return neighbour_pairs(spark, d).select("vec_id", F.round(bits.binary_cosine(F.col("inter"), F.col("on_a"), F.col("on_b")), 9).alias("cosine"))


@query("B6_hamming", f"WITH {NEIGHBOUR_SQL} SELECT vec_id, on_a + on_b - 2 * inter AS hamming FROM nb")
def b6(spark, d):
    return neighbour_pairs(spark, d).select("vec_id", bits.hamming(F.col("inter"), F.col("on_a"), F.col("on_b")).alias("hamming"))


@query("B7_expected_overlap", f"""WITH {BITS_SQL}, s AS (SELECT a.vec_id, sum(abs(a.x) * b.b) AS dot, sum(abs(a.x)) AS p, sum(b.b) AS n FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1)
SELECT vec_id, round(dot / (p + n - dot), 9) AS overlap FROM s""")
def b7(spark, d):
    f = fingerprints(spark, d)
    p = f.select("vec_id", F.transform("logits", lambda x: F.abs(x)).alias("p"))
    j = p.join(f.select((F.col("vec_id") - 1).alias("vec_id"), "bits"), "vec_id")
    return j.select("vec_id", F.round(bits.expected_overlap(F.col("p"), F.col("bits")), 9).alias("overlap"))


# a mass per vector makes candidate windows: query logits against candidate bits inside 5000 ppm
WINDOW_SQL = f"""{BITS_SQL}, ms AS (SELECT vec_id, 500 + 100 * embedding[1]::DOUBLE AS mass FROM embeddings),
w AS (SELECT q.vec_id AS q, c.vec_id AS c FROM ms q JOIN ms c ON c.mass BETWEEN q.mass - q.mass * (2000 / 1e6) AND q.mass + q.mass * (2000 / 1e6)),
sc AS (SELECT q, c, sum(z.x * b.b) AS dot, sum(CASE WHEN z.i < 32 THEN z.x * b.b ELSE 0 END) AS da, sum(CASE WHEN z.i >= 32 THEN z.x * b.b ELSE 0 END) AS db, sum(b.b) AS n
  FROM w JOIN bits z ON z.vec_id = q JOIN bits b ON b.vec_id = c AND b.i = z.i GROUP BY q, c)"""


BLOCKS = {"dot": (0, 64), "da": (0, 32), "db": (32, 64)}


def window_sides(spark, d, blocks, **more):
    """Queries, bank and settings of the sweep that scores every candidate pair; ``more`` names further columns that candidates carry."""
    f = fingerprints(spark, d).withColumn("m", F.lit(500) + 100 * F.get("logits", F.lit(0)))
    queries = f.select(F.col("vec_id").alias("q"), F.col("m").alias("qm"), F.col("logits").cast("array<float>").alias("logits"))  # as they are stored
    bank = f.select(F.col("vec_id").alias("c"), F.col("m").alias("cm"), bits.pack_words(F.col("bits"), 64).alias("words"), *[v.alias(n) for n, v in more.items()])
    return queries, bank, dict(query_mass="qm", bank_mass="cm", ppm=2000.0, logits="logits", words="words", n_bits=64, blocks={b: BLOCKS[b] for b in blocks})


def window_scores(spark, d, name, score, *blocks):
    """(q, c, ``name``) of every candidate pair in one sweep: what ``score`` makes of the scores of ``blocks`` and the set bits ``n``, at nine decimals."""
    queries, bank, window = window_sides(spark, d, blocks)
    return sweep.window_scores(queries, bank, on_bits="n", made={name: lambda x: half_up(score(x), 9)}, kept=["q", "c"], **window)


@query("B8_logit_dot", f"WITH {WINDOW_SQL} SELECT q, c, round(dot, 9) AS score FROM sc")
def b8(spark, d):
    return window_scores(spark, d, "score", lambda x: x["dot"], "dot")


#: 1,024 hashed bits of a part against logits of the same width, spread from a vector's 64 values.
WIDE_BITS = 1024
WIDE_SQL = f"""qs AS (SELECT vec_id AS q, 900 + 250 * abs(embedding[2]::DOUBLE) AS qm, embedding AS e FROM embeddings),
wb AS (SELECT p_partkey AS c, p_retailprice AS cm, p_name FROM part), pr AS (SELECT * FROM qs JOIN wb ON cm BETWEEN qm - qm * (100 / 1e6) AND qm + qm * (100 / 1e6)),
ws AS (SELECT q, c, e[i % 64 + 1]::DOUBLE * (1 + i // 64) AS z, (('0x' || substr(sha256((i // 256) || '|' || p_name), 1 + 8 * (i % 256 // 32), 8))::BIGINT >> (i % 32)) & 1 AS b
  FROM pr, (SELECT unnest(range({WIDE_BITS})) AS i))"""


@query("B8_wide_logit_dot", f"WITH {WIDE_SQL} SELECT q, c, sum(b)::INTEGER AS on_bits, round(sum(z * b), 6) AS score FROM ws GROUP BY q, c")
def b8_wide(spark, d):
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    queries = v.select(F.col("vec_id").alias("q"), (F.lit(900) + 250 * F.abs(F.get("embedding", F.lit(1)).cast("double"))).alias("qm"), F.col("embedding").alias("z"))
    digest = [F.sha2(F.concat(F.lit(f"{k}|"), "p_name"), 256) for k in range(WIDE_BITS // 256)]
    half = lambda h, k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("bigint")
    words = F.array(*[half(h, k).bitwiseOR(F.call_function("shiftleft", half(h, k + 1), F.lit(32))) for h in digest for k in range(0, 8, 2)])
    bank = table(spark, d, "part", "p_partkey", "p_retailprice", "p_name").select(F.col("p_partkey").alias("c"), F.col("p_retailprice").alias("cm"), words.alias("w"))
    wide = lambda e: np.tile(e, WIDE_BITS // 64) * (1.0 + np.arange(WIDE_BITS) // 64)  # a vector is sent as it is and spread where its window is
    made = {"on_bits": lambda x: x["on_bits"].astype(np.float64), "score": lambda x: half_up(x["score"], 6)}
    out = sweep.window_scores(queries, bank, query_mass="qm", bank_mass="cm", ppm=100.0, logits="z", words="w", n_bits=WIDE_BITS, blocks={"score": (0, WIDE_BITS)},
                              spread=wide, made=made, kept=["q", "c"])
    return out.select("q", "c", F.col("on_bits").cast("int").alias("on_bits"), "score")


@query("B9_bernoulli_loglik", f"""WITH {BITS_SQL},
m AS (SELECT vec_id // 4 AS q, i, sum(x * 5 * (1 + vec_id % 4)) / sum(1 + vec_id % 4) AS z, sum((greatest(x * 5, 0) + ln(1 + exp(-abs(x * 5)))) * (1 + vec_id % 4)) / sum(1 + vec_id % 4) AS sp
  FROM bits WHERE i % 8 <> 0 GROUP BY ALL), k AS (SELECT q, sum(sp) AS constant FROM m GROUP BY q)
SELECT m.q, c.vec_id AS c, round(sum(z * c.b), 8) AS rank_only, round(sum(z * c.b) - max(constant), 8) AS loglik FROM m JOIN k USING (q) JOIN bits c ON c.vec_id // 4 = m.q + 1 AND c.i = m.i GROUP BY ALL""")
def b9(spark, d):
    long = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("bit", "x"))
    spectra = long.select(F.floor(F.col("vec_id") / 4).alias("q"), "bit", (F.col("x").cast("double") * 5).alias("z"),
                          (1 + F.col("vec_id") % 4).cast("double").alias("w"))
    cands = long.filter("x > 0").select(F.col("vec_id").alias("c"), "bit")
    ids = table(spark, d, "embeddings", "vec_id")
    queries = ids.select(F.floor(F.col("vec_id") / 4).alias("q")).distinct()
    pairs = ids.select((F.floor(F.col("vec_id") / 4) - 1).alias("q"), F.col("vec_id").alias("c")).join(queries, "q")
    out = fp.bernoulli_loglik(spectra, pairs, cands, query="q", bit="bit", logit="z", weight="w", candidate="c", excluded=F.col("bit") % 8 == 0)
    return out.select("q", "c", F.round("rank_only", 8).alias("rank_only"), F.round("loglik", 8).alias("loglik"))


@query("B10_block_balanced_score", f"""WITH {WINDOW_SQL}
SELECT q, c, round(CASE WHEN min(da) OVER w = max(da) OVER w THEN 0 ELSE (da - avg(da) OVER w) / stddev_pop(da) OVER w END
  + 0.3 * CASE WHEN min(db) OVER w = max(db) OVER w THEN 0 ELSE (db - avg(db) OVER w) / stddev_pop(db) OVER w END, 6) AS balanced FROM sc WINDOW w AS (PARTITION BY q)""")
def b10(spark, d):
    queries, bank, window = window_sides(spark, d, ("da", "db"))
    return fp.block_balanced(queries, bank, "q", "da", "db", digits=6, kept=["q", "c"], **window)


@query("B11_logit_blend", f"WITH {WINDOW_SQL} SELECT q, c, round((0.9 * da + 0.1 * db) / sqrt(greatest(n, 1)), 9) AS blended FROM sc")
def b11(spark, d):
    return window_scores(spark, d, "blended", lambda x: (0.9 * x["da"] + 0.1 * x["db"]) / np.sqrt(np.maximum(x["n"], 1)), "da", "db")


@query("B12_bit_frequency_select", f"""WITH {BITS_SQL}
SELECT i AS bit, sum(b)::BIGINT AS n_set, round(avg(b), 9) AS frequency FROM bits GROUP BY i HAVING avg(b) BETWEEN 0.48 AND 0.52 AND sum(b) BETWEEN 1 AND count(*) - 1""")
def b12(spark, d):
    freq = fp.bit_frequencies(fingerprints(spark, d), "bits")
    return freq.filter("frequency between 0.48 and 0.52 and n_set > 0 and frequency < 1").withColumn("frequency", F.round("frequency", 9))


@query("B13_project_bits", f"""WITH {BITS_SQL}, s AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM bits GROUP BY i HAVING avg(b) BETWEEN 0.48 AND 0.52)
SELECT vec_id, sum(b::HUGEINT << k)::BIGINT AS word FROM bits JOIN s USING (i) GROUP BY vec_id""")
def b13(spark, d):
    f = fingerprints(spark, d)
    chosen = fp.bit_frequencies(f, "bits").filter("frequency between 0.48 and 0.52").select("bit", F.col("bit").alias("pos"))
    return fp.projected(f, "bits", chosen, "bit", "pos", "kept").select("vec_id", bits.pack_bits(F.col("kept")).alias("word"))


@query("B14_drop_zero_key", f"""WITH {BITS_SQL}
SELECT vec_id, CASE WHEN (SELECT max(b) FROM bits WHERE i = 0) = 0 THEN 63 ELSE 64 END AS used_width, 64 AS padded_width, sum(b)::INTEGER AS on_bits FROM bits GROUP BY vec_id""")
def b14(spark, d):
    f = fingerprints(spark, d)
    f = fp.drop_unused_first(f, "bits", "used")
    f = fp.drop_unused_first(f.withColumn("padded", F.concat(F.array(F.lit(0)), "bits")), "padded", "rest")
    on = F.aggregate("rest", F.lit(0), lambda acc, x: acc + x)
    return f.select("vec_id", F.size("used").alias("used_width"), F.size("rest").alias("padded_width"), on.alias("on_bits"))


@query("B15_binned_cosine", """
WITH e AS (SELECT user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 5 AS bin, max(value) AS v FROM events GROUP BY ALL),
a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT * FROM e WHERE event_type = 'view'),
d AS (SELECT user_id, sum(a.v * b.v) AS dot, count(*) AS common_bins FROM a JOIN b USING (user_id, bin) GROUP BY 1)
SELECT user_id, coalesce(common_bins, 0) AS common_bins, round(coalesce(dot, 0) / (na * nb), 9) AS cosine FROM (SELECT user_id, sqrt(sum(v * v)) AS na FROM a GROUP BY 1)
JOIN (SELECT user_id, sqrt(sum(v * v)) AS nb FROM b GROUP BY 1) USING (user_id) LEFT JOIN d USING (user_id)""")
def b15(spark, d):
    v = table(spark, d, "events", "event_id", "user_id", "event_type", "value", "props").select(
        "user_id", "event_type", F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("int") / 5).alias("bin"), "value")
    out = fp.binned_cosine(v.filter("event_type = 'click'"), v.filter("event_type = 'view'"), ["user_id"], "bin", "value")
    return out.filter(F.col("cosine").isNotNull()).withColumn("cosine", F.round("cosine", 9))


@query("B16_mean_logits", f"WITH {BITS_SQL} SELECT label, i AS bit, round(avg(x), 9) AS mean_logit FROM bits GROUP BY ALL")
def b16(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("bit", "x"))
    means = fp.weighted_mean_logits(long.select("label", "bit", F.col("x").cast("double").alias("x")), "label", "bit", "x")
    return means.withColumn("mean_logit", F.round("mean_logit", 9))
