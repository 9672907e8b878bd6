"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import query, table
from . import bpe, chosen_path, crf, divergence, filter_audit, itq, langid, packing, pii, quality, ring, suffixes, viterbi_count

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From ``links`` (a, b) and ``nodes`` (id): the smallest id that each node reaches, by brute force.
REACH_SQL = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, l.b FROM reach JOIN both_ways l ON l.a = reach.b),
low AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

VECTORS_SQL = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
fine AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
{REACH_SQL}, n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM low LEFT JOIN n USING (id)"""

SHINGLES_SQL = f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
grams AS (SELECT doc_id, len(s) AS size, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.size) AS sa, any_value(b.size) AS sb, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * n >= 75 * (sa + sb - n)), {REACH_SQL}
SELECT id AS doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM low LEFT JOIN sets ON doc_id = id"""

DIVERGENCE_SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
occurs AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM occurs GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(term) AS v, coalesce(sum(total), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occurs o JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, (1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (g.n + v))::BIGINT AS p,
 (1 + (1000000000::HUGEINT * (total + 1)) // (l.n + v))::BIGINT AS q
 FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM dense WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM listed
QUALIFY part = 'pair' OR rank <= 200"""

FILTERS_SQL = """WITH RECURSIVE filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS low FROM docs GROUP BY t),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask
 FROM words JOIN first USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
walk AS (SELECT letter AS prefix, bit AS applied, bit, 1 AS step FROM filters
 UNION ALL SELECT prefix || letter, applied | f.bit, f.bit, step + 1 FROM walk JOIN filters f ON (applied & f.bit) = 0),
steps AS (SELECT part, prefix, step, coalesce(sum(n) FILTER ((mask & applied) = 0), 0) AS kept,
 coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & (applied - bit)) = 0), 0) AS removed,
 coalesce(sum(n) FILTER ((mask & bit) <> 0 AND (mask & (applied - bit)) <> 0), 0) AS redundant,
 coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
 coalesce(sum(good) FILTER ((mask & bit) <> 0 AND (mask & (applied - bit)) = 0), 0) AS good_lost,
 coalesce(sum(toxic) FILTER ((mask & bit) <> 0 AND (mask & (applied - bit)) = 0), 0) AS toxic_lost
 FROM cells CROSS JOIN walk GROUP BY part, prefix, step),
orders AS (SELECT prefix AS filter_order FROM walk WHERE step = 5)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, right(prefix, 1)))::BIGINT AS shapley
FROM orders JOIN steps ON prefix = left(filter_order, step)"""


@query("op1_weak_supervision_pii")
def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_itq_hamming_dedup", VECTORS_SQL)
def op2_itq_hamming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op3_sparse_suffixes")
def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_chosen_path_dedup", SHINGLES_SQL)
def op4_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_viterbi_language")
def op5_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op6_bounded_ring_shards")
def op6_bounded_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_viterbi_token_count")
def op7_viterbi_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_count.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_chunked_byte_bpe")
def op8_chunked_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_harmonic_packing")
def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_distribution_quality")
def op10_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query("op11_crf_toxicity")
def op11_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query("op12_segment_tree_divergence", DIVERGENCE_SQL)
def op12_segment_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents", "text", "lang", "source"))


@query("op13_recursive_filter_audit", FILTERS_SQL)
def op13_recursive_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
