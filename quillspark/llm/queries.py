"""The queries opN_<name> over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import decontam, html_wrappers, lm, packing, quality, secrets, sharding, simhash, substring_dedup, url_filter
from quillspark.llm.common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_html_wrappers(spark, sf_dir):
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op3_interleaved_shards(spark, sf_dir):
    return sharding.interleave_shards(table(spark, sf_dir, "documents"), 40)


def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_simhash_classes(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_attention_scores(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op8_benchmark_overlap(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_passages(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_secret_spans(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP5_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM cut),
parts AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM split),
rules(rule_host, rule_path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BENCH_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {BENCH_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[a:a + least(8, len(w)) - 1], ' ') AS x FROM i, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS q(a) WHERE len(w) > 0),
d AS (SELECT doc_id, {BENCH_WORDS} AS w FROM documents),
s AS (SELECT doc_id, a, k, array_to_string(w[a:a + k - 1], ' ') AS x FROM d, (SELECT DISTINCT k FROM p), unnest(range(1, len(w) + 1)) AS q(a) WHERE a + k - 1 <= len(w)),
h AS (SELECT doc_id, a, k, item FROM s JOIN p USING (k, x)),
n AS (SELECT doc_id, count(DISTINCT b) AS n_hit FROM h, unnest(range(a, a + k)) AS q(b) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


#: The checksum is computed byte by byte, from a table that is built from its polynomial.
OP3_SQL = """
WITH RECURSIVE bits(n, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
b AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, source, t, length(h) // 2 + 16 AS size,
        list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST(instr('0123456789ABCDEF', h[2*i+1]) * 16 + instr('0123456789ABCDEF', h[2*i+2]) - 17 AS BIGINT))) AS bytes FROM b, crc),
c AS (SELECT doc_id, source, coalesce('=' || source, '') AS stratum, size, CAST(xor(list_reduce(bytes, lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM x),
r AS (SELECT *, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32 || ':' || size) AS mix FROM c),
w AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id, text_crc32, size) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS fraction, count(*) OVER () AS total FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, md5('7:' || stratum), stratum, mix, doc_id, text_crc32, size) - 1 AS position FROM w)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 40 // total AS INT) AS shard, CAST(position - (position * 40 // total * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, position, source FROM p
"""


def oracle_sql():
    return {"op3_interleaved_shards": OP3_SQL, "op5_url_filter": OP5_SQL, "op8_benchmark_overlap": OP8_SQL}
