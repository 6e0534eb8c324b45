"""The registered queries of the training-data operators, with production
parameters over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import backoff_lm, bloom_cascade, conversation_repair, decontamination, jaccard_join, language_fusion, line_templates, pii_sanitisation, resampling, sentencepiece_codec, shards, spelling_variants, syncmers
from .common import table, written


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return backoff_lm.score_documents(table(spark, sf_dir, "documents"), held_out=F.coalesce(held_out, F.lit(False)))


# The rules of the query's contract; the longest that fits decides.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# A host is listed if its pages link more than the corpus' pages do, by so much.
LINKS_MORE = 1.25


def listed_hosts(pages: DataFrame) -> DataFrame:
    """(key): the hosts with an outsize share of link pages (more anchors than paragraphs), by grouped aggregates."""
    host, _ = bloom_cascade.host_and_path(F.col("url"))
    html = F.coalesce(F.lower("html"), F.lit(""))

    def times(tag: str) -> F.Column:
        return (F.length(html) - F.length(F.replace(html, F.lit(tag), F.lit("")))) / len(tag)
    share = pages.select(host.alias("key"), (times("<a ") > times("<p")).cast("int").alias("links")).groupBy("key").agg(
        F.sum("links").alias("links"), F.count(F.lit(1)).alias("n"))
    share = written(share, "host-links")
    links, n = share.agg(F.sum("links"), F.sum("n")).first()
    return share.where((F.col("key") != "") & (F.col("links") * F.lit(n or 0) > F.col("n") * F.lit(links or 0) * LINKS_MORE)).select("key")


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return bloom_cascade.judge_urls(pages, URL_RULES, listed_hosts(pages))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_documents(table(spark, sf_dir, "documents"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_fusion.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "text_group", "label")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs).select(
        "doc_id", "n_tokens", "parity", "round_trip", F.xxhash64("token_ids").alias("ids_hash"), "token_ids")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_sanitisation.sanitised(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term",
                        F.sha2("clean", 256).alias("clean_sha256"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_line_templates, op3_resampling, op4_backoff_lm, op5_bloom_cascade,
                                 op6_jaccard_join, op7_language_fusion, op8_decontamination, op9_sharding, op10_sentencepiece, op11_spelling,
                                 op12_conversations, op13_pii)}

_RULES = ", ".join(f"('{key}', '{key[: key.index('/')]}', '{key[key.index('/') :]}', '{verdict}')" for key, verdict in URL_RULES)

# CRC-32 in DuckDB: the table of its polynomial, and a fold over a list of bytes.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc)"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295), 4294967295)"


ORACLE: dict[str, str] = {
    "op5_bloom_cascade": f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
linked AS (SELECT host, count(*) AS n, count(*) FILTER ((length(html) - length(replace(lower(html), '<a ', ''))) / 3.0
                                                         > (length(html) - length(replace(lower(html), '<p', ''))) / 2.0) AS links
           FROM parts JOIN pages USING (page_id) GROUP BY host),
listed AS (SELECT host FROM linked WHERE host <> '' AND links * (SELECT sum(n) FROM linked) > n * (SELECT sum(links) FROM linked) * {LINKS_MORE}),
rules AS (SELECT * FROM (VALUES {_RULES}) AS t(key, rule_host, rule_path, verdict)),
fits AS (SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(key, length(key)) AS rule, arg_max(verdict, length(key)) AS said
         FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
         GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN EXISTS (SELECT 1 FROM listed WHERE fits.host = listed.host OR ends_with(fits.host, '.' || listed.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits""",
    "op11_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[a-zÀ-ÿ]+')) AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS m FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, m, {_crc("""flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x) - 64] END))""")} AS h FROM kinds, crc_table),
results AS (SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(m)::BIGINT AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
          UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -near_n, 'w': near}}) AS b FROM pairs GROUP BY word),
forms AS (SELECT w.word, CASE WHEN -b.m >= 5 * n THEN b.w END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * n THEN -b.m END AS form_n
          FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
    "op12_conversations": f"""
WITH RECURSIVE {_CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 {_crc("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)")} % 20 AS k
          FROM conversations, crc_table),
after AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                 CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                  rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body FROM after),
judged AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
                  CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM judged),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS e, {{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s,
         {{'c': 5::BIGINT, 'a': 'I', 't': ['user:']}} AS u, {{'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS v
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([v, {{'c': u.c + 5, 'a': u.a || 'I', 't': u.t || ['assistant:']}}]) FROM (
    SELECT conv_id, i, e, s, v, list_min([u, {{'c': e.c + 5, 'a': e.a || 'I', 't': e.t || ['user:']}}, {{'c': s.c + 5, 'a': s.a || 'I', 't': s.t || ['user:']}},
                                          {{'c': v.c + 5, 'a': v.a || 'I', 't': v.t || ['user:']}}]) AS u FROM (
      SELECT w.conv_id, r.i, {{'c': e.c + 2, 'a': e.a || 'D', 't': e.t}} AS e,
        list_min([{{'c': s.c + 2, 'a': s.a || 'D', 't': s.t}},
                  {{'c': e.c + r.more + CASE WHEN r.x = 's' THEN 0 ELSE 1000000000 END, 'a': e.a || 'K', 't': e.t || [r.role || ':' || r.text]}}]) AS s,
        list_min(list_concat([{{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}}], flatten(list_transform([e, s, v], lambda q: [
                  {{'c': q.c + r.more + CASE WHEN r.x = 'u' THEN 0 ELSE 1000000000 END, 'a': q.a || 'K', 't': q.t || [r.role || ':' || r.text]}},
                  {{'c': q.c + r.more + 1, 'a': q.a || 'R', 't': q.t || ['user:' || r.text]}}])))) AS u,
        list_min([{{'c': v.c + 2, 'a': v.a || 'D', 't': v.t}},
                  {{'c': u.c + r.more + CASE WHEN r.x = 'a' THEN 0 ELSE 1000000000 END, 'a': u.a || 'K', 't': u.t || [r.role || ':' || r.text]}},
                  {{'c': u.c + r.more + 1, 'a': u.a || 'R', 't': u.t || ['assistant:' || r.text]}}]) AS v
      FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
done AS (SELECT conv_id, arg_max(list_min([e, v]), i) AS p FROM walk GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, p.c AS cost, p.a AS audit, sha256(array_to_string(p.t, chr(10))) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id""",
}
