"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import decontaminate, exact_dedup, hard_negatives, html_extract, langid, mixing, packing, prefix_trie, quality, sharding, simhash, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extraction_report(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negative_report(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(_table(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_exact_dedup, op3_revisits, op4_quality, op5_simhash, op6_decontaminate, op7_language, op8_mixing, op9_sharding, op10_html_text, op11_hard_negatives, op12_prefix_trie, op13_packing, pipeline]
    return {f.__name__: f for f in own}


DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

DECONTAMINATE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT doc_id, s, dwin.n, item_id FROM dwin JOIN iwin USING (n, win)),
pos AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(s, s + n)) AS t(p)),
nhit AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN nhit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


REVISITS_SQL = r"""
WITH page AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size,
         1700000000 + page_id * 60 AS ts
  FROM pages),
revisit AS (
  SELECT page_id * 3 + 1 AS record_id, ts + 7 * 86400 AS ts, 'date: second' AS fields, '"' || digest || '"' AS tag,
         regexp_replace(url, '^(https?://)', '\1WWW.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again' AS url
  FROM page
  UNION ALL
  SELECT page_id * 3 + 2, ts + 14 * 86400, 'date: third', CASE WHEN substr(digest, 1, 1) IN ('0', '1', '2', '3') THEN '"changed"' ELSE '"' || digest || '"' END, url
  FROM page),
both_kinds AS (
  SELECT page_id * 3 AS record_id, ts, '' AS fields, '"' || digest || '"' AS tag, url, size, true AS full_response FROM page
  UNION ALL SELECT record_id, ts, fields, tag, url, '', false FROM revisit),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') AS u FROM both_kinds),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), '^(www\d*\.)+', ''), ':(80|443)$', ''), '\.$', '') AS host,
         regexp_replace(regexp_extract(regexp_extract(u, '^[^/?]*(.*)$', 1), '^([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(regexp_extract(u, '^[^/?]*(.*)$', 1), '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|igshid|phpsessid|jsessionid|sid)(=.*)?$'))) AS query
  FROM bare),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS url_key
  FROM parts),
found AS (
  SELECT r.record_id, r.url_key, r.tag, r.fields, s.record_id AS sid, s.tag AS stag, s.size AS ssize,
         row_number() OVER (PARTITION BY r.record_id ORDER BY s.ts DESC NULLS LAST, s.record_id DESC) AS k
  FROM (SELECT * FROM keyed WHERE NOT full_response) r
  LEFT JOIN (SELECT * FROM keyed WHERE full_response) s ON r.url_key = s.url_key AND s.ts < r.ts)
SELECT record_id, url_key, CASE WHEN sid IS NULL THEN 'missing' WHEN tag = stag THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN tag = stag THEN sid END AS response_id,
       CASE WHEN tag = stag THEN 'content-length: ' || ssize || chr(10) || 'content-type: text/html' || chr(10) || fields || chr(10) || 'server: s'
                 || CASE WHEN fields = 'date: third' THEN chr(10) || 'x-cache: hit' ELSE '' END END AS headers
FROM found WHERE k = 1
"""


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

PREFIX_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, chars
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda crc, b:
           list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS part, pos, k, chars FROM c JOIN t ON t.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, k, chars FROM c JOIN t USING (conv_id) WHERE pos >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, chars FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
q AS (
  SELECT conv_id, depth, path, chars, lag(path) OVER w AS parent, lead(path) OVER w IS NULL AS last FROM p
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (
  SELECT path, depth, max(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM q GROUP BY path, depth),
kids AS (SELECT parent AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
sums AS (
  SELECT up.path, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM f JOIN q AS up ON up.conv_id = f.conv_id AND up.depth <= f.depth GROUP BY up.path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN sums USING (path) LEFT JOIN n AS above ON above.path = f.parent AND f.depth > 0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": DEDUP_SQL,
        "op3_revisits": REVISITS_SQL,
        "op6_decontaminate": DECONTAMINATE_SQL,
        "op11_hard_negatives": HARD_NEGATIVES_SQL,
        "op12_prefix_trie": PREFIX_TRIE_SQL,
    }
