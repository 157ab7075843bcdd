"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow.llm import bpe, chat, decontaminate, filter_audit, fingerprint, language, near_duplicates, pitman_yor, prefix_trie, quality, sharding, urls, warc
from inkrow.llm._common import remainder, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder("doc_id", 3) != 1))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).drop("text")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    return pitman_yor.score(docs, ~held_out).withColumn("held_out", held_out)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.windows(turns.unionByName(more)))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(table(spark, sf_dir, "documents"), percent=85)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language, op2_warc, op3_decontaminate, op4_quality, op5_bpe, op6_pitman_yor, op7_chat, op8_near_duplicates, op9_fingerprint, op10_urls, op11_sharding, op12_filter_audit, op13_prefix_trie, pipeline)}

OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM dwin d JOIN win x ON d.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '(?s)[?#].*', '') END AS r FROM pages),
s AS (
  SELECT page_id, coalesce(translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(substr(r, length(split_part(r, '/', 1)) + 1), '') AS path FROM u),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
j AS (
  SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, s.host, s.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
FROM s LEFT JOIN j ON s.page_id = j.page_id AND s.host = j.host AND s.path = j.path AND j.k = 1
"""

_STEPS = ", ".join(f"('{''.join(o)}', {i + 1}, {sum(1 << 'ABCDE'.index(c) for c in o[:i])}, {1 << 'ABCDE'.index(o[i])})" for o in permutations("ABCDE") for i in range(5))
OP12_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
s(filter_order, step, before, own) AS (VALUES {_STEPS})
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & own <> 0 THEN n * 120 // greatest(bit_count(mask), 1) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

# the remainder of a CRC by its bits, since the SQL engine has no such function
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS s, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, CAST(c AS VARCHAR) AS name, list(s ORDER BY seq) AS ss, list(b ORDER BY seq) AS bs FROM t GROUP BY c),
h AS (SELECT *, CAST(xor(list_reduce(list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(substr(name, CAST(i AS INT), 1)) AS BIGINT)),
    lambda a, x: list_reduce(range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, x)), 4294967295), 4294967295) % 9 AS INT) AS h FROM n),
r AS (SELECT a.c, list_concat(coalesce(z.ss[1:a.h], []), a.ss[a.h + 1:]) AS ss, list_concat(coalesce(z.bs[1:a.h], []), a.bs[a.h + 1:]) AS bs FROM h a LEFT JOIN h z ON z.c = a.c - a.c % 5),
p AS (SELECT c, d, ss[1:d] AS p, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, len(ss) AS n FROM (SELECT *, unnest(range(0, len(ss) + 1)) AS d FROM r)),
g AS (SELECT p, d, min(c) AS c, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS up, count(*) AS k FROM g WHERE d > 0 GROUP BY 1),
e AS (SELECT p, n, b, k.k, unnest(range(0, d + 1)) AS j FROM g LEFT JOIN k ON k.up = g.p),
u AS (SELECT p[1:j] AS a, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * b) AS saved FROM e GROUP BY 1)
SELECT g.c AS conv_id, g.d AS depth, o.c AS parent_conv_id, g.n AS n_convs, coalesce(k.k, 0) AS n_children, CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN u ON u.a = g.p LEFT JOIN k ON k.up = g.p LEFT JOIN g o ON g.d > 0 AND o.p = g.p[1:g.d - 1]
"""

SQL = {"op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL, "op3_decontaminate": OP3_SQL, "op10_urls": OP10_SQL}
