"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprint, html, langid, neardup, packing, ranked, sharding, tokenfile, topk, toxicity, urls
from .common import fresh_dir, table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), hundred=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), fresh_dir(spark, "tokens"))
    return tokenfile.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), langid.remainder(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (langid.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, langid.remainder(F.col("doc_id"), 5) != 0)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (langid.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urls.judge_urls(pages, urls.rules_table(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, present = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(rows, present=present)


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_bpe": op2_bpe,
    "op3_top_k": op3_top_k,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_byte_shards": op8_byte_shards,
    "op9_url_rules": op9_url_rules,
    "op10_fingerprints": op10_fingerprints,
    "op11_main_text": op11_main_text,
    "op12_ranked_search": op12_ranked_search,
    "op13_conversations": op13_conversations,
}

ORACLE = {
    "op3_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
""",
    "op9_url_rules": r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT u.rid, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN fits f ON f.rid = u.rid AND f.k = 1
""",
    "op12_ranked_search": r"""
WITH t AS (
  SELECT doc_id, rid, unnest(terms) AS term FROM (
    SELECT doc_id, row_number() OVER () AS rid,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents)),
d AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY rid),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
r AS (
  SELECT q.item_id, p.rid,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * d.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN d ON d.rid = p.rid, s
  GROUP BY q.item_id, p.rid),
k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score
  FROM r JOIN d ON d.rid = r.rid WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
""",
}
