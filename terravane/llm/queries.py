"""The operators applied to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, langid, line_dedup, minhash, mixing, quality_mil, quality_rules, secret_scan, sp_wfst, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [
    url_filter.path_rule("block", "com/en/"),
    url_filter.path_rule("allow", "example.com/en/7"),
    url_filter.path_rule("allow", "net/de/"),
    url_filter.path_rule("block", "example.net/de/8"),
    url_filter.path_rule("block", "org/es/"),
    *(url_filter.host_word_rule(w) for w in ("ads-track", "casino-win", "cheap-pills", "free-bets")),
]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learn = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = langid.sample_labelled(learn.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")), langid.SAMPLE_PER_LANGUAGE, langid.LANGUAGES)
    model = langid.fit(rows["text"].tolist(), rows["label"].tolist())
    out = langid.predict_languages(docs, model)
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    return out.select(F.col("id").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where("doc_id is not null and label in (0, 1)")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learn = labels.where(~fold)
    counts = {r[0]: r[1] for r in learn.groupBy("label").count().collect()}
    drawn = langid.draw(learn, counts, quality_mil.SAMPLE_PER_LABEL, "doc_id")
    # a bounded sample of the labels meets the documents, so it may be broadcast
    drawn = drawn.select("doc_id", "label").distinct()
    few = spark.createDataFrame(drawn.collect(), drawn.schema)
    # one text for each label drawn, however often an id is repeated
    rows = docs.join(F.broadcast(few), "doc_id").where("text is not null").groupBy("doc_id", "label").agg(F.min("text").alias("text")).toArrow().to_pandas().sort_values(["doc_id", "text"], kind="stable")
    share = counts.get(1, 0) / (sum(counts.values()) or 1)
    model = quality_mil.fit(rows["text"].tolist(), rows["label"].tolist())
    # the sample is balanced; the scores go by the shares of the labels
    model.restore_prior(share, rows["label"].mean() if len(rows) else 0.5)
    out = quality_mil.score_quality(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_line_chunks(table(spark, sf_dir, "documents"))
    x = F.col("__tv_lines")
    return out.select("doc_id", x["n_lines"].alias("n_lines"), x["n_removed_chunks"].alias("n_removed_chunks"), x["n_removed_lines"].alias("n_removed_lines"), F.sha2(x["text"].cast("binary"), 256).alias("text_sha256"))


PIECES = os.environ.get("TERRAVANE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_wfst.encoding_digest(table(spark, sf_dir, "documents"), PIECES).withColumnRenamed("id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.judge(docs, carry=["doc_id", "lang"])
    fields = [*quality_rules.BASE_FIELDS, "base_failed", "kept", "log_ppl"]
    return out.select("doc_id", *(F.col(f"__tv_rules.{c}").alias(c) for c in fields))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", *(F.col(f"__tv_url.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "reason")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.with_times(docs)
    size = mixing.word_count(F.col("text"))
    return out.select("doc_id", size.alias("size"), F.col("__tv_source_size").alias("source_size"), F.col("__tv_target").alias("target"), (size * F.col("__tv_times")).alias("taken"))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_secrets": op2_secrets,
    "op3_embeddings": op3_embeddings,
    "op4_minhash": op4_minhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_mixing": op10_mixing,
}

_CHUNKS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS rk,
         CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
l AS (
  SELECT r, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT r, i, lines[i] AS line FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d))),
chunk AS (
  SELECT r, i, 2 AS n, line || chr(10) || next AS body FROM (SELECT *, lead(line) OVER w AS next, lead(nw) OVER w AS nnw FROM l WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE nw + nnw > 0
  UNION ALL SELECT r, i, 1, line FROM l WHERE nw >= 50),
cand AS (SELECT c.*, d.doc_id, d.rk FROM chunk c JOIN d USING (r)),
again AS (
  SELECT body, arg_min(rk, ord) AS rk, arg_min(i, ord) AS i
  FROM (SELECT *, row(doc_id IS NULL, doc_id, rk, i) AS ord FROM cand) GROUP BY body HAVING count(*) > 1),
gone AS (
  SELECT c.r, c.i, c.n FROM cand c JOIN again a USING (body) WHERE NOT (c.rk = a.rk AND abs(c.i - a.i) < c.n)),
lost AS (SELECT DISTINCT r, i + unnest(range(0, n)) AS i FROM gone)
"""

SQL: dict[str, str] = {
    "op5_line_dedup": _CHUNKS_SQL
    + r"""
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_chunks, CAST(coalesce(x.n, 0) AS BIGINT) AS n_removed_lines,
       CASE WHEN d.text IS NULL THEN NULL WHEN x.r IS NULL THEN sha256(d.text) ELSE sha256(coalesce(k.body, '')) END AS text_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g ON d.r = g.r
LEFT JOIN (SELECT r, count(*) AS n FROM lost GROUP BY r) x ON d.r = x.r
LEFT JOIN (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.i) AS body FROM l ANTI JOIN lost ON l.r = lost.r AND l.i = lost.i GROUP BY l.r) k ON d.r = k.r
""",
    "op9_url_filter": r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(label, action, rhost, rpath) AS (VALUES
  ('com/en/', 'block', 'com', '/en/'), ('example.com/en/7', 'allow', 'example.com', '/en/7'), ('net/de/', 'allow', 'net', '/de/'),
  ('example.net/de/8', 'block', 'example.net', '/de/8'), ('org/es/', 'block', 'org', '/es/')),
h AS (
  SELECT page_id, host, path,
    (SELECT arg_max(row(label, action), length(label)) FROM r WHERE (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)) AS best,
    regexp_extract(host, '(^|[^a-z0-9])(ads-track|casino-win|cheap-pills|free-bets)([^a-z0-9]|$)', 2) AS word
  FROM p)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN word <> '' THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(best[1], nullif(word, '')) AS reason
FROM h
""",
    "op10_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
    CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS sk
  FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM s),
k AS (SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM w),
f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM k),
lv AS (SELECT arg_min(lv, row(ratio, sk)) AS level FROM f WHERE lv <= ratio),
t AS (
  SELECT sk, source_size, least(CAST(source_size * 3 AS DOUBLE), weight * level) AS target FROM f, lv),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t),
run AS (
  SELECT d.doc_id, d.size, d.key, d.sk, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.sk ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_end
  FROM d JOIN e USING (sk)),
cut AS (SELECT sk, max(key) AS cut FROM run WHERE source_size > 0 AND run_end - size / 2.0 <= budget GROUP BY sk)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN key <= coalesce(cut, '') THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run LEFT JOIN cut USING (sk)
""",
}
