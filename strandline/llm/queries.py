"""The operators applied to the driver's tables, one query each, and SQL where it can say the same."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fixity, langid, packing, quality, secret_scan, simhash, topk_search, toxicity
from .common import remainder, shared_path, table


def tokenizer_path() -> str:
    """The vocabulary file: STRANDLINE_TOKENIZER, else the public package's."""
    if found := os.environ.get("STRANDLINE_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels, remainder("doc_id", 4) != 2))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels, remainder("doc_id", 5) != 0))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.score(docs, langid.fit(docs, remainder("doc_id", 5) != 0))
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, ("assign", "access", "hex"))
    base = F.filter("secret_spans", lambda s: s["number"] < len(secret_scan.BASE))
    return out.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("secret_spans")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' records against a replica, written as WARC files, in which the body of every 97th page has one letter changed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    flipped = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = shared_path(spark, "replica")
    fixity.write_warc(pages.withColumn("html", flipped), replica, compression="gzip")
    first, second = fixity.manifest(pages), fixity.warc_manifest(spark, replica)
    found = fixity.audit(first, second).filter("state <> 'extra'").select("archive", "part", "record_no", "state")
    out = fixity.records_of(first).join(found, ["archive", "part", "record_no"], "left")
    state = F.coalesce("state", F.lit("intact")).alias("state")
    return out.select(F.col("record_id").cast("long").alias("page_id"), "archive", "record_no", "offset", "length", "record_sha256", "archive_root", state)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_bpe, op4_packing, op5_langid, op6_secrets, op7_exact_dedup, op8_warc, op9_simhash, op10_topk)}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op6_secrets": r"""
WITH m AS (
  SELECT doc_id, text, k.kind, k.n, k.g, k.least, unnest(range(1, 1 + len(regexp_extract_all(text, k.rx)))) AS i,
         regexp_extract_all(text, k.rx) AS found, string_split_regex(text, k.rx) AS gaps, regexp_extract_all(text, k.rx, k.g) AS part
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents),
       (VALUES ('assign', 0, 2, 6, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
               ('access', 1, 0, 20, 'AKIA[A-Z0-9]+'), ('hex', 2, 0, 24, '[0-9a-f]{24,}'),
               ('pem', 3, 0, 1, '-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D\x20]*'),
               ('jwt', 4, 0, 1, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+'),
               ('vendor', 5, 0, 1, '(ghp_|github_pat_|glpat-|xoxb-|sk_live_|npm_|AIza)[A-Za-z0-9_-]{16,}'),
               ('uri', 6, 0, 1, '[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:@/]+:[^\x00-\x20:@/]+@')) k(kind, n, g, least, rx)),
s AS (
  SELECT doc_id, kind, n, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS b, length(found[i]) AS size
  FROM m WHERE length(part[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || b::BIGINT || ':' || (b + size)::BIGINT, ',' ORDER BY b, n) AS spans, string_agg(kind || ':' || b::BIGINT || ':' || (b + size)::BIGINT, ',' ORDER BY b, n) FILTER (n < 3) AS base FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)""",
    "op8_warc": r"""
WITH r AS (
  SELECT page_id, floor(page_id / 1024)::BIGINT AS archive, s, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM (SELECT page_id, url, html, 1 AS s FROM pages UNION ALL SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substr(html, 2) ELSE html END, 2 FROM pages)),
m AS (
  SELECT page_id, archive, s, octet_length(encode(rec)) AS length, sha256(rec) AS record_sha256, row_number() OVER w - 1 AS record_no, coalesce(sum(octet_length(encode(rec))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r WINDOW w AS (PARTITION BY s, archive ORDER BY page_id)),
l0 AS (SELECT *, sha256(record_sha256 || ':' || "offset" || ':' || length) AS leaf FROM m),
l1 AS (SELECT archive, record_no // 16 AS node, sha256(string_agg(leaf, '' ORDER BY record_no)) AS h FROM l0 WHERE s = 1 GROUP BY ALL),
l2 AS (SELECT archive, node // 16 AS node, sha256(string_agg(h, '' ORDER BY l1.node)) AS h FROM l1 GROUP BY archive, l1.node // 16),
l3 AS (SELECT archive, sha256(string_agg(h, '' ORDER BY node)) AS archive_root FROM l2 GROUP BY archive)
SELECT x.page_id, archive, record_no, x."offset", x.length, x.record_sha256, archive_root, CASE WHEN x.leaf = y.leaf THEN 'intact' WHEN x.record_sha256 = y.record_sha256 THEN 'moved' ELSE 'damaged' END AS state
FROM (SELECT * FROM l0 WHERE s = 1) x JOIN (SELECT * FROM l0 WHERE s = 2) y USING (archive, record_no) JOIN l3 USING (archive)""",
    "op10_topk": r"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
