"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

``ORACLE_SQL`` holds, for each query that SQL can express, an equivalent DuckDB
statement over the same parquet tables; output column names match.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmweave.operators import admission as A
from tmweave.config import Features, load_config
from tmweave.operators import notify as N
from tmweave.operators import tmx as X
from tmweave.operators.combine import collect_results, combine_sections
from tmweave.operators.sections import split_sections
from tmweave.functions.text import PROMPT_TEMPLATE, model_request
from tmweave.operators.retrieval import retrieval_context, tm_search_side
from tmweave.operators.tm_index import build_index, probes_for, search_index
from tmweave.operators.ledger import complete_once, prompt_digest
from tmweave.operators.translate import with_prompts
from tmweave.operators.vectors import DEFAULT_BLOCK_ROWS, embed_text, topk_cosine
from tmweave.plans import composites as P
from tmweave.plans import tables as T
from tmweave.plans.models import EchoCompleter, RejectingCompleter, SigningCompleter, SizeEmbedder
from tmweave.session import scratch_path
from tmweave.sinks.tables import read_runs, start_executions, write_outbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------------- combine
@register("combine_documents", """
SELECT conv_id AS document_id,
       'translated/' || CAST(conv_id AS VARCHAR) || '_es.txt' AS output_key,
       string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body,
       round(avg(CAST(length(text) % 64 AS DOUBLE) / 64.0), 6) AS confidence,
       count(*) AS sections
FROM conversations
GROUP BY conv_id
""")
def combine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = T.conversation_sections(spark, sf_dir)
    docs = T.conversation_documents(sections)
    out = combine_sections(sections, docs)
    return out.select("document_id", "output_key", "body",
                      F.round("confidence", 6).alias("confidence"), "sections")


@register("combine_with_empty_documents", """
WITH c AS (SELECT conv_id,
                  string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body,
                  count(*) AS n,
                  avg(CAST(length(text) % 64 AS DOUBLE) / 64.0) * 100.0 AS y
           FROM conversations GROUP BY conv_id)
SELECT d.doc_id AS document_id,
       'translated/' || CAST(d.doc_id AS VARCHAR) || '_es.txt' AS output_key,
       coalesce(c.body, '') AS body,
       coalesce(c.n, 0) AS sections,
       CASE WHEN c.y IS NULL OR isnan(c.y) THEN 'NaN'
            WHEN c.y * 8 = floor(c.y * 8) AND CAST(c.y * 8 AS BIGINT) % 2 = 1
              THEN printf('%.2f', ceil(c.y * 100) / 100)
            ELSE printf('%.2f', c.y) END || '%' AS confidence_pct,
       'documents/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS original_document
FROM documents d LEFT JOIN c ON c.conv_id = d.doc_id
""")
def combine_with_empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row is a document; conversations supply sections for
    some of them.  Documents without sections keep an empty body, 0 sections and
    NaN confidence (rendered as text by P11)."""
    from tmweave.functions.text import confidence_percent

    docs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        .alias("original_key"),
        F.lit(T.SOURCE_LANGUAGE).alias("source_language"),
        F.lit(T.TARGET_LANGUAGE).alias("target_language"))
    out = combine_sections(T.conversation_sections(spark, sf_dir), docs)
    return out.select("document_id", "output_key", "body", "sections",
                      confidence_percent("confidence").alias("confidence_pct"),
                      F.col("metadata").getItem("original-document").alias("original_document"))


@register("translated_documents_sink", """
SELECT conv_id AS document_id,
       'translated/' || CAST(conv_id AS VARCHAR) || '_es.txt' AS output_key,
       string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body,
       'es' AS target_language,
       'en' AS meta_source_language,
       'es' AS meta_target_language,
       'documents/' || CAST(conv_id AS VARCHAR) || '.txt' AS meta_original_document
FROM conversations
GROUP BY conv_id
""")
def translated_documents_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + K2: combined documents written twice, partitioned by target language with
    their string metadata (P5), then read back: the second run replaces the first."""
    from tmweave.plans.composites import combine_documents as combine_and_write
    from tmweave.session import scratch_path
    from tmweave.sinks.tables import read_translated

    sections = T.conversation_sections(spark, sf_dir)
    path = scratch_path(spark, "translated")
    for _ in range(2):
        combine_and_write(sections, T.conversation_documents(sections), out_path=path)
    out = read_translated(spark, path)
    meta = F.col("metadata")
    return out.select("document_id", "output_key", "body", "target_language",
                      meta.getItem("source-language").alias("meta_source_language"),
                      meta.getItem("target-language").alias("meta_target_language"),
                      meta.getItem("original-document").alias("meta_original_document"))


@register("combine_shared_stems", """
SELECT 'report' || CAST(conv_id % 7 AS VARCHAR) AS document_id,
       'documents/' || CAST(conv_id AS VARCHAR) || '/report' || CAST(conv_id % 7 AS VARCHAR)
         || '.txt' AS original_key,
       string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS sections
FROM conversations
GROUP BY conv_id
""")
def combine_shared_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J3 over documents whose file stems repeat (seven ids in all): each keeps its own
    sections, told apart by the execution."""
    sections = T.conversation_sections(spark, sf_dir).withColumnRenamed(
        "document_id", "execution_id")
    stem = F.concat(F.lit("report"), (F.col("execution_id") % 7).cast("string"))
    docs = sections.select("execution_id").distinct().select(
        "execution_id", stem.alias("document_id"),
        F.concat(F.lit("documents/"), F.col("execution_id").cast("string"), F.lit("/"), stem,
                 F.lit(".txt")).alias("original_key"))
    return combine_sections(sections, docs, key="execution_id").select(
        "document_id", "original_key", "body", "sections")


# --------------------------------------------------------------------------- admission
_AUDIT_CTE = """
WITH ev AS (
  SELECT event_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time,
         CASE event_type WHEN 'click' THEN 'PutObject'
                         WHEN 'purchase' THEN 'CompleteMultipartUpload'
                         WHEN 'view' THEN 'GetObject'
                         WHEN 'signup' THEN 'PutObject'
                         WHEN 'error' THEN 'DeleteObject' END AS event_name,
         CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 34 THEN 'translation-memory-docs'
              WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 67 THEN 'translation-memory-tmx'
              ELSE 'unrelated-bucket' END AS bucket,
         'uploads/' || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) || '.txt' AS raw_key
  FROM events)
"""


@register("route_uploads", _AUDIT_CTE + """
SELECT event_id,
       CASE bucket WHEN 'translation-memory-docs' THEN 'documents' ELSE 'tmx' END AS route,
       bucket, raw_key, event_name, event_time
FROM ev
WHERE event_name IN ('PutObject', 'CompleteMultipartUpload')
  AND bucket IN ('translation-memory-docs', 'translation-memory-tmx')
""")
def route_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.events_as_audit_events(spark, sf_dir)
    routed = A.route_uploads(events, {"documents": T.DOCUMENTS_BUCKET, "tmx": T.TMX_BUCKET})
    return routed.select("event_id", "route", "bucket", "raw_key", "event_name", "event_time")


@register("audit_files", ORACLE_SQL["route_uploads"])
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + F1: the audit events written as JSON files, read back and routed."""
    from tmweave.sources.uploads import read_audit_events

    path = scratch_path(spark, "audit") + "/events"
    T.events_as_audit_events(spark, sf_dir).drop("event_id").write.json(path)
    routed = A.route_uploads(read_audit_events(spark, path), {"documents": T.DOCUMENTS_BUCKET, "tmx": T.TMX_BUCKET})
    event = F.regexp_extract("raw_key", r"/(\d+)\.txt$", 1).cast("bigint")
    return routed.select(event.alias("event_id"), "route", "bucket", "raw_key", "event_name", "event_time")


_PAGE_KEYS = """
pk AS (
  SELECT page_id,
         regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS bucket,
         regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS raw_key
  FROM pages)
"""


@register("decode_object_keys", "WITH " + _PAGE_KEYS + """
, dk AS (SELECT page_id, bucket, raw_key, url_decode(replace(raw_key, '+', ' ')) AS key FROM pk)
SELECT page_id, bucket, key,
       coalesce(nullif(split_part(list_last(string_split(key, '/')), '.', 1), ''), 'unknown')
         AS document_id
FROM dk
""")
def decode_object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.decode_keys(T.page_uploads(spark, sf_dir)).select(
        "page_id", "bucket", "key", "document_id")


@register("decode_escaped_keys", """
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'up loads/' || page_id || CASE page_id % 4
           WHEN 0 THEN '/a b+c.v1.txt' WHEN 1 THEN '/caf' || chr(233) || '/50%.txt' ELSE '/.txt' END END AS key,
       CASE page_id % 4 WHEN 0 THEN 'a b+c' WHEN 1 THEN '50%' WHEN 2 THEN 'unknown' ELSE 'unknown' END AS document_id,
       CASE WHEN page_id % 4 = 3 THEN 'URI malformed' END AS reason
FROM pages
""")
def decode_escaped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with plus signs, escapes of one and two bytes, an empty stem and a broken
    escape, which is set apart with its reason; both frames of ``admit``."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    tail = (F.when(kind == 0, "/a+b%2Bc.v1.txt").when(kind == 1, "/caf%C3%A9/50%25.txt")
            .when(kind == 2, "/.txt").otherwise("/50%zz.txt"))
    pages = T.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("up+loads/"), n, tail).alias("raw_key"), F.lit("text/plain").alias("content_type"))
    admitted, rejected = A.admit(A.decode_keys(pages))
    return (admitted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
            .select("page_id", "key", "document_id", "reason"))


@register("upload_notifications", "WITH " + _PAGE_KEYS + """
, recs AS (
  SELECT page_id, 0 AS record_pos, bucket, raw_key, 'ObjectCreated:Put' AS event_name,
         CAST(length(html) AS BIGINT) AS size FROM pk JOIN pages USING (page_id)
  UNION ALL
  SELECT page_id, 1, 'translation-memory-docs', 'documents/' || CAST(page_id AS VARCHAR) || '.txt',
         'ObjectCreated:CompleteMultipartUpload', CAST(length(html) * 2 AS BIGINT)
  FROM pk JOIN pages USING (page_id))
SELECT page_id, record_pos, bucket, url_decode(replace(raw_key, '+', ' ')) AS key,
       coalesce(nullif(split_part(list_last(string_split(url_decode(replace(raw_key, '+', ' ')), '/')),
                                  '.', 1), ''), 'unknown') AS document_id,
       event_name, size
FROM recs
""")
def upload_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + P1 + P2: each page becomes an upload notification (JSON text) with two
    records -- the page object and a document object -- parsed back and exploded
    one row per record, in record order."""
    from tmweave import schemas
    from tmweave.sources.uploads import uploads_from_notifications

    pages = T.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    keys = T.page_uploads(spark, sf_dir, pages)
    src = keys.join(pages.select("page_id", "html"), "page_id")

    def record(bucket, key, name, size):
        return F.struct(
            F.lit("ObjectCreated:" + name).alias("eventName"),
            F.struct(F.struct(bucket.alias("name")).alias("bucket"),
                     F.struct(key.alias("key"), size.cast("bigint").alias("size")).alias("object"))
            .alias("s3"))

    notes = src.select("page_id", F.to_json(F.struct(F.array(
        record(F.col("bucket"), F.col("raw_key"), "Put", F.length("html")),
        record(F.lit(T.DOCUMENTS_BUCKET),
               F.concat(F.lit("documents/"), F.col("page_id").cast("string"), F.lit(".txt")),
               "CompleteMultipartUpload", F.length("html") * 2),
    ).alias("Records"))).alias("body"))
    parsed = notes.select("page_id", F.from_json("body", schemas.UPLOAD_NOTIFICATION).alias("n"))
    ups = uploads_from_notifications(parsed.select("page_id", "n.Records"))
    return A.decode_keys(ups).select("page_id", F.col("record_pos").cast("int").alias("record_pos"),
                                     "bucket", "key", "document_id", "event_name", "size")


ADMIT_TIMESTAMP = "2024-01-01T00:00:00.000Z"


@register("admit_documents", "WITH " + _PAGE_KEYS + """
, docs AS (
  SELECT 'translation-memory-docs' AS bucket,
         'documents/' || CAST(doc_id AS VARCHAR) ||
           CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.docx'
                     WHEN 'es' THEN '.jpg' ELSE '.bin' END AS raw_key,
         CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'application/pdf'
                   WHEN 'de' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
                   WHEN 'es' THEN 'image/jpeg' END AS content_type
  FROM documents)
, manifest AS (
  SELECT bucket, raw_key AS key,
         CASE WHEN raw_key LIKE '%.html' THEN 'text/html'
              WHEN raw_key LIKE '%/' THEN 'application/octet-stream' END AS content_type
  FROM pk WHERE raw_key LIKE '%.html' OR raw_key LIKE '%/'
  UNION ALL SELECT bucket, raw_key, content_type FROM docs)
, m AS (SELECT bucket, key, max(content_type) AS content_type FROM manifest GROUP BY ALL)
, up AS (
  SELECT bucket, url_decode(replace(raw_key, '+', ' ')) AS key FROM pk
  UNION ALL SELECT bucket, url_decode(replace(raw_key, '+', ' ')) FROM docs)
, j AS (
  SELECT up.bucket, up.key, m.content_type,
         coalesce(nullif(split_part(list_last(string_split(up.key, '/')), '.', 1), ''), 'unknown')
           AS document_id
  FROM up LEFT JOIN m ON up.bucket = m.bucket AND up.key = m.key)
, t AS (
  SELECT *, coalesce(contains(content_type, 'text') OR contains(content_type, 'application/pdf')
                     OR contains(content_type, 'application/msword')
                     OR contains(content_type, 'application/vnd.openxmlformats-officedocument'),
                     false) AS admitted
  FROM j)
SELECT bucket, key, content_type, document_id, admitted,
       CASE WHEN admitted THEN NULL
            ELSE 'Unsupported file type: ' || coalesce(content_type, 'undefined') END AS reason,
       CASE WHEN admitted THEN json_object('bucket', bucket, 'key', key,
                                           'contentType', content_type,
                                           'documentId', document_id,
                                           'timestamp', '2024-01-01T00:00:00.000Z')::VARCHAR
       END AS request
FROM t
""")
def admit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 in batch: decode, metadata lookup, validation, requests, as one table
    with an ``admitted`` flag (one pass over the uploads)."""
    uploads = T.page_uploads(spark, sf_dir).select("bucket", "raw_key").unionByName(
        T.document_objects(spark, sf_dir).select("bucket", "raw_key"))
    out = A.admission_outcomes(uploads, T.upload_manifest(spark, sf_dir),
                               timestamp=ADMIT_TIMESTAMP)
    return out.select("bucket", "key", "content_type", "document_id", "admitted", "reason",
                      "request")


@register("metadata_as_of", """
WITH v AS (SELECT user_id, ts, max(CASE event_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png'
                                                     WHEN 2 THEN 'application/pdf' END) AS content_type
           FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL)
SELECT u.event_id, 'uploads/' || CAST(u.user_id AS VARCHAR) AS key, v.content_type,
       coalesce(v.content_type <> 'image/png', false) AS admitted
FROM (SELECT * FROM events WHERE event_type = 'click') u
     ASOF LEFT JOIN v ON u.user_id = v.user_id AND u.ts >= v.ts
""")
def metadata_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of objects that are overwritten several times, judged by the content
    type of their time."""
    from tmweave.sources.uploads import attach_metadata_as_of

    out = attach_metadata_as_of(*T.object_versions(spark, sf_dir))
    return out.select("event_id", "key", "content_type",
                      A.content_type_accepted("content_type").alias("admitted"))


# --------------------------------------------------------------------------- sections
@register("split_sections", """
SELECT doc_id AS document_id,
       CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS section_id,
       unnest(parts) AS section
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
""")
def split_sections_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text")
    return split_sections(docs, "\n").select("document_id", "section_id", "section")


@register("section_round_trip", """
SELECT doc_id AS document_id, text FROM documents
""")
def section_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), "text")
    secs = split_sections(docs, "\n").select(
        "document_id", "section_id", F.col("section").alias("translated_text"),
        F.lit(1.0).alias("confidence"))
    return combine_sections(secs, separator="\n").select(
        "document_id", F.col("body").alias("text"))


# --------------------------------------------------------------------------- vectors
def sql_template(template: str, **exprs: str) -> str:
    """The SQL concatenation of a ``{name}`` template (newlines as chr(10))."""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append(template[pos:m.start()])
        out.append(None)
        out.append(exprs[m.group(1)])
        pos = m.end()
    out.append(template[pos:])
    parts, i = [], 0
    while i < len(out):
        piece = out[i]
        if piece is None:
            parts.append(f"coalesce(CAST({out[i + 1]} AS VARCHAR), '')")
            i += 2
            continue
        lines = piece.split("\n")
        for j, ln in enumerate(lines):
            if ln:
                parts.append("'" + ln.replace("'", "''") + "'")
            if j < len(lines) - 1:
                parts.append("chr(10)")
        i += 1
    return " || ".join(parts)


def _hash_embedding_ctes(src: str, id_expr: str, text_expr: str) -> str:
    """CTEs tok, hb (sparse counts), hn (norms), qv (dense unit vectors)."""
    return rf"""
tok AS (SELECT {id_expr} AS qid,
               unnest(regexp_split_to_array(lower({text_expr}), '[^\p{{L}}\p{{N}}]+')) AS t
        FROM {src}),
hb AS (SELECT qid, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS dim,
              CAST(count(*) AS DOUBLE) AS n
       FROM tok WHERE t <> '' GROUP BY ALL),
hn AS (SELECT qid, sqrt(sum(n * n)) AS norm FROM hb GROUP BY qid),
qv AS (SELECT g.qid, list(coalesce(hb.n / hn.norm, 0.0) ORDER BY g.dim) AS v
       FROM (SELECT qid, r.dim FROM hn, range(64) r(dim)) g
       LEFT JOIN hb USING (qid, dim) JOIN hn USING (qid)
       GROUP BY g.qid)"""


_TM_CTE = """
tm AS (SELECT e.vec_id AS tm_id, CAST(e.embedding AS DOUBLE[]) AS v,
              CAST(e.label AS DOUBLE) / 10.0 AS tm_score, d.text AS translation
       FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"""

_SEARCH_CTES = """
s AS (SELECT qv.qid, tm.tm_id, list_cosine_similarity(qv.v, tm.v) + 1.0 AS score FROM qv, tm),
r AS (SELECT qid, tm_id, score,
             row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, tm_id) AS rank
      FROM s QUALIFY rank <= 5),
kept AS (SELECT r.qid, r.rank, tm.translation FROM r JOIN tm USING (tm_id)
         WHERE tm.tm_score > 0.8 AND coalesce(tm.translation, '') <> ''),
ctx AS (SELECT qid, string_agg(translation, chr(10) ORDER BY rank) AS context,
               count(*) AS kept_hits
        FROM kept GROUP BY qid)"""


@register("hash_embeddings", "WITH " + _hash_embedding_ctes("benchmark", "item_id", "text") + """
SELECT qid AS item_id, CAST(dim AS INTEGER) AS dim, round(n / norm, 6) AS weight
FROM hb JOIN hn USING (qid)
""")
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = embed_text(T.table(spark, sf_dir, "benchmark"), "text")
    return (b.select("item_id", F.posexplode("embedding").alias("dim", "weight"))
            .filter(F.col("weight") != 0)
            .select("item_id", "dim", F.round("weight", 6).alias("weight")))


_TOPK_SQL = """
WITH qv AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
tm AS (SELECT vec_id AS tm_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT qv.qid, tm.tm_id, list_cosine_similarity(qv.v, tm.v) + 1.0 AS score FROM qv, tm)
SELECT qid AS query_id, tm_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, tm_id) AS rank
      FROM s) WHERE rank <= 5
"""


def _topk_query(spark, sf_dir, **opts):
    e = T.table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    tm = e.select(F.col("vec_id").alias("tm_id"), "embedding")
    hits = topk_cosine(q, tm, 5, **opts)
    return hits.select("query_id", "tm_id", "rank", F.round("score", 6).alias("score"))


@register("topk_similar", _TOPK_SQL)
def topk_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk_query(spark, sf_dir)


@register("topk_similar_blocked", _TOPK_SQL)
def topk_similar_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same answer through 4 x 4 blocks and the cross-block ranking window."""
    return _topk_query(spark, sf_dir, query_blocks=4, tm_blocks=4)


@register("topk_approx", """
SELECT (SELECT count(*) FROM embeddings) AS queries,
       (SELECT sum(least(5, (SELECT count(*) FROM embeddings))) FROM embeddings)::BIGINT AS true_hits,
       true AS recall_reached, true AS fewer_cells
""")
def topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: probed search on the index of the exact one, its recall measured against V2.  The
    number of probes is estimated for a recall of 0.95; ``recall_reached`` says that 0.9 was."""
    e = T.table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    # A task holds a block: no more records than a block of the exact search.
    index = build_index(e, tm_id="vec_id", blocks=max(4, math.ceil(e.count() / DEFAULT_BLOCK_ROWS)))
    probes = probes_for(index, q, 5, 0.95)
    near = search_index(q, index, 5, probes=probes).select("query_id", "tm_id", F.lit(1).alias("hit"))
    exact = topk_cosine(q, e, 5, tm_id="vec_id")
    found = exact.join(near, ["query_id", "tm_id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("true_hits"),
                     (F.sum("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached")) \
        .withColumn("fewer_cells", F.lit(probes < len(index.centres)))


@register("pairwise_cosine", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) + 1.0, 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the stored-score form of the cosine, of each vector and the next."""
    from tmweave.functions.vectors import cosine_plus_one

    e = T.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine_plus_one("embedding", "next"), 6).alias("score"))


@register("embedding_replies", """
SELECT item_id, CAST([length(text), item_id * 0.5, -1] AS DOUBLE[]) AS embedding,
       CASE item_id % 3 WHEN 0 THEN 'model-' || item_id ELSE 'amazon.titan-embed-text-v1' END AS model
FROM benchmark
""")
def embedding_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON replies of an embedding model plugged into ``embed_text``, and the
    model id: configured for every third item, else empty or missing."""
    from tmweave.config import DEFAULT_EMBEDDING_MODEL
    from tmweave.functions.text import parse_embedding, resolve_model

    b = T.table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = embed_text(b.select("item_id", F.concat_ws("|", F.col("item_id").cast("string"), "text").alias("text")),
                       "text", SizeEmbedder())
    kind = F.col("item_id") % 3
    given = F.when(kind == 0, F.concat(F.lit("model-"), F.col("item_id").cast("string"))).when(kind == 1, "")
    reply = F.to_json(F.struct("embedding"))
    return asked.select("item_id", parse_embedding(reply).alias("embedding"),
                        resolve_model(given, DEFAULT_EMBEDDING_MODEL).alias("model"))


# --------------------------------------------------------------------------- retrieval
@register("retrieval_context", "WITH " + _TM_CTE + """,
qv AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),""" + _SEARCH_CTES + """
SELECT q.vec_id AS query_id, coalesce(ctx.context, '') AS context,
       CAST(len(string_split(coalesce(ctx.context, ''), chr(10))) AS INTEGER) AS context_size,
       CAST(coalesce(ctx.kept_hits, 0) AS INTEGER) AS kept_hits
FROM embeddings q LEFT JOIN ctx ON ctx.qid = q.vec_id
""")
def retrieval_context_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    tm = T.tm_from_embeddings(spark, sf_dir)
    q = T.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), "embedding")
    hits = topk_cosine(q, tm_search_side(tm), 5, carry=("tm_score", "has_translation"))
    out = retrieval_context(q.select("query_id"), hits, tm)
    return out.select("query_id", "context", "context_size", "kept_hits")


_BENCH_PROMPT = sql_template(PROMPT_TEMPLATE, context="coalesce(ctx.context, '')",
                             source="'en'", target="'es'", section="b.text")


@register("build_prompts", "WITH " + _TM_CTE + ","
          + _hash_embedding_ctes("benchmark", "item_id", "text") + "," + _SEARCH_CTES + f""",
p AS (SELECT b.item_id, {_BENCH_PROMPT} AS prompt
      FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id)
SELECT item_id AS document_id, prompt,
       json_object('prompt', prompt, 'max_tokens', 2000, 'temperature', 0.7)::VARCHAR AS request
FROM p
""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = T.benchmark_sections(spark, sf_dir)
    ctx = P.retrieve(sections, T.tm_from_embeddings(spark, sf_dir))
    return (with_prompts(ctx)
            .select("document_id", "prompt", model_request("prompt").alias("request")))


@register("model_messages", """
SELECT item_id AS document_id,
       json_object('inputText', text)::VARCHAR AS embedding_request,
       json_object('completion', '[es] ' || text)::VARCHAR AS completion_reply,
       json_extract_string(json_object('completion', '[es] ' || text), '$.completion') AS completion
FROM benchmark
""")
def model_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + P10: the embedding request body of every benchmark text, and a model
    reply (the stand-in's answer as JSON) parsed back to its completion."""
    from tmweave.functions.text import embedding_request, parse_completion

    b = T.table(spark, sf_dir, "benchmark")
    reply = F.to_json(F.struct(F.concat(F.lit("[es] "), F.col("text")).alias("completion")))
    return (b.select(F.col("item_id").alias("document_id"),
                     embedding_request("text").alias("embedding_request"),
                     reply.alias("completion_reply"))
            .withColumn("completion", parse_completion("completion_reply")))


@register("translate_sections", "WITH " + _TM_CTE + ","
          + _hash_embedding_ctes("benchmark", "item_id", "text") + "," + _SEARCH_CTES + """
SELECT b.item_id AS document_id, 0 AS section_id, b.text AS original_text,
       '[es] ' || b.text AS translated_text, CAST(0.95 AS DOUBLE) AS confidence,
       'anthropic.claude-v2' AS model,
       CAST(len(string_split(coalesce(ctx.context, ''), chr(10))) AS INTEGER) AS context_size
FROM benchmark b LEFT JOIN ctx ON ctx.qid = b.item_id
""")
def translate_sections_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = P.translate_sections(T.benchmark_sections(spark, sf_dir),
                               T.tm_from_embeddings(spark, sf_dir), EchoCompleter())
    return res.select("document_id", "section_id", "original_text", "translated_text",
                      "confidence", "model", "context_size")


@register("translate_documents", """
WITH secs AS (
  SELECT doc_id, CASE WHEN lang = 'es' THEN 'en' ELSE 'es' END AS tgt,
         generate_subscripts(parts, 1) - 1 AS section_id, unnest(parts) AS section
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)),
uniq AS (SELECT DISTINCT section FROM secs),""" + _TM_CTE + ","
          + _hash_embedding_ctes("uniq", "section", "section") + "," + _SEARCH_CTES + """,
res AS (
  SELECT secs.doc_id, secs.section_id, secs.tgt, '[' || secs.tgt || '] ' || secs.section AS translated,
         len(string_split(coalesce(ctx.context, ''), chr(10))) AS context_size
  FROM secs LEFT JOIN ctx ON ctx.qid = secs.section)
SELECT doc_id AS document_id,
       'translated/' || CAST(doc_id AS VARCHAR) || '_' || any_value(tgt) || '.txt' AS output_key,
       string_agg(translated, chr(10) || chr(10) ORDER BY section_id) AS body,
       round(avg(CAST(0.95 AS DOUBLE)), 6) AS confidence,
       count(*) AS sections,
       CAST(sum(context_size) AS BIGINT) AS context_lines
FROM res GROUP BY doc_id
""")
def translate_documents_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.document_requests(spark, sf_dir)
    out = P.translate_documents(docs, T.tm_from_embeddings(spark, sf_dir), EchoCompleter(),
                                delimiter="\n")
    return out.select("document_id", "output_key", "body",
                      F.round("confidence", 6).alias("confidence"), "sections",
                      "context_lines")


@register("translate_with_failures", """
WITH secs AS (
  SELECT doc_id, tgt, generate_subscripts(parts, 1) - 1 AS section_id, unnest(parts) AS section
  FROM (SELECT doc_id, CASE WHEN lang = 'es' THEN 'en' ELSE 'es' END AS tgt,
               string_split(text, chr(10)) AS parts FROM documents))
SELECT doc_id AS document_id, CAST(NULL AS INTEGER) AS section_id, CAST(NULL AS VARCHAR) AS error,
       string_agg('[' || tgt || '] ' || section, chr(10) || chr(10) ORDER BY section_id) AS body
FROM secs GROUP BY doc_id HAVING NOT bool_or(length(section) % 16 = 5)
UNION ALL
SELECT doc_id, CAST(section_id AS INTEGER), 'ValueError: rejected', NULL
FROM secs WHERE length(section) % 16 = 5
""")
def translate_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables of a run whose model rejects some sections: published documents (no
    section_id) and failed sections."""
    path = scratch_path(spark, "failures") + "/translated"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")              # the rejected sections are meant
        P.run_translation(T.document_requests(spark, sf_dir), T.tm_from_embeddings(spark, sf_dir),
                          RejectingCompleter(), load_config(env={}), translated_path=path,
                          recipient_col="document_id", link_col="original_key", delimiter="\n",
                          max_attempts=1)
    none = F.lit(None)
    published = spark.read.parquet(path).select(
        "document_id", none.cast("int").alias("section_id"), none.cast("string").alias("error"), "body")
    failed = read_runs(spark, P.failed_table(path)).select(
        "document_id", F.col("section_id").cast("int"), "error", none.cast("string").alias("body"))
    return published.union(failed)


@register("answers_ledger", """
WITH secs AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS section FROM documents)
SELECT section, count(*) AS occurrences, 1 AS answers,
       bool_or(coalesce(lang = 'en', false)) AS answered_before, true AS own_answer
FROM secs WHERE section IS NOT NULL GROUP BY section
""")
def answers_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2-U4 with a ledger: the English documents' sections are asked first, then those of all
    documents, by a model that never answers twice alike.  Each distinct text has one answer;
    ``answered_before`` says that the second run took it from the ledger."""
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang")
    ledger = scratch_path(spark, "ledger") + "/answers"

    def ask(rows: DataFrame) -> DataFrame:
        sections = split_sections(rows, "\n").withColumnRenamed("section", "prompt")
        return complete_once(sections, SigningCompleter(), ledger, "signing", document="document_id",
                             partitions=8, rounds=2, digest_col="digest")
    signed = prompt_digest("translated_text")
    first = ask(docs.where("lang = 'en'")).groupBy("digest").agg(F.collect_set(signed).alias("earlier"))
    again = ask(docs).groupBy("digest").agg(
        F.first("prompt").alias("prompt"), F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("translated_text").cast("int").alias("answers"),
        F.min("translated_text").alias("translated_text"))
    return again.join(first, "digest", "left").select(
        F.col("prompt").alias("section"), "occurrences", "answers",
        F.coalesce(F.array_contains("earlier", signed), F.lit(False)).alias("answered_before"),
        (F.substring("translated_text", 34, 1 << 30) == F.col("prompt")).alias("own_answer"))


# --------------------------------------------------------------------------- notify
_SENDER = "test@example.com"
_NOTE_FIELDS = dict(document_id="conv_id", source_language="'en'", target_language="'es'",
                    link="'https://downloads.example.com/translated/' || CAST(conv_id AS VARCHAR) || '_es.txt'",
                    percent="pct")


@register("notifications", """
WITH c AS (SELECT conv_id, avg(CAST(length(text) % 64 AS DOUBLE) / 64.0) * 100.0 AS y
           FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id,
             CASE WHEN isnan(y) THEN 'NaN'
                  WHEN y * 8 = floor(y * 8) AND CAST(y * 8 AS BIGINT) % 2 = 1
                    THEN printf('%.2f', ceil(y * 100) / 100)
                  ELSE printf('%.2f', y) END || '%' AS pct
      FROM c)
SELECT conv_id AS document_id,
       'user' || CAST(conv_id AS VARCHAR) || '@example.com' AS recipient,
       'test@example.com' AS sender,
       'Translation Complete - ' || CAST(conv_id AS VARCHAR) AS subject,
       """ + sql_template(N.HTML_TEMPLATE, **_NOTE_FIELDS) + """ AS html_body,
       """ + sql_template(N.TEXT_TEMPLATE, **_NOTE_FIELDS) + """ AS text_body,
       604800 AS link_expires_s
FROM f
""")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = T.conversation_sections(spark, sf_dir)
    combined = combine_sections(sections, T.conversation_documents(sections))
    combined = (combined
                .withColumn("recipient_email", F.concat(
                    F.lit("user"), F.col("document_id").cast("string"), F.lit("@example.com")))
                .withColumn("download_link", F.concat(
                    F.lit("https://downloads.example.com/"), F.col("output_key"))))
    cfg = load_config({"features": Features(email_notifications=True),
                       "sender_email": _SENDER}, env={})
    return N.notify(combined, cfg)


@register("collected_results", """
SELECT 's3://' || CAST(conv_id AS VARCHAR) AS execution_id,
       string_agg(text, '|' ORDER BY turn) AS texts, count(*) AS sections
FROM conversations GROUP BY conv_id
""")
def collected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: section results of each execution in item order; all documents share one stem."""
    sections = (T.conversation_sections(spark, sf_dir)
                .withColumn("execution_id", F.concat(F.lit("s3://"), F.col("document_id").cast("string")))
                .withColumn("document_id", F.lit("report")))
    got = collect_results(sections, value_cols=["translated_text"], key="execution_id")
    items = F.transform("translated_sections", lambda s: s["translated_text"])
    return got.select("execution_id", F.array_join(items, "|", "").alias("texts"),
                      F.size("translated_sections").cast("long").alias("sections"))


@register("requests_and_outbox", """
SELECT conv_id AS document_id, 'user' || CAST(conv_id AS VARCHAR) || '@example.com' AS recipient,
       2 AS requests, 1 AS mails
FROM conversations GROUP BY conv_id
""")
def requests_and_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4: a run written twice counts once, a second run adds its own requests."""
    docs = T.conversation_sections(spark, sf_dir).select("document_id").distinct()
    base = scratch_path(spark, "run-sinks")
    name = F.col("document_id").cast("string")
    requests = docs.select(F.lit("b").alias("bucket"), name.alias("key"), "document_id",
                           F.to_json(F.struct("document_id")).alias("request"))
    for run in ("monday", "monday", "tuesday"):
        start_executions(requests, f"{base}/requests", run)
    notes = docs.select("document_id", F.concat(F.lit("user"), name, F.lit("@example.com")).alias("recipient"))
    for _ in range(2):
        write_outbox(notes, f"{base}/outbox", "monday")
    asked = read_runs(spark, f"{base}/requests").groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("requests"))
    mailed = read_runs(spark, f"{base}/outbox").groupBy("document_id", "recipient").agg(
        F.count(F.lit(1)).cast("int").alias("mails"))
    return mailed.join(asked, "document_id").select("document_id", "recipient", "requests", "mails")


# --------------------------------------------------------------------------- TMX
_PAIRS_SQL = """
pairs AS (SELECT a.conv_id, a.turn, 'en-us' AS source_lang, 'es-es' AS target_lang,
                 a.text AS source_text, b.text AS target_text
          FROM conversations a JOIN conversations b
            ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of each conversation written as TMX ``<tu>`` text
    (turn t is the source, t + 1 the target) and parsed back by ``from_xml``."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"),
                   F.col("text").alias("next_text"))
    units = c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        X.tu_xml(F.lit("en-us"), F.lit("es-es"), "text", "next_text").alias("xml"))
    return X.pair_segments(X.parse_units(units))


@register("tmx_pairs", "WITH " + _PAIRS_SQL + """
SELECT conv_id, turn, source_lang, target_lang, source_text, target_text FROM pairs
""")
def tmx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_units(spark, sf_dir).select(
        "conv_id", "turn", "source_lang", "target_lang", "source_text", "target_text")


@register("tmx_validation", """
SELECT a.conv_id, a.turn, 'en-us' AS source_lang,
       CASE WHEN b.text IS NULL THEN NULL ELSE 'es-es' END AS target_lang,
       a.text AS source_text, b.text AS target_text,
       CASE WHEN b.text IS NULL THEN 'Translation unit needs a source and a target variant' END
         AS error
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
""")
def tmx_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 + G5 on every turn: a unit per turn, whose target is the next turn; the
    last turn of a conversation gives a unit with one variant, which is rejected."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"),
                   F.col("text").alias("next_text"))
    units = c.join(nxt, ["conv_id", "turn"], "left").select(
        "conv_id", "turn",
        X.tu_xml(F.lit("en-us"), F.lit("es-es"), "text", "next_text").alias("xml"))
    return X.pair_segments(X.parse_units(units)).select(
        "conv_id", "turn", "source_lang", "target_lang", "source_text", "target_text", "error")


_TMX_FILE_SQL = """
u AS (SELECT a.conv_id, a.turn, a.conv_id % 5 AS kind, a.text AS source_text,
             b.text AS target_text
      FROM conversations a LEFT JOIN conversations b
        ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
e AS (SELECT *, CASE WHEN kind = 1 AND turn % 3 = 1 THEN 'Malformed TMX content'
                     WHEN target_text IS NULL
                       THEN 'Translation unit needs a source and a target variant' END AS error
      FROM u)"""


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the pieces of a TMX file, as ``read_tmx_pieces`` gives them.  By
    ``conv_id % 5``: whole; some units malformed; cut off at the end; another root; no body."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    kind = F.col("conv_id") % 5
    xml = X.tu_xml(F.lit("en-us"), F.lit("es-es"), "text", "next_text")
    unit = F.when((kind == 1) & (F.col("turn") % 3 == 1), F.replace(xml, F.lit("</seg>"), F.lit(""))) \
        .otherwise(xml)
    units = c.join(nxt, ["conv_id", "turn"], "left").select(
        "conv_id", F.regexp_replace(unit, "</tu>$", "").alias("piece"))
    ends = c.select("conv_id").distinct().select(
        "conv_id",
        F.when(kind == 3, "<html><body>").when(kind == 4, "<tmx><header/>")
        .otherwise("<tmx><header/><body>").alias("head"),
        F.when(kind == 2, "").when(kind == 3, "</body></html>").when(kind == 4, "</tmx>")
        .otherwise("</body></tmx>").alias("tail"))
    ends = ends.select("conv_id", F.explode(F.array("head", "tail")).alias("piece"))
    return units.unionByName(ends).select("piece", F.col("conv_id").cast("string").alias("file_path"))


@register("tmx_files", "WITH " + _TMX_FILE_SQL + """
SELECT conv_id, source_text, target_text FROM e WHERE kind < 2 AND error IS NULL
""")
def tmx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that TMX files contribute; rejected files give none, bad units leave
    the others of their file."""
    from tmweave.sources.tmx import file_errors, tmx_units

    pieces = conversation_files(spark, sf_dir)
    return (X.pair_segments(tmx_units(pieces)).where("error is null")
            .join(file_errors(pieces), "file_path", "left_anti")
            .select(F.col("file_path").cast("bigint").alias("conv_id"), "source_text", "target_text"))


@register("tmx_file_errors", "WITH " + _TMX_FILE_SQL + """,
bad AS (SELECT conv_id, error, 1 AS units FROM e WHERE error IS NOT NULL
        UNION ALL
        SELECT DISTINCT conv_id, 'Malformed TMX content', 0 FROM e WHERE kind >= 2)
SELECT conv_id, error, CAST(sum(units) AS BIGINT) AS units FROM bad GROUP BY conv_id, error
""")
def tmx_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file and kind of error, with the number of units concerned."""
    from tmweave.sources.tmx import file_errors, tmx_units

    pieces = conversation_files(spark, sf_dir)
    errors = X.tmx_errors(X.pair_segments(tmx_units(pieces)), file_errors(pieces))
    return errors.select(F.col("file_path").cast("bigint").alias("conv_id"), "error", "units")


@register("ingest_tm", "WITH " + _PAIRS_SQL + """,
tmp AS (SELECT DISTINCT source_lang, target_lang, source_text, target_text AS translation
        FROM pairs),
uniq AS (SELECT DISTINCT source_text FROM tmp),""" + _hash_embedding_ctes(
    "uniq", "source_text", "source_text") + """
SELECT p.source_lang, p.target_lang, p.source_text, p.translation,
       CAST(1.0 AS DOUBLE) AS score, list_transform(qv.v, lambda x: round(x, 6)) AS embedding
FROM tmp p LEFT JOIN qv ON qv.qid = p.source_text
""")
def ingest_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + K1: TMX files of every other unit ingested into a TM store, then files of all units, half
    of them known by then; read back by S6."""
    from tmweave.sources.tables import read_tm

    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    units = c.join(nxt, ["conv_id", "turn"]).select(
        "turn", X.tu_xml(F.lit("en-us"), F.lit("es-es"), "text", "next_text").alias("value"))
    base = scratch_path(spark, "ingest")
    T.write_tmx_documents(units.where(F.col("turn") % 2 == 0), f"{base}/half")
    T.write_tmx_documents(units, f"{base}/all")
    for folder in ("half", "all"):
        P.ingest_tmx(spark, f"{base}/{folder}", f"{base}/tm")
    return read_tm(spark, f"{base}/tm").select(
        "source_lang", "target_lang", "source_text", "translation", "score",
        F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# --------------------------------------------------------------------------- streaming
_ADMIT_COLS = ["bucket", "key", "content_type", "document_id", "admitted", "reason", "request"]


@register("stream_admission", ORACLE_SQL["admit_documents"])
def stream_admission_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents streamed through admission into a file sink."""
    from tmweave.session import scratch_path
    from tmweave.streaming import run_available_now, stream_admission

    uploads = (T.page_uploads(spark, sf_dir, T.stream_table(spark, sf_dir, "pages"))
               .select("bucket", "raw_key")
               .unionByName(T.document_objects(spark, sf_dir,
                                               T.stream_table(spark, sf_dir, "documents"))
                            .select("bucket", "raw_key")))
    base = scratch_path(spark, "stream-admission")
    q = stream_admission(uploads, T.upload_manifest(spark, sf_dir), f"{base}/out",
                         f"{base}/checkpoint", timestamp=ADMIT_TIMESTAMP)
    run_available_now(q)
    return spark.read.parquet(f"{base}/out").select(*_ADMIT_COLS)


@register("stream_admission_live", ORACLE_SQL["admit_documents"])
def stream_admission_live_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with metadata as a stream: it arrives in the batch after the uploads.  A last upload and
    metadata row, ten years on, move both streams past all others."""
    from tmweave.streaming import read_admissions, run_available_now, stream_admission_live

    base = scratch_path(spark, "stream-admission-live")
    ups, meta = T.timed_uploads(spark, sf_dir)
    later = F.timestamp_seconds(F.lit(2_019_600_000))
    end = spark.range(1)
    last_up = end.select(F.lit("end").alias("bucket"), F.lit("end").alias("raw_key"), later.alias("event_time"))
    last_meta = end.select(F.lit("end").alias("bucket"), F.lit("").alias("key"),
                           F.lit(None).cast("string").alias("content_type"), later.alias("modified_at"))
    for batch in ({"uploads": ups, "metadata": meta.limit(0)}, {"metadata": meta},
                  {"uploads": last_up, "metadata": last_meta}):
        for name, rows in batch.items():
            rows.write.mode("append").parquet(f"{base}/{name}")
        run_available_now(stream_admission_live(
            spark.readStream.schema(ups.schema).parquet(f"{base}/uploads"),
            spark.readStream.schema(meta.schema).parquet(f"{base}/metadata"),
            f"{base}/out", f"{base}/checkpoint", timestamp=ADMIT_TIMESTAMP))
    return read_admissions(spark, f"{base}/out").where("bucket <> 'end'").select(*_ADMIT_COLS)


@register("stream_combine", ORACLE_SQL["combine_documents"])
def stream_combine_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation sections streamed through the stateful fan-in combine."""
    from tmweave.operators.combine import with_output_fields
    from tmweave.session import scratch_path
    from tmweave.streaming import run_available_now, stream_combine

    sections = T.conversation_sections(spark, sf_dir,
                                       T.stream_table(spark, sf_dir, "conversations"))
    expected = (T.conversation_sections(spark, sf_dir).groupBy("document_id")
                .agg(F.count(F.lit(1)).alias("expected")))
    base = scratch_path(spark, "stream-combine")
    q = stream_combine(sections, expected, f"{base}/out", f"{base}/checkpoint")
    run_available_now(q)
    # With a schema: a stream without rows writes no file to take it from.
    id_type = sections.schema["document_id"].dataType.simpleString()
    done = (spark.read.schema(f"document_id {id_type}, body string, confidence double, sections long")
            .parquet(f"{base}/out").withColumnRenamed("document_id", "_document"))
    docs = T.conversation_documents(T.conversation_sections(spark, sf_dir))
    out = with_output_fields(docs.join(done, F.col("document_id").eqNullSafe(F.col("_document"))))
    return out.select("document_id", "output_key", "body",
                      F.round("confidence", 6).alias("confidence"), "sections")



@register("stream_combine_requests", """
SELECT CAST(document_id AS VARCHAR) AS document_id, body, sections, confidence_pct
FROM (""" + ORACLE_SQL["combine_with_empty_documents"] + ")")
def stream_combine_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 with the section counts of a request stream: every ``documents`` row is a request (0
    sections where no conversation supplies any), ids are strings, and the sections come in three
    runs of the stream, every third turn each."""
    from tmweave.functions.text import confidence_percent
    from tmweave.session import scratch_path
    from tmweave.streaming import run_available_now, stream_combine

    sections = T.conversation_sections(spark, sf_dir).withColumn(
        "document_id", F.col("document_id").cast("string"))
    counts = sections.groupBy("document_id").agg(F.count(F.lit(1)).alias("expected"))
    requests = (T.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
                .join(counts, "document_id", "left")
                .select("document_id", F.coalesce("expected", F.lit(0).cast("bigint")).alias("expected")))
    base = scratch_path(spark, "stream-combine")
    requests.write.parquet(f"{base}/requests")
    for i in range(3):
        sections.filter(F.col("section_id") % 3 == i).write.mode("append").parquet(f"{base}/sections")
        run_available_now(stream_combine(
            spark.readStream.schema(sections.schema).parquet(f"{base}/sections"),
            spark.readStream.schema(requests.schema).parquet(f"{base}/requests"),
            f"{base}/out", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/out").where("complete").select(
        "document_id", "body", "sections", confidence_percent("confidence").alias("confidence_pct"))


@register("stream_tmx", ORACLE_SQL["ingest_tm"])
def stream_tmx_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: consecutive conversation turns written by Spark as TMX unit files, read
    back as a stream, unit by unit, and appended to a TM store per micro-batch
    (idempotent sink)."""
    from tmweave.session import scratch_path
    from tmweave.sources.tmx import read_tmx_pieces
    from tmweave.streaming import run_available_now, stream_tmx

    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    units = c.join(nxt, ["conv_id", "turn"]).select(
        X.tu_xml(F.lit("en-us"), F.lit("es-es"), "text", "next_text").alias("value"))
    base = scratch_path(spark, "stream-tmx")
    T.write_tmx_documents(units, f"{base}/in")
    q = stream_tmx(read_tmx_pieces(spark, f"{base}/in", streaming=True), f"{base}/tm",
                   f"{base}/checkpoint")
    run_available_now(q)
    tm = spark.read.parquet(f"{base}/tm")
    return tm.select("source_lang", "target_lang", "source_text", "translation", "score",
                     F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
