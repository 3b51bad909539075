"""The runnable jobs as queries: each runs twice into a new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobs import digest_conversations, index_documents

from ..functions import fixed
from ..operators import index
from ..sources.shared import new_folder
from ..sources.tables import table
from .registry import query
from .relations import _NO_MODEL, _OTHER, COMPARES, DEPTH, FACET, INTENT, NAMED, _marked, _said
from .retrieval import WORDS, bench_queries, bm25_sql


@query("job1_index_documents", f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL)
SELECT doc_id AS key, term, tf, len(w)::DOUBLE AS dl, md5(term)[1:1] AS bucket FROM t JOIN d USING (doc_id)""")
def job1_index_documents(spark, sf_dir):
    """The visible postings of the index of all documents."""
    to = new_folder(spark, "job1")
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{to}/index", f"{to}/checkpoint")
    return index.live_postings(spark, f"{to}/index")


@query("s20_index_search", bm25_sql("SELECT doc_id, text FROM documents", {"text": 1.0}))
def s20_index_search(spark, sf_dir):
    """r1_bm25_topk by an index in two batches: of the second, some documents were there before with another text, or are removed by it and come back by a third."""
    to = new_folder(spark, "s20")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third, fifth = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    index.append(docs.where(third | fifth).withColumn("text", F.concat("text", F.lit(" an earlier text"))), to, 0, "doc_id", {"text": 1.0})
    index.append(docs.where(~fifth).union(docs.where(fifth).select("doc_id", F.lit(None).cast("string"))), to, 1, "doc_id", {"text": 1.0})
    index.append(docs, to, 2, "doc_id", {"text": 1.0})
    found = index.search(spark, to, bench_queries(spark, sf_dir), 10)
    return found.select("query_id", F.col("key").alias("doc_id"), "score", "rank")


_ASKED = f"""
n AS (SELECT conv_id, turn, min(row(coalesce(role, ''), coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
m AS (SELECT conv_id, turn, t[1] AS role, t[2] AS text FROM n), st AS (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, bit_xor(('0x' || md5(turn || ':' || role || ':' || text)[1:15])::BIGINT) AS content FROM m GROUP BY conv_id),
s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS episode, lead(role) OVER w AS nr, lead(length(text)) OVER w AS nl FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, coalesce(nr = 'assistant', false) AS answered FROM s WHERE role = 'user'), f AS (SELECT *, coalesce(lag(answered) OVER (PARTITION BY conv_id ORDER BY turn), false) AS focused FROM a),
j AS (SELECT *, trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 60)) AS title, {INTENT} AS intent, {DEPTH} AS depth,
  CASE WHEN regexp_matches(text, '(?i)^\\s*(?:{'|'.join(fixed.SOCIAL_ACTS)})(?:\\s*[!.…]+)?\\s*$') THEN 'deterministic_social_acknowledgement'
    WHEN NOT focused AND NOT ({NAMED} OR {FACET} OR {_said(fixed.DOCUMENT_ANALYSES, 'text')} OR {_said(fixed.DOCUMENT_VISUALS, 'text')} OR {COMPARES}) AND regexp_matches(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '(?i)^(?:{'|'.join(fixed.CASUAL_STARTS)})(?:$|{_OTHER})') THEN 'deterministic_casual_chat'
    WHEN {FACET} AND NOT {COMPARES} THEN CASE WHEN {NAMED} THEN 'explicit_structured_document_request' WHEN focused THEN 'focused_structured_document_followup' END END AS route,
  {_said(fixed.RESUME_WORDS)} AND {_said(fixed.RESUMED_DOCUMENTS)} OR {_marked(fixed.FOLLOW_UP_MARKERS)} OR {_said(fixed.FOLLOW_UP_METRICS)}
    OR length(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) <= 48 AND NOT regexp_matches(text, '(?:^|{_OTHER})[A-Za-z]*[A-Z][A-Za-z]*[A-Z][A-Za-z]*(?:$|{_OTHER})|\\.pdf(?:$|{_OTHER})') AS follows,
  regexp_matches({_NO_MODEL}, '{'|'.join(m.replace('.', '[.]') for m in fixed.VISUAL_MARKERS)}|(?:^|{_OTHER})(?:hình|hinh)(?:$|{_OTHER})') AS wants_visual, {_marked(fixed.RESULT_MARKERS)} OR {_said(fixed.RESULT_METRICS)} AS wants_results FROM f),
k AS (SELECT *, CASE WHEN depth = 'detailed' OR intent IN ('elaborate', 'compare', 'infer_structure') THEN 1 WHEN depth = 'brief' THEN 2 ELSE 3 END AS k FROM j)"""


@query("job2_digest_conversations", f"""
WITH {_ASKED} SELECT conv_id, turn, episode::BIGINT AS episode, title, answered, CASE WHEN answered THEN nl ELSE 0 END::BIGINT AS answer_chars, route, intent, depth, follows, wants_visual, wants_results,
  ([5, 3, 4])[k] AS max_sources, ([4800, 2700, 3600])[k] AS max_chars, ([1050, 750, 900])[k] AS max_chars_per_source, ([3, 2, 2])[k] AS max_chunks_per_document, 1 AS neighbor_window, ([520, 360, 450])[k] AS max_neighbor_chars,
  turns, last_turn, content, (conv_id % 16)::INTEGER AS bucket FROM k JOIN st USING (conv_id)""")
def job2_digest_conversations(spark, sf_dir):
    """The digest of all conversations."""
    to = new_folder(spark, "job2")
    for _ in range(2):
        digest_conversations.run(spark, f"{sf_dir}/conversations.parquet", f"{to}/digest")
    return digest_conversations.read(spark, f"{to}/digest")
