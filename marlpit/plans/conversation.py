"""Queries of conversation memory, context assembly and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, memory, mutations
from ..sources.tables import table
from ..streaming import folding
from .registry import query


@query("w8_episodes", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS episode FROM conversations WHERE role IN ('user', 'assistant')")
def w8_episodes(spark, sf_dir):
    return memory.episodes(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "episode")


@query("w9_turn_pairs", """
WITH c AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS assistant_text FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS user_text, assistant_text FROM c WHERE role = 'user' AND nr = 'assistant'""")
def w9_turn_pairs(spark, sf_dir):
    return memory.pairs(table(spark, sf_dir, "conversations"))


@query("w10_last_beats", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w10_last_beats(spark, sf_dir):
    return memory.newest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3, ["turn"], ["conv_id"])


@query("w11_retention", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def w11_retention(spark, sf_dir):
    return memory.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), 5, ["ts", "event_id"], ["user_id"]).drop("ts")


@query("w12_latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w12_latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query("a7_oldest_per_group", "SELECT event_type, min(event_id) AS event_id, min(ts) AS oldest FROM events GROUP BY event_type")
def a7_oldest_per_group(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("oldest")).orderBy("oldest")


@query("a8_next_sequence", "SELECT conv_id, max(turn) + 1 AS next_seq FROM conversations GROUP BY conv_id")
def a8_next_sequence(spark, sf_dir):
    return memory.next_sequence(table(spark, sf_dir, "conversations"), "conv_id", "turn")


OPS = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' OR event_id % 9 = 0 THEN 'forget' ELSE 'upsert' END AS action, lower(event_type) AS content, user_id % 7 AS k FROM events"


def operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    forget = (F.col("event_type") == "error") | (F.col("event_id") % 9 == 0)
    return e.select("user_id", "event_id", "ts", F.when(forget, "forget").otherwise("upsert").alias("action"), F.lower("event_type").alias("content"), (F.col("user_id") % 7).alias("k"))


VERSIONS = f"""
o AS ({OPS}), l AS (SELECT *, lead(ts) OVER w AS valid_to, lead(action) OVER w AS na, lag(action) OVER w AS ba, lag(event_id) OVER w AS bs FROM o WINDOW w AS (PARTITION BY user_id, k ORDER BY ts, event_id)),
v AS (SELECT user_id, event_id AS version, content, ts AS valid_from, valid_to, CASE WHEN valid_to IS NULL THEN 'active' WHEN na = 'forget' THEN 'forgotten' ELSE 'superseded' END AS status, CASE WHEN ba = 'upsert' THEN bs END AS supersedes FROM l WHERE action = 'upsert')"""


@query("m7_versioned_items", f"WITH {VERSIONS} SELECT * FROM v")
def m7_versioned_items(spark, sf_dir):
    return memory.versions(operations(spark, sf_dir), ["user_id", "k"], "ts", "event_id", "content").drop("k")


@query("m8_forgotten", f"WITH {VERSIONS} SELECT user_id, version, valid_to FROM v WHERE status = 'forgotten'")
def m8_forgotten(spark, sf_dir):
    items = memory.versions(operations(spark, sf_dir), ["user_id", "k"], "ts", "event_id", "content")
    return items.where("status = 'forgotten'").select("user_id", "version", "valid_to")


@query("f12_as_of", f"WITH {VERSIONS} SELECT user_id, version, status FROM v WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def f12_as_of(spark, sf_dir):
    items = memory.versions(operations(spark, sf_dir), ["user_id", "k"], "ts", "event_id", "content")
    return memory.as_of(items, F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "version", "status")


@query("f13_memory_scope", "SELECT event_id FROM events WHERE event_type = 'view' OR user_id = 3 AND event_type <> 'view'")
def f13_memory_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    items = e.select("event_id", F.when(F.col("event_type") == "view", "global").otherwise("conversation").alias("scope"), F.col("user_id").alias("conversation_id"))
    return items.where(memory.in_scope(F.lit(3))).select("event_id")


@query("w6_prefix_batch", "SELECT conv_id, turn FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 900 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def w6_prefix_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return memory.prefix_batch(rows, "conv_id", "turn", "size", 900).select("conv_id", "turn")


@query("w7_newest_suffix", """
WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS t FROM conversations), o AS (SELECT *, CAST(sum(CASE WHEN t > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS omitted FROM t)
SELECT conv_id, turn, omitted FROM o WHERE t <= 900""")
def w7_newest_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return memory.newest_suffix(rows, "conv_id", "turn", "size", 900).select("conv_id", "turn", "omitted")


CURSORS = "d AS (SELECT conv_id, max(turn) AS dirty_through FROM conversations GROUP BY conv_id), f AS (SELECT conv_id, max(turn) AS s FROM conversations WHERE role = 'assistant' GROUP BY conv_id), c AS (SELECT conv_id, dirty_through, coalesce(s, 0) AS summary_through FROM d LEFT JOIN f USING (conv_id))"


@query("t3_cursors", f"WITH {CURSORS} SELECT * FROM c")
def t3_cursors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("seq"))
    return memory.cursors(c, c.where("role = 'assistant'"), "conv_id")


@query("f21_due_queue", f"WITH {CURSORS} SELECT conv_id FROM c WHERE dirty_through > summary_through AND conv_id % 5 <> 0 AND (conv_id % 3 = 0 OR conv_id % 3 = 1)")
def f21_due_queue(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("seq"))
    later = F.when(F.col("conv_id") % 3 == 1, F.lit("2024-01-01")).when(F.col("conv_id") % 3 == 2, F.lit("2030-01-01")).cast("timestamp")
    jobs = memory.cursors(c, c.where("role = 'assistant'"), "conv_id").withColumns({"status": F.when(F.col("conv_id") % 5 == 0, "dormant").otherwise("idle"), "next_attempt_at": later})
    return memory.due(jobs, F.lit("2025-01-01").cast("timestamp")).select("conv_id")


@query("h54_backoff", "SELECT event_type, least(60, 2 * pow(2, count(*) % 11 - 1)) AS wait FROM events GROUP BY event_type")
def h54_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") % 11).alias("n")).select("event_type", memory.backoff(F.col("n")).alias("wait"))


@query("t7_apply_once", "SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE NOT (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE value < 1) GROUP BY user_id, event_type")
def t7_apply_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    known = memory.apply_once(e.where("value < 1"), spark.createDataFrame([], "fingerprint string"), ["user_id", "event_type"], "event_id")
    return memory.apply_once(e, known, ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type")


@query("t9_stale_runs", "SELECT event_id FROM events WHERE event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 900 SECOND")
def t9_stale_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.agg(F.max("ts").alias("now"))).where((F.col("event_type") == "view") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 900 SECONDS"))).select("event_id")


@query("t10_ttl_and_newest", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, n WHERE ts >= now - INTERVAL 7 DAY QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 200")
def t10_ttl_and_newest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    live = e.join(e.agg(F.max("ts").alias("now"))).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 7 DAYS"))
    return memory.newest(live.select("event_id", "ts"), 200, ["ts", "event_id"]).select("event_id")


@query("h32_memory_relevance", """
WITH q AS (SELECT conv_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS q FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
m AS (SELECT c.conv_id, turn, role, list_distinct(q) AS q, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM conversations c JOIN q ON c.conv_id = q.conv_id)
SELECT conv_id, turn, round(CASE WHEN role = 'system' THEN 1 ELSE 0 END + CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS relevance FROM m""")
def h32_memory_relevance(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.regexp_extract_all(F.lower("text"), F.lit(text.WORD), F.lit(0)))
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.array_distinct(F.min(F.struct("turn", "t"))["t"]).alias("q"))
    none = F.array().cast("array<string>")
    value = memory.relevance(F.col("role") == "system", F.col("q"), none, F.col("t"), F.lit(False))
    return c.join(first, "conv_id").select("conv_id", "turn", F.round(value, 6).alias("relevance"))


@query("h57_conversation_title", "SELECT conv_id, trim(substr(trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')), 1, 60)) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def h57_conversation_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("t"))
    return first.select("conv_id", text.first_line_title(F.col("t")).alias("title"))


@query("s23_touch_conversations", "SELECT conv_id, max(turn) AS updated, count(*) AS messages FROM conversations GROUP BY conv_id")
def s23_touch_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count("*").alias("messages"))


# Candidates for contexts: documents ranked by length within their source.
RANKED = "r AS (SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"


def ranked(spark, sf_dir):
    order = F.row_number().over(context.W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars", order.alias("rank"))


@query("w4_quota_per_document", f"WITH {RANKED} SELECT source, doc_id FROM r QUALIFY lang = 'en' OR row_number() OVER (PARTITION BY source, lang, lang = 'en' ORDER BY rank) <= 2")
def w4_quota_per_document(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("group", F.concat_ws("/", "source", "lang"))
    return context.quota(rows, "group", 2, F.col("lang") == "en").select("source", "doc_id")


@query("w5_budget_fill", f"""
WITH RECURSIVE {RANKED}, f AS (
  SELECT source, 0::BIGINT AS rank, 0::BIGINT AS used, 0::BIGINT AS place, 0::BIGINT AS doc_id, 0::BIGINT AS used_size, false AS taken FROM r GROUP BY source
  UNION ALL
  SELECT f.source, r.rank, used + CASE WHEN ok THEN n ELSE 0 END, place + CASE WHEN ok THEN 1 ELSE 0 END, r.doc_id, n, ok FROM f JOIN r ON r.source = f.source AND r.rank = f.rank + 1,
    LATERAL (SELECT CASE WHEN used = 0 AND n_chars > 5500 THEN 5500 ELSE n_chars END AS n), LATERAL (SELECT place < 8 AND used + n <= 5500 AS ok)
) SELECT source, doc_id, used_size, place FROM f WHERE taken""")
def w5_budget_fill(spark, sf_dir):
    return context.fill(ranked(spark, sf_dir), "source", "rank", "n_chars", 5500, 8).select("source", "doc_id", "used_size", "place")


@query("w13_interleave", f"WITH {RANKED}, p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS n, min(rank) OVER (PARTITION BY source, lang) AS first FROM r) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n, first) AS place FROM p")
def w13_interleave(spark, sf_dir):
    return context.interleave(ranked(spark, sf_dir), "lang", partition="source").select("source", "doc_id", "place")


@query("w20_reserved_sources", f"WITH {RANKED}, b AS (SELECT source, doc_id, rank, lang IN ('fr', 'es') AND row_number() OVER (PARTITION BY source, lang ORDER BY rank) = 1 AS first FROM r) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY NOT first, rank) AS place FROM b")
def w20_reserved_sources(spark, sf_dir):
    rows = ranked(spark, sf_dir)
    return context.reserve(rows, rows.where(F.col("lang").isin("fr", "es")), "lang", partition="source").select("source", "doc_id", "place")


@query("w21_class_priority", f"""
WITH {RANKED}, n AS (SELECT source, doc_id, rank, lang, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS n FROM r)
SELECT source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' AND n <= 2 THEN 0 WHEN lang = 'fr' AND n <= 1 THEN 1 ELSE 2 END, rank) AS place FROM n) WHERE place <= 8""")
def w21_class_priority(spark, sf_dir):
    return context.by_class(ranked(spark, sf_dir), {"de": 2, "fr": 1}, "lang", partition="source").select("source", "doc_id", "place")


@query("w22_parent_quota", f"""
WITH {RANKED}, o AS (SELECT source, lang, doc_id // 3 AS parent, min(rank) AS rank FROM r GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS n FROM o)
SELECT source, lang, parent, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS place FROM q WHERE n <= 4) WHERE place <= 12""")
def w22_parent_quota(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("parent", F.floor(F.col("doc_id") / 3))
    return context.parent_quota(rows, "parent", "lang", 4, 12, partition="source").select("source", "lang", "parent", "place")




def line_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return lines.withColumns({"page_number": F.floor(F.col("chunk_index") / 3), "section": F.lit(None).cast("string")})


LINES_SQL = "l AS (SELECT document_id, unnest(range(len(s))) AS chunk_index, unnest(s) AS content FROM (SELECT doc_id AS document_id, split(text, chr(10)) AS s FROM documents)), c AS (SELECT *, chunk_index // 3 AS page_number FROM l)"


@query("j10_neighbour_chunks", f"""
WITH {LINES_SQL}, h AS (SELECT document_id, chunk_index, page_number FROM c WHERE contains(content, '@'))
SELECT h.document_id, h.chunk_index AS hit_index, c.chunk_index, md5(c.content) AS content FROM h JOIN c ON h.document_id = c.document_id AND abs(h.chunk_index - c.chunk_index) = 1 AND h.page_number = c.page_number""")
def j10_neighbour_chunks(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir)
    hits = chunks.where(F.col("content").contains("@"))
    return context.neighbours(hits, chunks).select("document_id", "hit_index", "chunk_index", F.md5("content").alias("content"))


@query("j11_parent_passages", f"""
WITH {LINES_SQL}, h AS (SELECT document_id, page_number, min(chunk_index) AS rank FROM c WHERE contains(content, '@') GROUP BY ALL)
SELECT document_id, page_number, rank, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS passage FROM h JOIN c USING (document_id, page_number) GROUP BY ALL""")
def j11_parent_passages(spark, sf_dir):
    chunks = line_chunks(spark, sf_dir).withColumn("parent_id", F.struct("document_id", "page_number"))
    whole = chunks.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("passage"))
    hits = chunks.where(F.col("content").contains("@")).withColumn("rank", F.col("chunk_index"))
    return context.parents(hits, whole).select("parent_id.document_id", "parent_id.page_number", "rank", F.md5("passage").alias("passage"))


@query("a22_context_stats", "SELECT source, count(*) AS sources, count(DISTINCT doc_id) AS documents, count_if(lang = 'de') AS tables, count_if(lang = 'fr') AS figures, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def a22_context_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "table").when(F.col("lang") == "fr", "figure").otherwise("text")
    return context.context_stats(d.select("source", F.col("doc_id").alias("document_id"), kind.alias("kind"), F.col("text").alias("content")), "source")


def evidence(spark, sf_dir, which):
    d = table(spark, sf_dir, "documents").where(f"n_chars % 3 <> {which}")
    ids = {"table_id": F.when(F.col("lang") == "de", F.col("n_chars") % 50), "figure_id": F.when(F.col("lang") == "fr", F.col("n_chars") % 50), "parent_id": F.when(F.col("lang") == "es", F.col("n_chars") % 50), "chunk_id": F.col("n_chars") % 50}
    return d.withColumns(ids).select(F.col("source").alias("document_id"), *ids, F.col("doc_id").alias("rank"))


EVIDENCE = "SELECT source || '/' || CASE lang WHEN 'de' THEN 'table_id:' WHEN 'fr' THEN 'figure_id:' WHEN 'es' THEN 'parent_id:' ELSE 'chunk_id:' END || (n_chars % 50) AS identity, doc_id AS rank FROM documents WHERE n_chars % 3 <> {}"


@query("o1_evidence_union", f"WITH a AS ({EVIDENCE.format(0)}), b AS ({EVIDENCE.format(1)}) SELECT identity, coalesce(min(rank) FILTER (WHERE s = 0), min(rank)) AS rank FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY identity")
def o1_evidence_union(spark, sf_dir):
    return context.evidence_union(evidence(spark, sf_dir, 0), evidence(spark, sf_dir, 1)).select("identity", "rank")


@query("o2_new_evidence", f"WITH a AS ({EVIDENCE.format(0)}), b AS ({EVIDENCE.format(1)}) SELECT identity, min(rank) AS rank FROM a ANTI JOIN (SELECT DISTINCT identity FROM b WHERE rank % 4 <> 0) USING (identity) GROUP BY identity")
def o2_new_evidence(spark, sf_dir):
    return context.new_evidence(evidence(spark, sf_dir, 0), evidence(spark, sf_dir, 1).where("rank % 4 <> 0")).select("identity", "rank")


# An incoming state of customers: some gone, some changed, some new.
INCOMING = "i AS (SELECT c_custkey + CASE WHEN c_custkey % 10 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_mktsegment END AS seg, c_custkey % 3 AS version FROM customer WHERE c_custkey % 11 <> 0)"


def incoming(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0")
    return c.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 1_000_000).otherwise(0)).alias("k"), F.when(F.col("c_custkey") % 7 == 0, "changed").otherwise(F.col("c_mktsegment")).alias("seg"), (F.col("c_custkey") % 3).alias("version"))


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.lit(1).cast("long").alias("version"))


@query("m1_incremental_changes", f"""
WITH {INCOMING}, c AS (SELECT c_custkey AS k, md5(c_mktsegment) AS h FROM customer)
SELECT k, CASE WHEN c.h IS NULL THEN 'new' WHEN i.seg IS NULL THEN 'removed' WHEN c.h = md5(i.seg) THEN 'unchanged' ELSE 'changed' END AS change FROM c FULL OUTER JOIN i USING (k)""")
def m1_incremental_changes(spark, sf_dir):
    h = F.md5("seg").alias("h")
    return mutations.classify(customers(spark, sf_dir).select("k", h), incoming(spark, sf_dir).select("k", h), "k", "h")


@query("m2_version_reindex", f"WITH {INCOMING} SELECT k FROM i JOIN (SELECT c_custkey AS k, 1 AS version FROM customer) c USING (k) WHERE i.version <> c.version")
def m2_version_reindex(spark, sf_dir):
    both = customers(spark, sf_dir).select("k", F.lit("x").alias("h"), "version"), incoming(spark, sf_dir).select("k", F.lit("x").alias("h"), "version")
    return mutations.classify(*both, "k", "h", ["version"]).where("change = 'changed'").select("k")


@query("m3_delete_cascade", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 13 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 13 <> 0")
def m3_delete_cascade(spark, sf_dir):
    tables = {"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "orders": table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")}
    gone = table(spark, sf_dir, "customer").union(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).alias("c_custkey"), *[F.lit(None).cast(t).alias(c) for c, t in table(spark, sf_dir, "customer").dtypes[1:]]))
    left = mutations.cascade(tables, gone.where("c_custkey % 13 = 0").select(F.col("c_custkey").alias("k")), "k")
    return left["orders"].agg(F.lit("orders").alias("name"), F.count("*").alias("n")).union(left["customer"].agg(F.lit("customer").alias("name"), F.count("*").alias("n")))


@query("m4_upsert", f"WITH {INCOMING}, a AS (SELECT c_custkey AS k, c_mktsegment AS seg, 1 AS version, 0 AS s FROM customer UNION ALL SELECT k, seg, version, 1 FROM i) SELECT k, seg, version FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY version DESC, s DESC) = 1")
def m4_upsert(spark, sf_dir):
    return mutations.upsert(customers(spark, sf_dir), incoming(spark, sf_dir), ["k"], "version")


@query("m5_insert_missing", f"WITH {INCOMING} SELECT c_custkey AS k, c_mktsegment AS seg, 1 AS version FROM customer UNION ALL SELECT k, seg, version FROM i ANTI JOIN (SELECT c_custkey AS k FROM customer) USING (k)")
def m5_insert_missing(spark, sf_dir):
    return mutations.insert_missing(customers(spark, sf_dir), incoming(spark, sf_dir), ["k"], "version")


@query("m6_replace", f"WITH {INCOMING} SELECT k, seg, version FROM i UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE c_custkey NOT IN (SELECT k FROM i)")
def m6_replace(spark, sf_dir):
    return mutations.replace(customers(spark, sf_dir), incoming(spark, sf_dir), ["k"])


@query("m12_hit_counter", "SELECT event_type, count(*) AS hits, max(ts) AS last_hit FROM events GROUP BY event_type")
def m12_hit_counter(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("hits"), F.max("ts").alias("last_hit"))


@query("j7_stale_index_rows", f"WITH {INCOMING} SELECT k FROM i LEFT JOIN customer ON k = c_custkey WHERE c_custkey IS NULL OR seg IS DISTINCT FROM c_mktsegment")
def j7_stale_index_rows(spark, sf_dir):
    return mutations.stale_search_rows(incoming(spark, sf_dir).select("k", "seg"), customers(spark, sf_dir), "k", "seg").select("k")


@query("j8_missing_index_rows", f"WITH {INCOMING} SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM i)")
def j8_missing_index_rows(spark, sf_dir):
    return mutations.missing_search_rows(incoming(spark, sf_dir), customers(spark, sf_dir), "k").select("k")


@query("j9_prune_vectors", "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def j9_prune_vectors(spark, sf_dir):
    keep = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return mutations.prune(table(spark, sf_dir, "embeddings").select("vec_id"), keep, "vec_id")


@query("d18_guarded_prune", "SELECT vec_id, 'pruned' AS mode FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) UNION ALL SELECT vec_id, 'unready' FROM embeddings UNION ALL SELECT vec_id, 'empty' FROM embeddings")
def d18_guarded_prune(spark, sf_dir):
    v, d = table(spark, sf_dir, "embeddings").select("vec_id"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    runs = [(d, F.lit(True), "pruned"), (d, F.col("lang") != "fr", "unready"), (d.where("false"), F.lit(True), "empty")]
    out = [mutations.guarded_prune(v, c, ready, "vec_id").withColumn("mode", F.lit(m)) for c, ready, m in runs]
    return out[0].union(out[1]).union(out[2])


@query("a11_fingerprint")
def a11_fingerprint(spark, sf_dir):
    return mutations.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])


@query("s24_additive_migration", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS note, c_name FROM customer")
def s24_additive_migration(spark, sf_dir):
    return mutations.migrate(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": "string", "note": "string"})


@query("t4_debounced_folds", """
WITH e AS (SELECT user_id, ts, event_type <> 'view' AS d, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, d, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), f AS (SELECT user_id, k, max(ts) + INTERVAL 2 HOUR AS fold_at, count(*) FILTER (d) AS coalesced FROM s GROUP BY ALL HAVING count(*) FILTER (d) > 0)
SELECT user_id, fold_at, sum(coalesced) OVER (PARTITION BY user_id ORDER BY k)::BIGINT AS through, coalesced FROM f""")
def t4_debounced_folds(spark, sf_dir):
    """Events as turns, of which views only defer."""
    e = table(spark, sf_dir, "events").withColumn("dirty", F.col("event_type") != "view")
    return folding.debounced(e, 7200, "user_id", "ts").withColumn("fold_at", F.col("fold_at").cast("timestamp_ntz"))


@query("t5_retry_times", """
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM events WHERE event_type IN ('error', 'purchase')),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS attempt FROM e WHERE failed)
SELECT user_id, ts, attempt, ts + least(60, 2 * pow(2, attempt - 1))::INTEGER * INTERVAL 1 SECOND AS next_attempt_at FROM a""")
def t5_retry_times(spark, sf_dir):
    """Errors as failed folds, purchases as successful ones."""
    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')").withColumn("failed", F.col("event_type") == "error")
    return folding.retries(e, "user_id", "ts", order="event_id").withColumns({"next_attempt_at": F.col("next_attempt_at").cast("timestamp_ntz")})
