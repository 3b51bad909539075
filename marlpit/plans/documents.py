"""Queries of ingestion: text functions, cards, chunks, tables, captions, redaction and catalog relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import catalog, chunking, governance, mutations
from ..sources import files
from ..sources.tables import table
from .registry import query

SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
SQ = SQUEEZE.format("text")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def filename():
    return F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))


@query("h1_squeeze", f"SELECT doc_id, md5({SQ}) AS flat FROM documents")
def h1_squeeze(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("flat"))


PARTS = f"list_transform(string_split({SQ}, '. '), lambda p: trim(ltrim(trim(p), '#')))"


@query("h14_title_guess", f"SELECT doc_id, coalesce(list_filter({PARTS}, lambda p: length(p) BETWEEN 8 AND 160 AND len(string_split_regex(p, ' +')) <= 18)[1], 'doc ' || doc_id) AS title FROM documents")
def h14_title_guess(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.title_guess(F.col("text"), F.concat(F.lit("doc_"), F.col("doc_id"))).alias("title"))


HEAD = f"substr({SQ}, 1, 700)"


@query("h13_summary", f"""
WITH s AS (SELECT doc_id, {SQ} AS f, {HEAD} AS h FROM documents), c AS (SELECT *, CASE WHEN instr(reverse(h), ' .') > 0 THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END AS pos FROM s)
SELECT doc_id, CASE WHEN length(f) <= 700 THEN f WHEN pos >= 180 THEN trim(substr(h, 1, pos)) ELSE trim(h) END AS summary FROM c""")
def h13_summary(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("h15_language", f"SELECT doc_id, CASE WHEN regexp_matches({SQ}, '[đĐăâêôơư]') THEN 'vi' ELSE 'en' END AS language FROM documents")
def h15_language(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.card_language(F.col("text")).alias("language"))


HAY = "lower('doc_' || doc_id || '.txt ' || {} || ' ' || (['rag agent', 'visual chart', 'sqlite', 'no tag'])[1 + doc_id % 4])".format(SQ)
TAGS = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(h, '{p}')" for p in ps) + f" THEN '{t}' END" for t, ps in fixed.TOPIC_RULES.items()) + "], lambda x: x IS NOT NULL)"


def hay():
    tail = F.element_at(F.array(*map(F.lit, ["rag agent", "visual chart", "sqlite", "no tag"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return F.concat_ws(" ", filename(), text.squeeze(F.col("text")), tail)


@query("h16_topic_tags", f"WITH x AS (SELECT doc_id, {HAY} AS h FROM documents) SELECT doc_id, {TAGS} AS tags FROM x")
def h16_topic_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.topic_tags(hay()).alias("tags"))


@query("h17_project_tags", f"WITH x AS (SELECT doc_id, {HAY} AS h FROM documents) SELECT doc_id, list_filter([CASE WHEN contains(h, 'project_plan') OR contains(h, 'local ai agent') OR contains(h, 'lancedb') THEN 'local_ai_agent' END, CASE WHEN contains(h, 'speech emotion') OR contains(h, 'multimodal') OR contains(h, 'ser') THEN 'ser_research' END], lambda x: x IS NOT NULL) AS tags FROM x")
def h17_project_tags(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.project_tags(hay()).alias("tags"))


@query("h18_doc_type", f"""
WITH x AS (SELECT doc_id, {HAY} AS h FROM documents), t AS (SELECT *, {TAGS} AS tags FROM x)
SELECT doc_id, CASE WHEN contains(h, 'project_plan') THEN 'project_plan' WHEN contains(h, 'lancedb') OR list_contains(tags, 'rag') OR list_contains(tags, 'agent') THEN 'technical_plan'
  WHEN contains(h, 'abstract') AND (contains(h, 'references') OR contains(h, 'introduction')) THEN 'research_paper' ELSE 'document' END AS doc_type FROM t""")
def h18_doc_type(spark, sf_dir):
    h = hay()
    return docs(spark, sf_dir).select("doc_id", text.doc_type(F.lit("x.txt"), h, text.topic_tags(h)).alias("doc_type"))


@query("h19_importance", f"""
WITH x AS (SELECT doc_id, text, {HAY} AS h FROM documents), t AS (SELECT *, {TAGS} AS tags FROM x), k AS (SELECT *, list_contains(tags, 'rag') OR list_contains(tags, 'agent') OR contains(h, 'lancedb') OR contains(h, 'project_plan') AS plan FROM t)
SELECT doc_id, round(least(1.0, 0.45 + CASE WHEN len(tags) > 0 THEN 0.35 ELSE 0 END + CASE WHEN plan THEN 0.25 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\\S+')) > 500 THEN 0.1 ELSE 0 END), 6) AS importance FROM k""")
def h19_importance(spark, sf_dir):
    h = hay()
    tags = text.topic_tags(h)
    words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), F.lit(0)))
    return docs(spark, sf_dir).select("doc_id", F.round(catalog.importance(tags, text.doc_type(F.lit("x.txt"), h, tags), words), 6).alias("importance"))


@query("a9_keywords", f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) <= 40 AND w NOT IN ({", ".join(f"'{w}'" for w in fixed.KEYWORD_STOPWORDS)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM c)
SELECT doc_id, list(w ORDER BY r) AS keywords FROM r WHERE r <= 18 GROUP BY doc_id UNION ALL SELECT doc_id, [] FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def a9_keywords(spark, sf_dir):
    return catalog.keywords(docs(spark, sf_dir))


@query("s9_document_cards")
def s9_document_cards(spark, sf_dir):
    return catalog.cards(docs(spark, sf_dir), filename())


@query("h9_headings", "SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, split(text, chr(10)) AS s FROM documents)) WHERE length(line) BETWEEN 4 AND 80 AND upper(line) = line AND regexp_matches(line, '\\p{Lu}') OR regexp_matches(line, '^#{1,6}\\s+\\S') OR length(line) <= 120 AND regexp_matches(line, '^(?:\\d+(?:\\.\\d+)*|[IVXLC]+)[.)]?\\s+\\p{Lu}') AND NOT regexp_matches(line, '[.!?]$')")
def h9_headings(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(text.is_heading(F.col("line"))).select("doc_id", F.col("i").cast("long").alias("i"), "line")


@query("h10_sentences")
def h10_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))


@query("h8_blocks", "SELECT doc_id, len(list_filter(list_transform(split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def h8_blocks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.blocks(F.col("text"))).alias("n"))


@query("h28_fold_accents", f"SELECT doc_id, md5(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}')) AS folded FROM documents")
def h28_fold_accents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


@query("h34_clip", """
WITH s AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM documents), p AS (SELECT *, instr(reverse(h), ' .') AS a, instr(reverse(h), ' ') AS b FROM s)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(substr(h, 1, CASE WHEN a > 0 AND length(h) - a >= 150 THEN length(h) - a WHEN b > 0 AND length(h) - b >= 150 THEN length(h) - b ELSE 300 END)) || '...' END AS clipped FROM p""")
def h34_clip(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clip(F.col("text"), 300).alias("clipped"))


@query("h43_head_tail", "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 246) || chr(10) || '...[TRUNCATED_DEBUG_TRACE]...' || chr(10) || right(text, 123) END AS clipped FROM documents")
def h43_head_tail(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.head_tail(F.col("text"), 400).alias("clipped"))


@query("h52_shingle_counts", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) ELSE 0 END AS n FROM w""")
def h52_shingle_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(text.shingles(F.col("text"))).alias("n"))


@query("s10_first_words", "SELECT doc_id, array_to_string(regexp_extract_all(text, '\\S+')[1:50], ' ') AS head, len(regexp_extract_all(text, '\\S+')) > 50 AS truncated FROM documents")
def s10_first_words(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.first_words(F.col("text"), 50).alias("head"), (F.size(F.split(F.trim("text"), r"\s+")) > 50).alias("truncated"))


@query("s11_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def s11_content_hash(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("s1_supported_types", "SELECT page_id, lower(regexp_extract(url, '\\.([^./?#]+)(?:[?#].*)?$', 1)) AS suffix FROM pages WHERE lower(regexp_extract(url, '\\.([^./?#]+)(?:[?#].*)?$', 1)) IN ('html', 'txt', 'md', 'pdf', 'docx')")
def s1_supported_types(spark, sf_dir):
    suffix = files.suffix(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", suffix.alias("suffix")).where(F.col("suffix").isin(*files.SUPPORTED, "html"))


@query("s2_html_text", "SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'gs'), '\\s+', ' ', 'g'))) AS n_chars, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def s2_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(files.html_text(F.col("html"))).alias("n_chars"), files.html_title(F.col("html")).alias("title"))


@query("w18_structural_chunks")
def w18_structural_chunks(spark, sf_dir):
    return chunking.chunk(docs(spark, sf_dir)).drop("parent_content")


@query("m10_rebuild_from_chunks")
def m10_rebuild_from_chunks(spark, sf_dir):
    return chunking.rebuild(chunking.chunk(docs(spark, sf_dir)).drop("parent_content"))


@query("d17_canonical_text")
def d17_canonical_text(spark, sf_dir):
    return chunking.canonical_text(chunking.chunk(docs(spark, sf_dir)))


# A markdown report for each nation, with a captioned table of its suppliers.
REPORT = """
rows AS (SELECT s_nationkey AS k, string_agg('| ' || s_name || ' | ' || CAST(s_suppkey AS VARCHAR) || ' |', chr(10) ORDER BY s_suppkey) AS body, count(*) AS n FROM supplier GROUP BY s_nationkey),
md AS (SELECT n_nationkey AS doc_id, n, '# ' || n_name || chr(10) || 'Figure ' || n_nationkey || '. Sales of' || chr(10) || 'all years' || chr(10) || chr(10) || 'Table ' || n_nationkey || ': Suppliers' || chr(10) || '| name | key |' || chr(10) || '|---|---|' || chr(10) || body || chr(10) || 'The end' AS text FROM rows JOIN nation ON n_nationkey = k)"""


def reports(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    line = F.concat(F.lit("| "), "s_name", F.lit(" | "), F.col("s_suppkey").cast("string"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("x")))), lambda r: r["x"]), "\n")
    rows = s.groupBy(F.col("s_nationkey").alias("doc_id")).agg(body.alias("body"))
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    md = F.concat(F.lit("# "), "n_name", F.lit("\nFigure "), key, F.lit(". Sales of\nall years\n\nTable "), key, F.lit(": Suppliers\n| name | key |\n|---|---|\n"), "body", F.lit("\nThe end"))
    return rows.join(n, F.col("doc_id") == F.col("n_nationkey")).select("doc_id", md.alias("text"))


@query("h23_pipe_tables", f"WITH {REPORT} SELECT doc_id, 0 AS table_index, n AS n_rows, 2 AS n_columns, 'Table ' || doc_id || ': Suppliers' AS caption FROM md")
def h23_pipe_tables(spark, sf_dir):
    return chunking.tables_of(reports(spark, sf_dir)).drop("markdown")


@query("h24_captions", f"WITH {REPORT} SELECT doc_id, 'figure' AS kind, 0 AS caption_index, 'Figure ' || doc_id || '. Sales of all years' AS caption FROM md UNION ALL SELECT doc_id, 'table', 0, 'Table ' || doc_id || ': Suppliers' FROM md")
def h24_captions(spark, sf_dir):
    r = reports(spark, sf_dir)
    one = lambda kind: chunking.captions(r, kind).select("doc_id", F.lit(kind).alias("kind"), "caption_index", "caption")
    return one("figure").union(one("table"))


@query("w17_section_carry", f"""
WITH {REPORT}, l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, split(text, chr(10)) AS s FROM md))
SELECT doc_id, i, last_value(CASE WHEN starts_with(line, '# ') THEN substr(line, 3) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l""")
def w17_section_carry(spark, sf_dir):
    lines = reports(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return chunking.heading_path(lines, "doc_id", "i", "line").select("doc_id", F.col("i").cast("long").alias("i"), F.element_at("heading_path", -1).alias("section"))


@query("h41_redaction")
def h41_redaction(spark, sf_dir):
    d = docs(spark, sf_dir)
    k = F.col("doc_id") % 5
    tail = F.when(k == 3, " password=\"it's-hunter2\" api_key=\"abc123 x").when(k == 0, " api_key=abc123XYZ end").when(k == 1, " Bearer abcdefghijkl done").when(k == 2, " https://u:pw@host/x").otherwise(" nothing")
    return governance.redact_table(d.select("doc_id", F.concat("text", tail).alias("text")), "text")


@query("h42_denied_keys", "SELECT event_id, regexp_matches(lower(k), '(^|_)(token|secret|password)$') AS denied FROM (SELECT event_id, (['accessToken', 'page', 'client_secret', 'tokens', 'Password'])[1 + event_id % 5] AS c, (['access_token', 'page', 'client_secret', 'tokens', 'password'])[1 + event_id % 5] AS k FROM events)")
def h42_denied_keys(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ["accessToken", "page", "client_secret", "tokens", "Password"])), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", governance.denied_key(name).alias("denied"))


@query("h44_bound_bytes", """
WITH RECURSIVE b AS (SELECT doc_id, text AS t, octet_length(encode(text)) > 500 AS cut, 0 AS n FROM documents UNION ALL SELECT doc_id, substr(t, 1, length(t) // 2), cut, n + 1 FROM b WHERE octet_length(encode(t)) > 500)
SELECT doc_id, arg_max(md5(t), n) AS bounded, any_value(cut) AS cut FROM b GROUP BY doc_id""")
def h44_bound_bytes(spark, sf_dir):
    bounded, cut = governance.bound_bytes(F.col("text"), 500)
    return docs(spark, sf_dir).select("doc_id", F.md5(bounded).alias("bounded"), cut.alias("cut"))


@query("f14_cache_ttl", "SELECT event_id FROM events WHERE event_id % 10 = 0 OR ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15'")
def f14_cache_ttl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    expires = F.when(F.col("event_id") % 10 != 0, F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return e.where(governance.cache_live(expires, F.lit("2024-01-15").cast("timestamp_ntz"))).select("event_id")


@query("f15_valid_payload", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 4 <> 1")
def f15_valid_payload(spark, sf_dir):
    docs_ = F.when(F.col("event_id") % 3 == 0, "[]").otherwise('["a"]')
    ok = F.when(F.col("event_id") % 4 == 1, "false").otherwise("true")
    payload = F.concat(F.lit('{"documents": '), docs_, F.lit(', "validation": {"ok": '), ok, F.lit("}}"))
    return table(spark, sf_dir, "events").where(governance.valid_payload(payload)).select("event_id")


@query("h53_cache_key", "SELECT o_orderkey, sha256('{\"a\":' || o_orderkey || ',\"b\":\"' || o_orderstatus || '\"}') AS key FROM orders")
def h53_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", governance.cache_key(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("key"))


@query("f18_stale_versions", "SELECT c_custkey, list_filter([CASE WHEN c_custkey % 2 = 1 THEN 'parser' END, CASE WHEN c_nationkey % 3 <> 0 THEN 'chunker' END], lambda x: x IS NOT NULL) AS stale FROM customer")
def f18_stale_versions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    now, built = {"parser": F.col("c_custkey") % 2, "chunker": F.col("c_nationkey") % 3}, {"parser": F.lit(0), "chunker": F.lit(0)}
    return c.select("c_custkey", mutations.stale_parts(now, built).alias("stale"))


@query("d20_ocr_gate", "WITH l AS (SELECT doc_id, length(replace(unnest(split(text, chr(10))), ' ', '')) AS n FROM documents) SELECT doc_id, avg(CASE WHEN n >= 40 THEN 1.0 ELSE 0.0 END) < 0.35 AND avg(n) < 120 AS needs_ocr FROM l GROUP BY doc_id")
def d20_ocr_gate(spark, sf_dir):
    pages = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return files.needs_ocr(pages.select("doc_id", F.regexp_replace("content", " ", "").alias("content")), "doc_id")


@query("k10_fuzzy_names")
def k10_fuzzy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.groupBy("p_brand").agg(F.min("p_name").alias("n")).select(F.expr("CASE WHEN p_brand LIKE '%3' THEN n ELSE substring(n, 1, length(n) - 2) END").alias("asked"))
    return catalog.fuzzy_names(p.select("p_partkey", "p_name"), asked, "p_name", "asked", "p_partkey")


@query("j15_catalog_merge", "WITH c AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20), f AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 20), a AS (SELECT id, 1.0::DOUBLE / (60 + r) + 0.15 + 0.05 * 0.5 AS s FROM c UNION ALL SELECT id, 1.0::DOUBLE / (60 + r) + 0.05 FROM f) SELECT id, round(sum(s), 9) AS score FROM a GROUP BY id")
def j15_catalog_merge(spark, sf_dir):
    from ..operators.fusion import with_rank
    from ..operators.lexical import top

    a = with_rank(top(docs(spark, sf_dir).select("doc_id", "n_chars"), 20, "doc_id", "n_chars", None), "n_chars", "doc_id").select(F.col("doc_id").alias("id"), "rank", F.lit(0.5).alias("importance"))
    b = with_rank(top(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 20, "c_custkey", "c_acctbal", None), "c_acctbal", "c_custkey").select(F.col("c_custkey").alias("id"), "rank")
    return catalog.catalog_scores(a, b)
