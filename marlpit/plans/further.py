"""Further queries: hybrid search, recoveries, filters, orders, set operations and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed, more, text
from ..operators import entities, evals, fusion, governance, hybrid, lexical, memory, vector
from ..sources.tables import table
from .registry import query
from .relations import parents
from .retrieval import BENCH, HAS, bm25_sql, tokens_sql

VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
FIRST = f"(SELECT {VEC} FROM embeddings WHERE vec_id = 0)"


@query("r10_hybrid_search")
def r10_hybrid_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 50).alias("document_id"))
    cards = e.where("id < 50").select("document_id", "embedding")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("document_id"), F.col("text").alias("content"))
    q = e.where("id = 0").select(F.col("embedding").alias("q"))
    terms = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), text.search_tokens(F.col("text"), 10).alias("terms"))
    return hybrid.search(chunks, e, cards, q, terms, 5)


@query("w1_channel_ranks", f"SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY round(list_inner_product({VEC}, {FIRST}), 5) DESC, vec_id) AS rank FROM embeddings")
def w1_channel_ranks(spark, sf_dir):
    from ..functions.vectors import dot

    e = table(spark, sf_dir, "embeddings")
    rows = e.join(e.where("vec_id = 0").select(F.col("embedding").alias("q"))).select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("q")), 5).alias("score"))
    return fusion.with_rank(rows, "score", "vec_id", ["label"]).select("vec_id", "rank")


@query("k5_memory_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'view' THEN 0 ELSE 1 END, value DESC, length(props) DESC, ts DESC, event_id) AS place FROM events")
def k5_memory_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "procedural").otherwise("fact").alias("kind"), F.col("value").alias("relevance"), F.length("props").alias("confidence"), F.col("ts").alias("updated_at"), F.col("event_id").alias("id"))
    return e.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(*memory.memory_order()))).select("event_id", "place")


@query("k8_recent_listing", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def k8_recent_listing(spark, sf_dir):
    return memory.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 25, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("k9_facet_pool", "WITH r AS (SELECT o_orderpriority, o_custkey, max(o_totalprice) AS s FROM orders GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY s DESC, o_custkey) AS n FROM r) SELECT o_custkey, min(o_orderpriority) AS facet FROM t WHERE n <= 5 GROUP BY o_custkey")
def k9_facet_pool(spark, sf_dir):
    best = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.max("o_totalprice").alias("score"))
    return lexical.top(best, 5, "o_custkey", partition="o_orderpriority").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("facet"))


@query("f3_vector_where", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) AND vec_id % 7 IN (0, 3) AND starts_with('/data/' || label || '/' || vec_id, '/data/1')")
def f3_vector_where(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("document_id"), (F.col("vec_id") % 7).alias("file_id"), F.concat_ws("/", F.lit("/data"), "label", "vec_id").alias("source_path"))
    return rows.where(vector.record_filter([1, 2], [0, 3], "/data/1")).select("vec_id")


@query("f11_safe_like", "SELECT doc_id FROM documents WHERE contains(lower(text), '%')")
def f11_safe_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.lower("text").contains("%")).select("doc_id")


@query("f16_sensitive_values", "SELECT doc_id, regexp_matches(text, '(?i)password|passcode|api[ _-]?key|secret|token\\b|private key') OR regexp_matches(text, '[0-9](?:[ -]?[0-9]){12,}') AS sensitive FROM documents")
def f16_sensitive_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", more.sensitive(F.col("text")).alias("sensitive"))


@query("f17_operation_contract", "SELECT event_id, lower(trim(' ' || event_type || ' ')) AS key FROM events WHERE event_type IN ('view', 'click') AND value BETWEEN 0 AND 100 AND regexp_matches(event_type, '^[a-z][a-z0-9_.-]{0,63}$')")
def f17_operation_contract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.lower(F.trim(F.concat(F.lit(" "), "event_type", F.lit(" "))))
    return e.where(F.col("event_type").isin("view", "click") & F.col("value").between(0, 100) & F.col("event_type").rlike("^[a-z][a-z0-9_.-]{0,63}$")).select("event_id", key.alias("key"))


@query("f23_abstentions", "SELECT conv_id, turn, regexp_matches(lower(text), '(?:not|n''t|no) (?:enough |sufficient )?(?:information|evidence|mention|contain|answer|know)|cannot (?:answer|determine)|unanswerable') AS abstains FROM conversations WHERE role = 'assistant'")
def f23_abstentions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", more.abstains(F.col("text")).alias("abstains"))


@query("j2_chained_joins", "SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 49")
def j2_chained_joins(spark, sf_dir):
    l, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    both = l.where("l_quantity > 49").join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return both.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("l_orderkey", "l_linenumber", "c_name", "n_name")


@query("j4_collection_members", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j4_collection_members(spark, sf_dir):
    scope = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return entities.within(table(spark, sf_dir, "orders"), scope, "o_custkey").select("o_orderkey")


@query("j6_run_recovery", "SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def j6_run_recovery(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'user'").join(after, ["conv_id", "turn"], "left_semi").select("conv_id", "turn")


@query("t8_missed_turns", "SELECT conv_id, turn FROM conversations a WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant')")
def t8_missed_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.where("role = 'user'").join(after, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query("j13_provenance_check", "WITH p AS (SELECT c_custkey AS id, md5(c_name) AS h FROM customer WHERE c_custkey % 9 <> 0) SELECT CASE WHEN h IS NULL THEN 'scoped_out' WHEN h <> CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE h END THEN 'stale' ELSE 'known' END AS state, count(*) AS n FROM orders LEFT JOIN p ON o_custkey = id GROUP BY state")
def j13_provenance_check(spark, sf_dir):
    p = table(spark, sf_dir, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.md5("c_name").alias("h"))
    both = table(spark, sf_dir, "orders").join(p, "o_custkey", "left")
    state = F.when(F.col("h").isNull(), "scoped_out").when(F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).otherwise(F.col("h")) != F.col("h"), "stale").otherwise("known")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("j22_fetch_in_order", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders QUALIFY position <= 50")
def j22_fetch_in_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = fusion.with_rank(lexical.top(o.select("o_orderkey", "o_totalprice"), 50, "o_orderkey", "o_totalprice", None), "o_totalprice", "o_orderkey", name="position")
    return o.join(ids.select("o_orderkey", "position"), "o_orderkey").select("o_orderkey", "o_custkey", "position")


@query("a15_union_box", "SELECT p_brand, min(p_size) AS x0, max(p_size) AS x1, round(min(p_retailprice), 2) AS y0, round(max(p_retailprice), 2) AS y1 FROM part GROUP BY p_brand")
def a15_union_box(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("x0"), F.max("p_size").alias("x1"), F.round(F.min("p_retailprice"), 2).alias("y0"), F.round(F.max("p_retailprice"), 2).alias("y1"))


@query("o4_missing_facets", "SELECT c_custkey, list_sort(list_filter(['F', 'O', 'P'], lambda s: NOT list_contains(coalesce(l, []), s))) AS missing FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderstatus) AS l FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def o4_missing_facets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("l"))
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.array_sort(F.array_except(F.array(*map(F.lit, "FOP")), F.coalesce("l", none))).alias("missing"))


@query("o6_focus_partition", "SELECT user_id, len(list_distinct(list_filter(list(event_type), lambda x: x IN ('view', 'click')))) AS inside, len(list_distinct(list_filter(list(event_type), lambda x: x NOT IN ('view', 'click')))) AS outside FROM events GROUP BY user_id")
def o6_focus_partition(spark, sf_dir):
    seen, focus = F.collect_set("event_type"), F.array(F.lit("view"), F.lit("click"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.size(F.array_intersect(seen, focus)).alias("inside"), F.size(F.array_except(seen, focus)).alias("outside"))


@query("r16_history_scores", f"""
WITH q AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id), m AS (SELECT c.conv_id, turn, {tokens_sql("q", 24)} AS a, {tokens_sql("text", 24)} AS b, contains(lower(text), lower(substr(q, 1, 12))) AS has, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS p FROM conversations c JOIN q ON q.conv_id = c.conv_id WHERE role <> 'system'),
s AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS o FROM m)
SELECT conv_id, turn, round(greatest(CASE WHEN p <= 2 THEN 2 + 1.0::DOUBLE / p ELSE 0 END, CASE WHEN has THEN 1 + o ELSE 0 END, o), 6) AS score FROM s""")
def r16_history_scores(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text"))["text"].alias("q"))
    p = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    rows = c.where("role <> 'system'").join(q, "conv_id").withColumn("p", p)
    rows = rows.withColumns({"tokens": text.search_tokens(F.col("text"), 24), "position": F.when(F.col("p") <= 2, F.col("p")), "contained": F.lower("text").contains(F.lower(F.substring("q", 1, 12)))})
    return memory.history_scores(rows, text.search_tokens(F.col("q"), 24)).select("conv_id", "turn", "score")


@query("r17_entity_scores")
def r17_entity_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit(".pdf")).alias("filename"), F.col("p_name").alias("title"), "p_brand", "p_type")
    return entities.entity_scores(p, F.concat_ws(" ", F.lit("tell me about"), "title", "p_brand")).select("p_partkey", "entity_score")


@query("r19_label_metrics", "WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings), f AS (SELECT label, min(rank) AS first FROM r WHERE vec_id % 5 = 0 GROUP BY label) SELECT label, first <= 3 AS hit3, round(1.0::DOUBLE / first, 6) AS mrr, round(1.0::DOUBLE / log2(first + 1), 6) AS ndcg FROM f")
def r19_label_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    run = e.select("label", "vec_id", F.row_number().over(W.partitionBy("label").orderBy((F.col("vec_id") * 7919) % 1009, "vec_id")).alias("rank"))
    first = evals.first_relevant(run, e.where("vec_id % 5 = 0"), "label", "vec_id")
    return first.select("label", (F.col("first") <= 3).alias("hit3"), F.round(1.0 / F.col("first"), 6).alias("mrr"), F.round(1.0 / F.log2(F.col("first") + 1), 6).alias("ndcg"))


@query("r5_snippets", "SELECT doc_id, CASE WHEN instr(lower(text), 'the') > 0 THEN substr(text, greatest(instr(lower(text), 'the') - 40, 1), 83) END AS snippet FROM documents")
def r5_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexical.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query("h21_context_prefix", "SELECT doc_id, 'File: doc_' || doc_id || '.txt' || chr(10) || 'Title: ' || substr(source, 1, 200) || chr(10) || 'Section: ' || lang AS prefix FROM documents")
def h21_context_prefix(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", text.context_prefix(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")), F.col("source"), none, F.col("lang"), none).alias("prefix"))


@query("h22_stable_ids")
def h22_stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", more.stable_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("id"))


@query("h25_figure_labels", "SELECT p_partkey, p_size AS number, CASE WHEN p_size % 3 > 0 THEN (['a', 'b'])[p_size % 3] END AS panel FROM part")
def h25_figure_labels(spark, sf_dir):
    panel = F.when(F.col("p_size") % 3 == 1, "a").when(F.col("p_size") % 3 == 2, "B").otherwise("")
    label = more.figure_label(F.concat(F.lit("Fig. "), F.col("p_size").cast("string"), panel, F.lit(": view")))
    return table(spark, sf_dir, "part").select("p_partkey", label["number"].alias("number"), label["panel"].alias("panel"))


@query("h33_safe_clip")
def h33_safe_clip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", more.safe_clip(F.col("text"), 200).alias("clipped"))


@query("h35_query_window", "WITH p AS (SELECT doc_id, text, length(text) AS n, list_min(list_filter([instr(lower(text), 'that'), instr(lower(text), 'und')], lambda x: x > 0)) AS p FROM documents) SELECT doc_id, CASE WHEN n <= 120 THEN text ELSE substr(text, least(greatest(1, coalesce(p, 1) - 30), greatest(1, n - 119)), 120) END AS shown FROM p")
def h35_query_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", more.query_window(F.col("text"), F.array(F.lit("that"), F.lit("und")), 120).alias("shown"))


@query("h37_table_kinds", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type), 'ablation') THEN 'ablation' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'accuracy|f1|score|wer|result|performance') THEN 'results' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'dataset|samples|corpus|split') THEN 'dataset' WHEN regexp_matches(lower(p_name || ' ' || p_type), 'parameter|hyper|setting|learning rate') THEN 'settings' ELSE 'other' END AS kind FROM part")
def h37_table_kinds(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", more.table_kind(F.col("p_name"), F.col("p_type")).alias("kind"))


@query("h49_requested_numbers", "SELECT o_orderkey, list_distinct([o_custkey % 7, o_orderkey % 5]) AS numbers FROM orders WHERE o_custkey % 7 = o_orderkey % 5 UNION ALL SELECT o_orderkey, [o_custkey % 7, o_orderkey % 5] FROM orders WHERE o_custkey % 7 <> o_orderkey % 5")
def h49_requested_numbers(spark, sf_dir):
    said = F.format_string("show figure %d and Fig. %d, not table 9", F.col("o_custkey") % 7, F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", more.requested_numbers(said, "figure").alias("numbers"))


@query("h51_positions")
def h51_positions(spark, sf_dir):
    s = more.squeeze_with_positions(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.length("s.flat").alias("n_flat"), F.try_element_at("s.positions", F.lit(-1)).alias("last"))


@query("h56_citations", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'Table ' || (n_chars % 9) WHEN lang = 'fr' THEN 'Figure ' || (n_chars % 9) WHEN doc_id % 2 = 0 THEN 'p. ' || (doc_id % 100) ELSE substr('document number ' || doc_id || ' of the collection', 1, 32) END AS label FROM documents")
def h56_citations(spark, sf_dir):
    kind = F.when(F.col("lang") == "de", "table").when(F.col("lang") == "fr", "figure").otherwise("text")
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 100)
    name = F.concat(F.lit("document number "), "doc_id", F.lit(" of the collection"))
    return table(spark, sf_dir, "documents").select("doc_id", more.citation(kind, F.col("n_chars") % 9, page, name).alias("label"))


@query("d21_reference_sentences")
def d21_reference_sentences(spark, sf_dir):
    said = F.concat("text", F.lit(" As Fig. 3 shows, it holds. Others differ. See figure 3 again."))
    return table(spark, sf_dir, "documents").select("doc_id", more.reference_sentences(said, F.lit(3)).alias("sentences"))


@query("d22_page_context", """
WITH l AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS content FROM (SELECT doc_id, split(text, chr(10)) AS s FROM documents)) SELECT doc_id, n // 4 AS page, string_agg(content, ' ' ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n // 4 ORDER BY n) AS k FROM l) WHERE k <= 3 GROUP BY ALL""")
def d22_page_context(spark, sf_dir):
    lines = parents(spark, sf_dir).withColumn("page", F.floor(F.col("n") / 4))
    first = lines.withColumn("k", F.row_number().over(W.partitionBy("document_id", "page").orderBy("n"))).where("k <= 3")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: x["content"]), " ")
    return first.groupBy(F.col("document_id").alias("doc_id"), "page").agg(joined.alias("context"))


@query("d23_completeness", "SELECT o_custkey, bool_and(o_orderpriority <> '5-LOW' AND o_totalprice > 1000) AS complete FROM orders GROUP BY o_custkey")
def d23_completeness(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and((F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") > 1000)).alias("complete"))


@query("d4_repaired_referents")
def d4_repaired_referents(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").alias("document_id"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("filename"))
    lost = p.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".pdf"))).alias("name"), F.col("p_partkey").cast("string").alias("topic"))
    return entities.repaired(lost, docs, "name", "topic")


@query("h53_redacted_props", "SELECT event_id, '[REDACTED_SECRET]' AS token, event_type AS kind FROM events")
def h53_redacted_props(spark, sf_dir):
    m = governance.redact_map(F.create_map(F.lit("accessToken"), F.col("props"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", m["accessToken"].alias("token"), m["kind"].alias("kind"))


@query("s17_vault_notes")
def s17_vault_notes(spark, sf_dir):
    from ..sources.files import vault_notes

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), "n_regionkey")
    order = W.partitionBy("n_regionkey").orderBy(F.col("id").cast("int"))
    edges = n.withColumn("dst", F.lead("id").over(order)).where("dst IS NOT NULL").select(F.col("id").alias("src"), "dst")
    return vault_notes(n.select("id", "label"), edges)


@query("a1_totals", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def a1_totals(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "pages", "conversations")]
    return counts[0].union(counts[1]).union(counts[2])


@query("a4_distinct_conversations", "SELECT role, count(DISTINCT conv_id) AS conversations, CAST(sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) AS BIGINT) AS long_turns FROM conversations GROUP BY role")
def a4_distinct_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("conversations"), F.sum(F.when(F.length("text") > 200, 1).otherwise(0)).alias("long_turns"))


FOLDER = "regexp_extract(url, '^([^?#]*)/[^/?#]*', 1)"


@query("f4_folder", f"SELECT page_id FROM pages WHERE {FOLDER} IN (SELECT min({FOLDER}) FROM pages WHERE {FOLDER} <> '')")
def f4_folder(spark, sf_dir):
    """Pages of one folder, by equality on the folder."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^([^?#]*)/[^/?#]*", 1).alias("folder"))
    one = p.where("folder <> ''").agg(F.min("folder").alias("wanted"))
    return p.join(one, F.col("folder") == F.col("wanted")).select("page_id")


@query("f20_focus_scope", "SELECT vec_id, 'focused' AS mode FROM embeddings WHERE label IN (SELECT label FROM embeddings WHERE vec_id % 97 = 0) UNION ALL SELECT vec_id, 'open' FROM embeddings")
def f20_focus_scope(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    focus = e.where("vec_id % 97 = 0")
    runs = [(focus, "focused"), (None, "open"), (focus.where("false"), "empty")]
    out = [entities.within(e, s, "label").select("vec_id", F.lit(m).alias("mode")) for s, m in runs]
    return out[0].union(out[1]).union(out[2])


@query("o3_collection_scopes", "SELECT doc_id, 'both' AS mode FROM documents WHERE lang = 'de' AND n_chars > 500 UNION ALL SELECT doc_id, 'forced' FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'members' FROM documents WHERE n_chars > 500")
def o3_collection_scopes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    forced, members = d.where("lang = 'de'").select("doc_id"), d.where("n_chars > 500").select("doc_id")
    runs = [(forced, members, "both"), (forced, None, "forced"), (None, members, "members"), (forced.where("false"), members, "empty")]
    out = [entities.collection_scope(a, b, "doc_id").select("doc_id", F.lit(m).alias("mode")) for a, b, m in runs]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("w2_rrf_terms", "SELECT doc_id, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)), 9) AS term FROM documents")
def w2_rrf_terms(spark, sf_dir):
    ranked = fusion.with_rank(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "n_chars", "doc_id", ["lang"])
    return ranked.select("doc_id", F.round(fusion.rrf_term(F.col("rank")), 9).alias("term"))


_ASKED_TEXT = "text || (['', ' what is it', ' multimodal', ' the table of results', ' audio-visual'])[1 + item_id % 5]"
_BM25 = bm25_sql("SELECT doc_id, text FROM documents", {"text": 1.0}, k=20).replace(f"({BENCH})", f"(SELECT item_id AS query_id, {tokens_sql('text', 10)} AS terms FROM (SELECT item_id, {_ASKED_TEXT} AS text FROM benchmark))")


def _topics_sql(asked, tags, shown):
    has = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    return " AND ".join(f"(NOT {has(asked, fixed.TOPIC_ASKED[t])} OR list_contains({tags}, '{t}') OR {has(shown, fixed.TOPIC_SHOWN[t])})" for t in fixed.TOPIC_ASKED)


@query("r10_hybrid_reranked", f"""
WITH ch AS (SELECT doc_id AS id, doc_id % 50 AS document_id, (['text', 'text', 'table', 'figure'])[1 + doc_id % 4] AS kind, text AS content, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
cd AS (SELECT vec_id % 50 AS document_id, arg_min(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), vec_id) AS e, CASE WHEN vec_id % 50 % 3 = 0 THEN ['multimodal_fusion'] ELSE [] END AS tags, CASE WHEN vec_id % 50 % 7 = 0 THEN 'audio visual fusion' ELSE '' END AS shown FROM embeddings GROUP BY vec_id % 50),
q AS (SELECT item_id AS query_id, {_ASKED_TEXT} AS text, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM benchmark JOIN embeddings ON vec_id = item_id * 2),
nc AS (SELECT query_id, document_id, {_topics_sql("replace(lower(text), '-', ' ')", "tags", "shown")} AS fits, row_number() OVER (PARTITION BY query_id ORDER BY round(pow(list_distance(e, q), 2), 6), document_id) AS r FROM q, cd QUALIFY r <= 20),
kc AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY query_id) AS any_fits FROM nc) WHERE fits OR NOT any_fits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 10),
nv AS (SELECT query_id, id, kind, round(pow(list_distance(e, q), 2), 6) AS d FROM kc JOIN ch USING (document_id) JOIN q USING (query_id) WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, kind ORDER BY d, id) <= CASE kind WHEN 'text' THEN 20 ELSE 10 END),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, CASE kind WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END, id) AS vector_rank FROM nv),
lx AS ({_BM25}), bo AS (SELECT query_id, id, max(v) AS vector_rank, max(l) AS lexical_rank FROM (SELECT query_id, id, vector_rank AS v, NULL AS l FROM vr UNION ALL SELECT query_id, doc_id, NULL, rank FROM lx SEMI JOIN q USING (query_id)) GROUP BY query_id, id),
tl AS (SELECT bo.*, kind, content, e, text, q, {tokens_sql('text', 24)} AS a, {tokens_sql('content', 24)} AS b, contains(lower(text), 'what is') OR contains(lower(text), 'explain') AS explains FROM bo JOIN ch USING (id) JOIN q USING (query_id)),
sc AS (SELECT query_id, id, vector_rank, lexical_rank, e, q, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END * 0.012::DOUBLE
  + CASE WHEN explains AND {HAS('lower(content)', fixed.EXPLANATORY_CONTENT)} THEN 0.028 ELSE 0 END - CASE WHEN explains AND {HAS('lower(content)', fixed.CLOSING_CONTENT)} THEN 0.012 ELSE 0 END
  + CASE WHEN kind = 'figure' AND {HAS('lower(text)', fixed.FIGURE_WORDS)} THEN 0.018 ELSE 0 END + CASE WHEN kind = 'table' AND {HAS('lower(text)', fixed.TABLE_WORDS)} THEN 0.014 ELSE 0 END
  + CASE WHEN vector_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 0.004 ELSE 0 END + CASE WHEN lexical_rank = 1 THEN 0.002 ELSE 0 END, 9) AS score FROM tl),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, lexical_rank, id) AS place FROM sc QUALIFY place <= 24),
hd AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 5 AS changes, place <= 20 AS head, CASE WHEN e IS NULL THEN 0 ELSE round(list_cosine_similarity(e, q), 6) END AS cosine FROM pl),
rs AS (SELECT *, round(CASE WHEN changes AND head THEN score + 0.35::DOUBLE * cosine ELSE score END, 6) AS rerank_score FROM hd),
wi AS (SELECT * FROM rs QUALIFY NOT changes OR NOT head OR row_number() OVER (PARTITION BY query_id, head ORDER BY rerank_score DESC, place) <= 5)
SELECT query_id, id, score, vector_rank, lexical_rank, place, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN changes THEN 0 ELSE place END, rerank_score DESC, head DESC, place) AS rank FROM wi QUALIFY rank <= 5""")
def r10_hybrid_reranked(spark, sf_dir):
    """All stages for all benchmark questions that have a vector; chunks are documents, of which those with a vector are found by it, too."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (1 + n).cast("int"))
    k = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(k.alias("id"), (k % 50).alias("document_id"), at(["text", "text", "table", "figure"], k % 4).alias("kind"), F.col("text").alias("content"))
    d = F.col("document_id")
    cards = e.groupBy((F.col("vec_id") % 50).alias("document_id")).agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumns({"topic_tags": F.when(d % 3 == 0, F.array(F.lit("multimodal_fusion"))).otherwise(F.array().cast("array<string>")), "text": F.when(d % 7 == 0, "audio visual fusion").otherwise("")})
    asked = table(spark, sf_dir, "benchmark").join(e.select("vec_id", "embedding"), F.col("item_id") * 2 == F.col("vec_id"))
    asked = asked.select(F.col("item_id").alias("query_id"), F.concat("text", at(["", " what is it", " multimodal", " the table of results", " audio-visual"], F.col("item_id") % 5)).alias("text"), F.col("embedding").alias("q"))
    return hybrid.search_each(chunks, cards, asked, 5, vectors=e.select(F.col("vec_id").alias("id"), "embedding"))
