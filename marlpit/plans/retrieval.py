"""Queries of lexical and vector ranking, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text, vectors
from ..operators import evals, fusion, lexical, vector
from ..sources.tables import table
from .registry import query

STOP = "[" + ", ".join(f"'{w}'" for w in fixed.SEARCH_STOPWORDS) + "]"


def tokens_sql(column: str, most: int) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: trim(w, '._-')), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"
    return f"coalesce((SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest({words}) AS w, unnest(range(len({words}))) AS i) GROUP BY w ORDER BY i LIMIT {most})), [])"


BENCH = f"SELECT item_id AS query_id, {tokens_sql('text', 10)} AS terms FROM benchmark"
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def bm25_sql(docs: str, fields: dict[str, float], scope: str = "true", k: int = 10) -> str:
    explode = " UNION ALL ".join(f"SELECT doc_id, unnest({WORDS.format(f)}) AS term, {w} AS w FROM d" for f, w in fields.items())
    length = " + ".join(f"{w} * len({WORDS.format(f)})" for f, w in fields.items())
    return f"""
WITH d AS ({docs}), q AS ({BENCH}), wanted AS (SELECT query_id, unnest(list_distinct(terms)) AS term FROM q),
t AS (SELECT doc_id, term, sum(w) AS tf FROM ({explode}) GROUP BY doc_id, term),
s AS (SELECT count(*) AS n, avg({length}) AS avgdl FROM d),
f AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(avgdl) AS avgdl FROM t, s GROUP BY term),
l AS (SELECT doc_id, {length} AS dl FROM d WHERE {scope}),
c AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM wanted JOIN t USING (term) JOIN f USING (term) JOIN l USING (doc_id) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= {k}"""


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.search_tokens(F.col("text"), 10).alias("terms"))


@query("r1_bm25_topk", bm25_sql("SELECT doc_id, text FROM documents", {"text": 1.0}))
def r1_bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.top(lexical.bm25(docs, bench_queries(spark, sf_dir), "doc_id", {"text": 1.0}), 10, "doc_id")


@query("r2_bm25_fields", bm25_sql("SELECT doc_id, text, concat_ws(' ', source, lang) AS meta FROM documents", {"text": 1.0, "meta": 1.0}))
def r2_bm25_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", "source", "lang").alias("meta"))
    return lexical.top(lexical.bm25(docs, bench_queries(spark, sf_dir), "doc_id", {"text": 1.0, "meta": 1.0}), 10, "doc_id")


@query("r3_bm25_weighted_scope", bm25_sql("SELECT doc_id, text, lang, split_part(text, chr(10), 1) AS title FROM documents", {"title": 2.0, "text": 1.0}, "lang = 'en'"))
def r3_bm25_weighted_scope(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    return lexical.top(lexical.bm25(docs, bench_queries(spark, sf_dir), "doc_id", {"title": 2.0, "text": 1.0}, scope=F.col("lang") == "en"), 10, "doc_id")


FOLD = "translate(lower(text), 'àâéèêëîïôöùûüçñáíóúä', 'aaeeeeiioouuucnaioua')"


@query("r4_bm25_messages", f"""
WITH d AS (SELECT conv_id * 1000 + turn AS doc_id, {FOLD} AS text FROM conversations WHERE role <> 'system'), q AS (SELECT item_id AS query_id, list_slice(list_filter({tokens_sql(FOLD, 24)}, lambda w: true), 1, 10) AS terms FROM benchmark),
w AS (SELECT query_id, unnest(list_distinct(terms)) AS term FROM q), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len({WORDS.format("text")})) AS avgdl FROM d), f AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(avgdl) AS avgdl FROM t, s GROUP BY term),
l AS (SELECT doc_id, len({WORDS.format("text")}) AS dl FROM d),
c AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM w JOIN t USING (term) JOIN f USING (term) JOIN l USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5""")  # fmt: skip
def r4_bm25_messages(spark, sf_dir):
    fold = lambda c: F.translate(F.lower(c), "àâéèêëîïôöùûüçñáíóúä", "aaeeeeiioouuucnaioua")
    docs = table(spark, sf_dir, "conversations").where("role <> 'system'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), fold(F.col("text")).alias("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.search_tokens(fold(F.col("text")), 10).alias("terms"))
    return lexical.top(lexical.bm25(docs, asked, "doc_id", {"text": 1.0}), 5, "doc_id")


@query("a21_corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len({WORDS.format('text')})), 6) AS avg_words, max(len({WORDS.format('text')})) AS most_words FROM documents")
def a21_corpus_stats(spark, sf_dir):
    n = F.size(lexical.words_of(F.col("text")))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.round(F.avg(n), 6).alias("avg_words"), F.max(n).alias("most_words"))


@query("h2_search_tokens", f"SELECT item_id, {tokens_sql('text', 12)} AS tokens FROM benchmark")
def h2_search_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.search_tokens(F.col("text")).alias("tokens"))


@query("h3_or_query", f"SELECT item_id, array_to_string(list_transform({tokens_sql('text', 10)}, lambda t: '\"' || replace(t, '\"', '\"\"') || '\"'), ' OR ') AS q FROM benchmark")
def h3_or_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.or_query(text.search_tokens(F.col("text"), 10)).alias("q"))


@query("h4_last_terms", f"SELECT item_id, list_slice(t, greatest(len(t) - 7, 1), len(t)) AS terms FROM (SELECT item_id, {tokens_sql('text', 100000)} AS t FROM benchmark)")
def h4_last_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.last_terms(F.col("text"), 8).alias("terms"))


@query("h7_count_tokens", "SELECT doc_id, len(regexp_extract_all(text, '\\s*(?:[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s])')) AS n_tokens FROM documents")
def h7_count_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.col("text")).alias("n_tokens"))


@query("h31_overlap_ratio", f"""
WITH q AS (SELECT item_id, {tokens_sql('text', 24)} AS a, {tokens_sql("upper(substr(text, 40))", 24)} AS b FROM benchmark)
SELECT item_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS ratio FROM q""")
def h31_overlap_ratio(spark, sf_dir):
    a, b = text.search_tokens(F.col("text"), 24), text.search_tokens(F.upper(F.substring("text", F.lit(40), F.length("text"))), 24)
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(text.overlap_ratio(a, b), 6).alias("ratio"))


VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
FIRST = f"(SELECT {VEC} FROM embeddings WHERE vec_id = 0)"
#: Each query with each row.
PAIRS = f"p AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, q.e AS a, r.e AS b FROM (SELECT vec_id, {VEC} AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, label, {VEC} AS e FROM embeddings) r)"


def asked_vectors(spark, sf_dir):
    """All vectors, and those whose id is divisible by 20 as queries."""
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _first(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("r6_knn_l2", f"WITH {PAIRS} SELECT query_id, vec_id, round(pow(list_distance(a, b), 2), 5) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(pow(list_distance(a, b), 2), 5), vec_id) AS rank FROM p WHERE label IN (0, 1, 2, 3) QUALIFY rank <= 10")
def r6_knn_l2(spark, sf_dir):
    rows, asked = asked_vectors(spark, sf_dir)
    return vector.nearest_each(rows, asked, "vec_id", "embedding", 10, "l2", F.col("label").isin(0, 1, 2, 3), 5).withColumnRenamed("score", "distance")


@query("r7_cosine_topk", f"WITH {PAIRS} SELECT query_id, vec_id, round(list_cosine_similarity(a, b), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, b), 5) DESC, vec_id) AS rank FROM p WHERE vec_id <> query_id QUALIFY rank <= 10")
def r7_cosine_topk(spark, sf_dir):
    rows, asked = asked_vectors(spark, sf_dir)
    return vector.nearest_each(rows, asked, "vec_id", "embedding", 10, "cosine", None, 5, own=False)


@query("r8_dot_topk", f"WITH {PAIRS} SELECT query_id, vec_id, round(list_inner_product(a, b), 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(a, b), 5) DESC, vec_id) AS rank FROM p QUALIFY rank <= 10")
def r8_dot_topk(spark, sf_dir):
    rows, asked = asked_vectors(spark, sf_dir)
    return vector.nearest_each(rows, asked, "vec_id", "embedding", 10, "dot", None, 5)


@query("k3_merged_modalities", f"""
WITH {PAIRS}, m AS (SELECT query_id, vec_id, CASE WHEN label < 4 THEN 'text' WHEN label < 7 THEN 'table' ELSE 'figure' END AS modality, round(pow(list_distance(a, b), 2), 5) AS distance FROM p),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, modality ORDER BY distance, vec_id) <= CASE modality WHEN 'text' THEN 20 ELSE 10 END)
SELECT query_id, vec_id, modality, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM k""")
def k3_merged_modalities(spark, sf_dir):
    rows, asked = asked_vectors(spark, sf_dir)
    kind = F.when(F.col("label") < 4, "text").when(F.col("label") < 7, "table").otherwise("figure")
    limits = {m: vector.adaptive_k(5)[m] for m in ("text", "table", "figure")}
    near = vector.nearest_each(rows.withColumn("modality", kind), asked, "vec_id", "embedding", max(limits.values()), "l2", None, 5, by="modality").withColumnRenamed("score", "distance")
    return fusion.with_rank(vector.merge_modalities(near.drop("rank"), limits, query="query_id"), "distance", "vec_id", ["query_id"], ascending=True, name="place")


RANKINGS = """
rk AS (SELECT conv_id AS query_id, 'a' AS ranking, turn AS position, length(text) % 7 AS id FROM conversations
  UNION ALL SELECT conv_id, 'b', turn, (turn * 5 + conv_id) % 7 FROM conversations)"""


def rankings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("query_id"), F.lit("a").alias("ranking"), F.col("turn").alias("position"), (F.length("text") % 7).cast("long").alias("id"))
    b = c.select(F.col("conv_id").alias("query_id"), F.lit("b").alias("ranking"), F.col("turn").alias("position"), ((F.col("turn") * 5 + F.col("conv_id")) % 7).alias("id"))
    return a.union(b)


@query("w3_rrf_many", f"""
WITH {RANKINGS}, o AS (SELECT query_id, ranking, id, min(position) AS p FROM rk GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, ranking ORDER BY p, id) AS r FROM o),
s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min((ranking, r)) AS seen FROM r GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM s""")
def w3_rrf_many(spark, sf_dir):
    return fusion.fuse(rankings(spark, sf_dir))


@query("j14_hybrid_merge", f"""
WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(pow(list_distance({VEC}, {FIRST}), 2), 5), vec_id) AS vector_rank FROM embeddings QUALIFY vector_rank <= 40),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS lexical_rank FROM documents QUALIFY lexical_rank <= 60)
SELECT id, vector_rank, lexical_rank, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS score
FROM v FULL OUTER JOIN l USING (id)""")
def j14_hybrid_merge(spark, sf_dir):
    rows, q = _first(spark, sf_dir)
    near = vector.nearest(rows, q, "vec_id", "embedding", 40, None, 5)
    v = fusion.with_rank(near, "distance", "vec_id", ascending=True, name="vector_rank").select(F.col("vec_id").alias("id"), "vector_rank")
    longest = lexical.top(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 60, "doc_id", "n_chars", None)
    lex = fusion.with_rank(longest, "n_chars", "doc_id", name="lexical_rank").select(F.col("doc_id").alias("id"), "lexical_rank")
    return fusion.merge_channels(v, lex).select("id", "vector_rank", "lexical_rank", F.round("rrf", 9).alias("score"))


@query("r12_embedding_rerank", f"""
WITH n AS (SELECT vec_id AS id, {VEC} AS e, row_number() OVER (ORDER BY round(pow(list_distance({VEC}, {FIRST}), 2), 5), vec_id) AS near FROM embeddings QUALIFY near <= 40),
c AS (SELECT id, round(1.0::DOUBLE / (60 + near), 6) AS score, round(list_cosine_similarity(e, {FIRST}), 5) AS cosine FROM n),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS base_rank FROM c),
s AS (SELECT id, base_rank <= 12 AS head, round(CASE WHEN base_rank <= 12 THEN score + 0.35::DOUBLE * cosine ELSE score END, 6) AS rerank_score FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY rerank_score DESC, id) AS place FROM s),
r AS (SELECT id, rerank_score, row_number() OVER (ORDER BY rerank_score DESC, id) AS rank FROM k WHERE NOT head OR place <= 8)
SELECT id, rerank_score, rank FROM r WHERE rank <= 8""")
def r12_embedding_rerank(spark, sf_dir):
    rows, q = _first(spark, sf_dir)
    near = fusion.with_rank(vector.nearest(rows, q, "vec_id", "embedding", 40, None, 5), "distance", "vec_id", ascending=True, name="near")
    c = rows.join(near, "vec_id").join(q).select(F.col("vec_id").alias("id"), F.round(1.0 / (60 + F.col("near")), 6).alias("score"), F.round(vectors.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))
    return fusion.rerank(c, 8, 12)


@query("r14_semantic_lexical_rrf", f"""
WITH c AS (SELECT vec_id AS id, label AS lex, round(list_inner_product({VEC}, {FIRST}), 5) AS sem FROM embeddings QUALIFY row_number() OVER (ORDER BY sem DESC, vec_id) <= 100),
r AS (SELECT id, row_number() OVER (ORDER BY lex DESC, id) AS lr, row_number() OVER (ORDER BY sem DESC, id) AS sr FROM c)
SELECT id, round(1.0::DOUBLE / (60 + lr) + 1.0::DOUBLE / (60 + sr), 9) AS score FROM r""")
def r14_semantic_lexical_rrf(spark, sf_dir):
    rows, q = _first(spark, sf_dir)
    c = rows.join(q).select(F.col("vec_id").alias("id"), F.col("label").alias("lex"), F.round(vectors.dot(F.col("embedding"), F.col("q")), 5).alias("sem"))
    c = lexical.top(c, 100, "id", "sem", None)
    ranked = fusion.with_rank(fusion.with_rank(c, "lex", "id", name="lr"), "sem", "id", name="sr")
    return ranked.select("id", F.round(fusion.rrf_term(F.col("lr")) + fusion.rrf_term(F.col("sr")), 9).alias("score"))


HAS = lambda col, words: "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("r11_lexical_boost", f"""
WITH c AS (SELECT doc_id, 'explain the ' || split_part(text, chr(10), 1) || ' figure' AS q, text || CASE WHEN doc_id % 3 = 0 THEN ' introduction' WHEN doc_id % 3 = 1 THEN ' conclusion' ELSE '' END AS content,
  CASE doc_id % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'text' END AS kind FROM documents),
t AS (SELECT *, {tokens_sql('q', 24)} AS a, {tokens_sql('content', 24)} AS b FROM c)
SELECT doc_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END * 0.012::DOUBLE
  + CASE WHEN {HAS('lower(content)', fixed.EXPLANATORY_CONTENT)} THEN 0.028 ELSE 0 END - CASE WHEN {HAS('lower(content)', fixed.CLOSING_CONTENT)} THEN 0.012 ELSE 0 END
  + CASE WHEN kind = 'figure' THEN 0.018 ELSE 0 END + CASE WHEN kind = 'table' AND {HAS('lower(q)', fixed.TABLE_WORDS)} THEN 0.014 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.004 ELSE 0 END + CASE WHEN doc_id % 10 = 1 THEN 0.002 ELSE 0 END, 6) AS boost FROM t""")
def r11_lexical_boost(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " introduction").when(F.col("doc_id") % 3 == 1, " conclusion").otherwise(""))
    asked = F.concat(F.lit("explain the "), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)), F.lit(" figure"))
    kind = F.when(F.col("doc_id") % 4 == 0, "figure").when(F.col("doc_id") % 4 == 1, "table").otherwise("text")
    channels = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("vector"), F.lit("lexical"))).otherwise(F.array(F.lit("vector")))
    value = fusion.boost(asked, content, content, kind, channels, F.col("doc_id") % 10, F.lit(True), F.lit(False))
    return d.select("doc_id", F.round(value, 6).alias("boost"))


RUN = """
rn AS (SELECT label AS query_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 1009, vec_id) AS rank FROM embeddings),
rel AS (SELECT label AS query_id, vec_id AS id FROM embeddings WHERE vec_id % 5 = 0)"""


def run_and_relevant(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"))
    order = F.row_number().over(evals.W.partitionBy("query_id").orderBy((F.col("id") * 7919) % 1009, "id"))
    return e.withColumn("rank", order), e.where("id % 5 = 0")


METRICS = """
m AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg FROM rn SEMI JOIN rel USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
i AS (SELECT query_id, (SELECT sum(1.0::DOUBLE / log2(x + 1)) FROM range(1, 11) t(x) WHERE x <= least(n, 10)) AS ideal, n FROM m),
e AS (SELECT query_id, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(hits, 0) / greatest(n, 1), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN h USING (query_id))"""


@query("r18_ranking_metrics", f"WITH {RUN}, {METRICS} SELECT * FROM e")
def r18_ranking_metrics(spark, sf_dir):
    return evals.ranking_metrics(*run_and_relevant(spark, sf_dir), 10)


@query("a18_mean_metrics", f"WITH {RUN}, {METRICS} SELECT count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM e")
def a18_mean_metrics(spark, sf_dir):
    return evals.mean_metrics(evals.ranking_metrics(*run_and_relevant(spark, sf_dir), 10))


@query("w24_first_relevant_rank", f"WITH {RUN} SELECT query_id, min(rank) AS first FROM rn SEMI JOIN rel USING (query_id, id) GROUP BY query_id")
def w24_first_relevant_rank(spark, sf_dir):
    return evals.first_relevant(*run_and_relevant(spark, sf_dir))


@query("a19_nearest_rank_percentiles", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[greatest(CAST(ceil(0.5 * len(v)) AS INT), 1)] AS p50, v[CAST(ceil(0.95 * len(v)) AS INT)] AS p95, v[CAST(ceil(0.99 * len(v)) AS INT)] AS p99 FROM s""")
def a19_nearest_rank_percentiles(spark, sf_dir):
    return evals.percentiles_nearest(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("a20_rounded_index_percentiles", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[1 + CAST(round_even((len(v) - 1) * 0.5::DOUBLE, 0) AS INT)] AS p50, v[1 + CAST(round_even((len(v) - 1) * 0.95::DOUBLE, 0) AS INT)] AS p95, round(list_median(v), 6) AS median FROM s""")
def a20_rounded_index_percentiles(spark, sf_dir):
    return evals.percentiles_rounded(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("d26_distribution", """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS n, v[1] AS least, v[1 + len(v) // 2] AS upper_median, round(list_avg(v), 6) AS mean, v[len(v)] AS most FROM s""")
def d26_distribution(spark, sf_dir):
    return evals.distribution(table(spark, sf_dir, "events"), "event_type", "value")


@query("r20_token_f1", f"""
WITH p AS (SELECT item_id, {WORDS.format('text')} AS a, {WORDS.format("substr(text, 30) || ' the the'")} AS b FROM benchmark),
ta AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(a) AS t FROM p) GROUP BY ALL), tb AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(b) AS t FROM p) GROUP BY ALL),
c AS (SELECT item_id, sum(least(ta.n, tb.n)) AS shared FROM ta JOIN tb USING (item_id, t) GROUP BY item_id)
SELECT item_id, round(coalesce(shared, 0) / len(b), 6) AS recall, round(coalesce(2.0::DOUBLE * shared / (len(a) + len(b)), 0), 6) AS f1 FROM p LEFT JOIN c USING (item_id)""")
def r20_token_f1(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("prediction"), F.concat(F.substring("text", F.lit(30), F.length("text")), F.lit(" the the")).alias("reference"))
    return evals.token_f1(pairs, "item_id")


@query("r21_rouge_l")
def r21_rouge_l(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("prediction"), F.concat(F.substring("text", F.lit(30), F.length("text")), F.lit(" the the")).alias("reference"))
    return evals.rouge_l(pairs, "item_id")


@query("r22_max_over_references", "SELECT conv_id, max(length(text)) AS best FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def r22_max_over_references(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("score", F.length("text"))
    return evals.best_reference(c, "conv_id", "score").withColumnRenamed("score", "best")


@query("w15_stratified_sample", "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) <= 7")
def w15_stratified_sample(spark, sf_dir):
    return evals.stratified(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 7)


@query("w14_balanced_sample", """
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS turn FROM customer)
SELECT c_mktsegment, c_custkey FROM r ORDER BY turn, c_mktsegment LIMIT 23""")
def w14_balanced_sample(spark, sf_dir):
    return evals.balanced(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 23)


@query("j25_label_join", "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY quality, toxic")
def j25_label_join(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("a24_candidate_recall", f"WITH {RUN} SELECT round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM rel JOIN rn USING (query_id, id)")
def a24_candidate_recall(spark, sf_dir):
    return evals.candidate_recall(*run_and_relevant(spark, sf_dir), 20)


def word_overlap():
    """A stand-in for a cross-encoder: the share of the question's distinct words that the text has, squashed."""
    import numpy as np

    def score(pairs):
        sets = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return 1 / (1 + np.exp(-np.array([4 * len(q & t) / max(1, len(q)) - 2 for q, t in sets])))

    return score


@query("r13_cross_encoder", f"""
WITH b AS ({bm25_sql("SELECT doc_id, text FROM documents", {"text": 1.0}, k=30)}), h AS (SELECT query_id, b.doc_id, score, rank AS place, list_distinct(list_filter(string_split_regex(lower(q.text), '\\s+'), lambda w: w <> '')) AS qw,
  list_slice(list_filter(string_split_regex(lower(d.text), '\\s+'), lambda w: w <> ''), 1, 512 - least(len(list_filter(string_split_regex(q.text, '\\s+'), lambda w: w <> '')), greatest(256, 512 - len(list_filter(string_split_regex(d.text, '\\s+'), lambda w: w <> ''))))) AS dw
  FROM b JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = b.doc_id),
s AS (SELECT query_id, doc_id, place, place <= 20 AS head, round(CASE WHEN place <= 20 THEN 1 / (1 + exp(-(4 * len(list_intersect(qw, dw)) / greatest(1, len(qw)) - 2))) ELSE score END, 6) AS rerank_score FROM h),
w AS (SELECT * FROM s QUALIFY NOT head OR row_number() OVER (PARTITION BY query_id, head ORDER BY rerank_score DESC, place) <= 8)
SELECT query_id, doc_id, rerank_score, CASE WHEN head THEN 'cross_encoder' ELSE 'first_stage_tail' END AS backend, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, head DESC, place) AS rank FROM w QUALIFY rank <= 8""")
def r13_cross_encoder(spark, sf_dir):
    """The 30 documents with the best BM25 for each benchmark question, the first 20 of them reordered."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = lexical.top(lexical.bm25(docs, bench_queries(spark, sf_dir), "doc_id", {"text": 1.0}), 30, "doc_id").withColumnRenamed("rank", "place")
    told = lexical.beside(found, docs.withColumnRenamed("text", "content"), "doc_id", 30 * asked.count()).join(asked, "query_id")
    return fusion.cross_rerank(told, "word_overlap", word_overlap, 8, key="doc_id")
