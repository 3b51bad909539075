"""Queries of captions, inflected mentions and claims with qualifiers: joins that match by more than equal keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import captions, claims, entities, figures, mutations
from ..sources import files
from ..sources.tables import table
from .registry import query

#: Tables and page texts: suspects, owned numbers and printed captions fall on the pages in all combinations.
PAGES = """
tb AS (SELECT p_partkey AS table_id, p_partkey % 50 AS document_id, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 7 END AS page_number,
  CASE p_partkey % 4 WHEN 0 THEN 'Figure ' || (p_partkey % 9) || '. layout' WHEN 1 THEN 'Table ' || (p_partkey % 5) || ': rows' WHEN 2 THEN ' FIG. No. iv overview' END AS caption,
  CASE p_size % 3 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:---|' || chr(10) || '| ' || p_size || ' | x |' WHEN 1 THEN '| a |' || chr(10) || '|---|' ELSE 'text' END AS markdown FROM part),
ch AS (SELECT o_orderkey % 50 AS document_id, o_orderkey % 7 AS page_number, o_orderkey AS chunk_index,
  CASE WHEN o_custkey % 40 < 2 THEN 'Some text.' || chr(10) || '  Table No. ' || (o_custkey % 6) || ':  of   ' || o_orderpriority || chr(10) || 'more' ELSE 'See Table ' || (o_custkey % 6) || ': not at the start' END AS content FROM orders)"""


def pages(spark, sf_dir):
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    k = F.col("p_partkey")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    caption = F.when(k % 4 == 0, text("Figure ", k % 9, ". layout")).when(k % 4 == 1, text("Table ", k % 5, ": rows")).when(k % 4 == 2, " FIG. No. iv overview")
    markdown = F.when(F.col("p_size") % 3 == 0, text("| a | b |\n|---|:---|\n| ", F.col("p_size"), " | x |")).when(F.col("p_size") % 3 == 1, "| a |\n|---|").otherwise("text")
    tables = p.select(k.alias("table_id"), (k % 50).alias("document_id"), F.when(k % 11 > 0, k % 7).alias("page_number"), caption.alias("caption"), markdown.alias("markdown"))
    n = F.col("o_custkey") % 6
    printed = F.when(F.col("o_custkey") % 40 < 2, F.concat(text("Some text.\n  Table No. ", n, ":  of   "), "o_orderpriority", F.lit("\nmore"))).otherwise(text("See Table ", n, ": not at the start"))
    return tables, o.select((F.col("o_orderkey") % 50).alias("document_id"), (F.col("o_orderkey") % 7).alias("page_number"), F.col("o_orderkey").alias("chunk_index"), printed.alias("content"))


@query("j24_reconciled_captions", f"""
WITH {PAGES}, own AS (SELECT DISTINCT document_id, page_number, CAST(regexp_extract(caption, '(?i)^\\s*table\\s*(\\d+)', 1) AS BIGINT) AS n FROM tb WHERE page_number IS NOT NULL AND regexp_matches(caption, '(?i)^\\s*table\\s*\\d+\\s*[:.]')),
su AS (SELECT document_id, page_number, min(table_id) AS table_id FROM tb WHERE page_number IS NOT NULL AND regexp_matches(caption, '(?i)^\\s*(fig(ure)?\\.?)\\s*(no\\.?\\s*)?(\\d+|[ivxlcdm]+)([^a-z0-9_]|$)') AND starts_with(markdown, '| a | b |') GROUP BY ALL HAVING count(*) = 1),
pr AS (SELECT document_id, page_number, CAST(regexp_extract(content, '(?i)\\n\\s*table no\\. (\\d+):', 1) AS BIGINT) AS n, regexp_replace(trim(regexp_extract(content, '(?i)\\n\\s*(table no\\. \\d+:[^\\n]*)', 1)), '\\s+', ' ', 'g') AS label, chunk_index FROM ch WHERE regexp_matches(content, '(?i)\\n\\s*table no\\. \\d+:')),
be AS (SELECT document_id, page_number, n, arg_max(label, (length(label), -chunk_index)) AS label FROM pr GROUP BY ALL),
fr AS (SELECT document_id, page_number, min(n) AS n, min(label) AS label FROM be ANTI JOIN own USING (document_id, page_number, n) GROUP BY ALL HAVING count(*) = 1),
mended AS (SELECT table_id, n, label FROM su JOIN fr USING (document_id, page_number))
SELECT table_id, coalesce(label, caption) AS caption, n AS reconciled_number, CASE WHEN n IS NOT NULL THEN caption END AS original_caption FROM tb LEFT JOIN mended USING (table_id)""")
def j24_reconciled_captions(spark, sf_dir):
    return captions.reconcile(*pages(spark, sf_dir)).select("table_id", "caption", "reconciled_number", "original_caption")


@query("j26_figure_texts", """
WITH f AS (SELECT p_partkey AS figure_id, p_partkey % 20 AS document_id, CASE WHEN p_partkey % 9 > 0 THEN p_partkey % 31 END AS n FROM part),
c AS (SELECT o_orderkey % 20 AS document_id, o_orderkey AS nth, (['Figure ', 'Fig. ', 'FIG ', 'Fig', 'see Figure '])[1 + o_custkey % 5] || (o_custkey % 170) || ' of ' || o_orderpriority AS content FROM orders WHERE o_custkey % 3 = 0),
m AS (SELECT figure_id, arg_min(content, (CASE WHEN content ILIKE 'Figure ' || n || '%' THEN 0 WHEN content ILIKE 'Fig. ' || n || '%' THEN 1 ELSE 2 END, nth)) AS content
  FROM f JOIN c USING (document_id) WHERE content ILIKE 'Figure ' || n || '%' OR content ILIKE 'Fig. ' || n || '%' OR content ILIKE 'Fig ' || n || '%' GROUP BY figure_id)
SELECT figure_id, content FROM f LEFT JOIN m USING (figure_id)""")
def j26_figure_texts(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col("o_custkey")
    figures = table(spark, sf_dir, "part").select(k.alias("figure_id"), (k % 20).alias("document_id"), F.when(k % 9 > 0, k % 31).alias("figure_number"))
    start = F.element_at(F.array(*map(F.lit, ["Figure ", "Fig. ", "FIG ", "Fig", "see Figure "])), (1 + c % 5).cast("int"))
    chunks = table(spark, sf_dir, "orders").where(c % 3 == 0).select((F.col("o_orderkey") % 20).alias("document_id"), F.col("o_orderkey").alias("chunk_index"), F.concat(start, (c % 170).cast("string"), F.lit(" of "), "o_orderpriority").alias("content"))
    return captions.figure_texts(figures, chunks).select("figure_id", "content")


@query("j16_inflected_mentions", """
WITH n AS (SELECT p_partkey AS document_id, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part),
a AS (SELECT array_to_string(w, ' ') AS alias, w, list_sort(list(DISTINCT document_id)) AS owners FROM n GROUP BY w),
q AS (SELECT DISTINCT regexp_extract_all(lower('what is ' || p_name || (['', 's', 'like ours', ' s'])[1 + p_partkey % 4] || ' and ' || p_name || 'x'), '[a-z0-9]+') AS t FROM part),
h AS (SELECT t, alias, min(i) AS i FROM q, a, range(1, 20) r(i) WHERE i + len(w) - 1 <= len(t) AND t[i:i + len(w) - 2] = w[1:len(w) - 1]
  AND (t[i + len(w) - 1] = w[len(w)] OR starts_with(t[i + len(w) - 1], w[len(w)]) AND length(w[len(w)]) >= CASE WHEN len(w) = 1 THEN 12 ELSE 4 END) GROUP BY ALL)
SELECT p_partkey AS query_id, h.alias, i - 1 AS start, i - 1 + len(w) AS "end", len(owners) AS n_owners
FROM part JOIN h ON t = regexp_extract_all(lower('what is ' || p_name || (['', 's', 'like ours', ' s'])[1 + p_partkey % 4] || ' and ' || p_name || 'x'), '[a-z0-9]+') JOIN a USING (alias)""")
def j16_inflected_mentions(spark, sf_dir):
    """File names in questions where their last word goes on."""
    p = table(spark, sf_dir, "part")
    end = F.element_at(F.array(*map(F.lit, ["", "s", "like ours", " s"])), (1 + F.col("p_partkey") % 4).cast("int"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what is "), "p_name", end, F.lit(" and "), "p_name", F.lit("x")).alias("text"))
    none = F.array().cast("array<string>")
    catalog = p.select(F.col("p_partkey").alias("document_id"), F.concat(F.translate("p_name", " ", "_"), F.lit(".pdf")).alias("filename"), F.lit("").alias("title"), none.alias("keywords"))
    found = entities.mentions(asked, entities.aliases(catalog).where("source = 'filename'"), counts=True)
    return found.select("query_id", "alias", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("n_owners").cast("long").alias("n_owners"))


def _bits(n, names):
    return "list_filter([" + ", ".join(f"CASE WHEN ({n}) // {1 << i} % 2 = 1 THEN '{x}' END" for i, x in enumerate(names)) + "], lambda x: x IS NOT NULL)"


QUALIFIERS, SUBJECTS = ["clean", "noisy", "valence", "zero-shot"], ["paper", "__proposed__", "other", "__baseline__"]


@query("j19_qualified_claims", f"""
WITH c AS (SELECT p_partkey AS claim_id, (['f1', 'acc', 'wer'])[1 + p_partkey % 3] AS metric, p_size::DOUBLE AS value, p_partkey % 2 = 0 AS percent, {_bits('p_partkey // 7', QUALIFIERS)} AS q, {_bits('CASE WHEN p_partkey % 5 < 3 THEN p_partkey // 3 % 8 ELSE 0 END', SUBJECTS)} AS s FROM part),
e AS (SELECT DISTINCT (['f1', 'acc', 'wer'])[1 + o_orderkey % 3] AS metric, CASE WHEN o_orderkey % 4 < 3 THEN o_custkey % 50 ELSE (o_custkey % 50) / 100.0::DOUBLE END AS value, o_orderkey % 2 = 0 AS percent, {_bits('o_custkey // 11', QUALIFIERS)} AS q,
  {_bits('o_orderkey // 5', SUBJECTS)} AS s, CASE WHEN o_orderkey % 3 > 0 THEN ['paper'] ELSE [] END AS d FROM orders WHERE o_orderkey % 9 < 4),
h AS (SELECT DISTINCT claim_id FROM c JOIN e USING (metric) WHERE (abs(c.value - e.value) < 1e-9 OR c.percent <> e.percent AND (abs(c.value - 100 * e.value) < 1e-9 OR abs(e.value - 100 * c.value) < 1e-9))
  AND (len(c.q) = 0 OR len(e.q) = 0 OR list_has_all(e.q, c.q))
  AND CASE WHEN list_contains(c.s, '__proposed__') THEN list_has_all(e.s, list_filter(c.s, lambda x: x <> '__proposed__' AND NOT list_contains(d, x))) AND (list_contains(e.s, '__proposed__') OR list_has_any(e.s, d))
    WHEN len(c.s) > 0 THEN CASE WHEN len(list_filter(c.s, lambda x: NOT list_contains(d, x))) > 0 THEN list_has_all(e.s, list_filter(c.s, lambda x: NOT list_contains(d, x))) ELSE list_has_any(e.s, d) OR list_contains(e.s, '__proposed__') END
    ELSE NOT list_contains(e.s, '__baseline__') AND (list_contains(e.s, '__proposed__') OR CASE WHEN len(d) > 0 THEN list_has_any(e.s, d) ELSE len(e.s) = 0 END) END)
SELECT claim_id, claim_id IN (SELECT claim_id FROM h) AS supported FROM c""")
def j19_qualified_claims(spark, sf_dir):
    bits = lambda n, names: F.array_compact(F.array(*[F.when(F.floor(n / (1 << i)) % 2 == 1, x) for i, x in enumerate(names)]))
    metric = lambda n: F.element_at(F.array(*map(F.lit, ["f1", "acc", "wer"])), (1 + n % 3).cast("int"))
    k, o, u = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    said = table(spark, sf_dir, "part").select(k.alias("claim_id"), metric(k).alias("metric"), F.col("p_size").cast("decimal(38,8)").alias("value"), (k % 2 == 0).alias("percent"), bits(F.floor(k / 7), QUALIFIERS).alias("qualifiers"), bits(F.when(k % 5 < 3, F.floor(k / 3) % 8).otherwise(0), SUBJECTS).alias("subjects"))
    value = F.when(o % 4 < 3, (u % 50).cast("decimal(38,8)")).otherwise(((u % 50) / 100).cast("decimal(38,8)"))
    proof = table(spark, sf_dir, "orders").where(o % 9 < 4).select(metric(o).alias("metric"), value.alias("value"), (o % 2 == 0).alias("percent"), bits(F.floor(u / 11), QUALIFIERS).alias("qualifiers"), bits(F.floor(o / 5), SUBJECTS).alias("subjects"), F.when(o % 3 > 0, F.array(F.lit("paper"))).otherwise(F.array().cast("array<string>")).alias("identity"))
    return claims.supported_by(said, proof, ["claim_id"]).select("claim_id", "supported")


@query("h30_catalog_aliases")
def h30_catalog_aliases(spark, sf_dir):
    """Names of parts as documents: file names of brand, type and name, with keywords that their names back or don't."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lit("KX"), (F.col("p_partkey") % 97).cast("string"))
    stem = F.concat_ws("_", code, F.lit("based-fusion of the"), F.translate("p_name", " ", "-"), F.lower("p_type"))
    catalog = p.select(F.col("p_partkey").alias("document_id"), F.concat(stem, F.lit(".pdf")).alias("filename"), F.col("p_brand").alias("title"), F.col("p_name").alias("title_guess"), F.array(code, F.lit("dataset"), F.concat(code, F.lit("-Fusion")), F.lit("unrelated words")).alias("keywords"))
    return entities.catalog_aliases(catalog)


_SEARCHED = [(a, p) for a, p in zip(text.ACCENTED, text.PLAIN, strict=True) if a not in "đøł"]


@query("h29_search_words", f"SELECT doc_id, md5(array_to_string(regexp_extract_all(translate(replace(lower(text), 'ß', 'ss'), '{''.join(a for a, _ in _SEARCHED)}', '{''.join(p for _, p in _SEARCHED)}'), '[a-z0-9]+'), ' ')) AS words FROM documents")
def h29_search_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(entities.search_words(F.col("text")), " ")).alias("words"))


#: Tables of suppliers in three layouts, by nation.
@query("h40_grid_claims", """
WITH s AS (SELECT s_nationkey AS doc_id, s_name, s_suppkey, round(s_acctbal, 2) AS v FROM supplier),
a AS (SELECT doc_id, 'accuracy' AS metric, v AS value, true AS percent, s_name AS subject, '' AS qualifiers FROM s WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'ccc', (s_suppkey % 90 + 10) / 100.0::DOUBLE, false, s_name, 'valence' FROM s WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, CASE s_suppkey % 2 WHEN 0 THEN 'wer' ELSE 'f1' END, v, s_suppkey % 2 = 0, s_name, '' FROM s WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'uar', v, false, s_name, 'part-' || (['a', 'b'])[1 + s_suppkey % 2] || ',zero-shot' FROM s WHERE doc_id % 3 = 2)
SELECT * FROM a WHERE NOT (value = floor(value) AND value BETWEEN 1900 AND 2100 AND NOT (percent AND metric = 'wer'))""")
def h40_grid_claims(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_nationkey") % 3
    number, odd = F.format_string("%.2f", F.round("s_acctbal", 2)), (F.col("s_suppkey") % 2).cast("string")
    part = F.translate(odd, "01", "ab")
    line = (
        F.when(k == 0, F.concat(F.lit("| "), "s_name", F.lit(" | "), number, F.lit(" | ."), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit(" |")))
        .when(k == 1, F.concat(F.lit("| "), "s_name", F.when(odd == "0", " | Word error rate | ").otherwise(" | Macro-F1 | "), number, F.when(odd == "0", "% |").otherwise(" |")))
        .otherwise(F.concat(F.lit("| Part "), part, F.lit(" | Part "), part, F.lit(" |\n| "), "s_name", F.lit(" | "), number, F.lit(" |")))
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("x")))), lambda r: r["x"]), "\n")
    grids = s.groupBy(F.col("s_nationkey").alias("doc_id")).agg(body.alias("body")).withColumn("markdown", F.concat(F.when(F.col("doc_id") % 3 == 0, "| Model | Acc (%) | CCC-V |\n|---|---|---|\n").when(F.col("doc_id") % 3 == 1, "| Name | Metric | Result |\n|---|---|---|\n").otherwise("| UAR | Zero shot |\n|---|---|\n"), "body"))
    return claims.grid_claims(grids, "doc_id").select("doc_id", "metric", F.col("value").cast("double").alias("value"), "percent", "subject", F.array_join("qualifiers", ",").alias("qualifiers"))


@query("h48_quotes", r"""
WITH q AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN translate(substr(text, 11, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 1 THEN replace(substr(text, 3, 80), ' ', '  -  ') WHEN 2 THEN substr(text, 5, 12) || '!' ELSE substr(text, 7, 30) || 'zzqx' END AS quote FROM documents),
f AS (SELECT doc_id, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS b, regexp_replace(lower(quote), '[^\p{L}\p{N}]+', '', 'g') AS x, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS y FROM q)
SELECT doc_id, contains(b, a) OR length(x) >= 24 AND contains(y, x) AS found FROM f""")
def h48_quotes(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    part = lambda a, n: F.substring("text", a, n)
    quote = F.when(k == 0, F.translate(part(11, 60), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(k == 1, F.replace(part(3, 80), F.lit(" "), F.lit("  -  "))).when(k == 2, F.concat(part(5, 12), F.lit("!"))).otherwise(F.concat(part(7, 30), F.lit("zzqx")))
    return d.select("doc_id", claims.quoted(quote, F.col("text")).alias("found"))


@query("d13_supported_lines", """
WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, split(text, chr(10)) AS s FROM documents)), b AS (SELECT doc_id, trim(CASE i % 2 WHEN 0 THEN substr(line, 1, 25) ELSE line || ' and more' END) AS c FROM l WHERE (doc_id + i) % 5 = 0 AND trim(line) <> '')
SELECT doc_id, i, md5(line) AS line FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = l.doc_id AND trim(line) <> '' AND (starts_with(trim(line), c) OR starts_with(c, trim(line))))""")
def d13_supported_lines(spark, sf_dir):
    """Lines of documents without those that an unsupported claim is a prefix of, or that are one of it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    said = F.when(F.col("i") % 2 == 0, F.substring("line", 1, 25)).otherwise(F.concat("line", F.lit(" and more")))
    bad = lines.where(((F.col("doc_id") + F.col("i")) % 5 == 0) & (F.trim("line") != "")).select("doc_id", said.alias("sentence"))
    return claims.without_unsupported(lines, bad, "doc_id").select("doc_id", F.col("i").cast("long").alias("i"), F.md5("line").alias("line"))


@query("d14_accepted_answers", "SELECT user_id, bool_and(value >= 0) AND len(list_filter(['view', 'click'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) = 0 AS accepted FROM events GROUP BY user_id")
def d14_accepted_answers(spark, sf_dir):
    """Users as answers: the kinds of their events were checked, views and clicks were asked for."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("checked_metrics"), F.bool_and(F.col("value") >= 0).alias("valid")).withColumn("requested_metrics", F.array(F.lit("view"), F.lit("click")))
    return per.select("user_id", claims.accepted(per).alias("accepted"))


@query("s19_replaced_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def s19_replaced_rows(spark, sf_dir):
    """Ids of the new rows are deleted before they are added; old rows of other ids stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return mutations.replace(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


_FALLBACKS = ["Page 3 visual fallback", "Figure extracted from page 4", "Figure 2. A plot", ""]


@query("f8_low_signal_figures", f"WITH f AS (SELECT p_partkey, ({_FALLBACKS!r})[1 + p_partkey % 4] AS caption, CASE p_size % 5 WHEN 0 THEN ' FIGURE extracted from page 1' WHEN 1 THEN 'a Visual Fallback of it' ELSE p_name END AS content FROM part) SELECT p_partkey, caption, contains(lower(caption), 'visual fallback') OR contains(lower(content), 'visual fallback') OR starts_with(lower(caption), 'figure extracted from page') OR starts_with(trim(lower(content)), 'figure extracted from page') AS low FROM f")
def f8_low_signal_figures(spark, sf_dir):
    caption = F.element_at(F.array(*map(F.lit, _FALLBACKS)), (1 + F.col("p_partkey") % 4).cast("int"))
    content = F.when(F.col("p_size") % 5 == 0, " FIGURE extracted from page 1").when(F.col("p_size") % 5 == 1, "a Visual Fallback of it").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", caption.alias("caption"), figures.low_signal(caption, content).alias("low"))


_LABELS = ["Figure 3. x", "fig. no. #4", "FIGURES of", "hình IV", "Table 2", "figurative", " Fig:12b", "Fig"]


@query("f19_figure_labels", f"SELECT p_partkey, regexp_matches(label, '(?i)^\\s*(?:fig(?:ure)?\\.?|hình|hinh)\\s*(?:no\\.?\\s*)?[#:]?\\s*(?:\\d+|[ivxlcdm]+)(?:[^\\p{{L}}\\p{{N}}_]|$)') AS is_figure FROM (SELECT p_partkey, ({_LABELS!r})[1 + p_partkey % 8] || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END AS label FROM part)")
def f19_figure_labels(spark, sf_dir):
    label = F.concat(F.element_at(F.array(*map(F.lit, _LABELS)), (1 + F.col("p_partkey") % 8).cast("int")), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", captions.labels_figure(label).alias("is_figure"))


@query("f22_isolated_paths", """
WITH p AS (SELECT page_id, (['/data/indexes/', '/data/indexes/../', '/data/./indexes//a/../', 'data/indexes/', '/data/indexes/a/../../', '/data/indexes'])[1 + page_id % 6] || coalesce(regexp_extract(url, '://[^/]*/?([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN regexp_replace(path, '/+$', '') <> '/data/indexes' WHEN 2 THEN regexp_replace(path, '/+$', '') <> '/data/./indexes//a/..' ELSE false END AS ok FROM p""")
def f22_isolated_paths(spark, sf_dir):
    """Paths of pages after prefixes that stay in a folder and that leave it."""
    start = F.element_at(F.array(*map(F.lit, ["/data/indexes/", "/data/indexes/../", "/data/./indexes//a/../", "data/indexes/", "/data/indexes/a/../../", "/data/indexes"])), (1 + F.col("page_id") % 6).cast("int"))
    path = F.concat(start, F.coalesce(F.regexp_extract("url", "://[^/]*/?([^?#]*)", 1), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", files.isolated(path, "/data/indexes").alias("ok"))
