"""Queries of figure captions, inventories and referents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import figures
from ..sources.tables import table
from .registry import query


@query("h26_caption_titles", "SELECT p_partkey, 'Figure ' || p_size || ': the parts named ' || p_name || ' of the brand.' AS title FROM part")
def h26_caption_titles(spark, sf_dir):
    n = F.col("p_size").cast("string")
    said = F.concat(F.lit("Figure "), n, F.lit(": short Figure "), n, F.lit(": the parts named "), "p_name", F.lit(" of the\nbra-\nnd. More is said about them."))
    return table(spark, sf_dir, "part").select("p_partkey", figures.caption_title(said).alias("title"))


@query("h46_figure_relevance", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -200 ELSE CASE WHEN p_size = 3 THEN 80 ELSE 0 END + CASE p_size % 3 WHEN 0 THEN 70 WHEN 1 THEN 50 ELSE -15 END + 20 * (CASE WHEN contains(lower(p_name), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_name), 'widget') THEN 1 ELSE 0 END) END AS score FROM part")
def h46_figure_relevance(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("architecture"), F.lit("diagram"), F.lit("chart")), (F.col("p_size") % 3 + 1).cast("int"))
    caption = F.when(F.col("p_size") % 7 == 0, F.lit("Figure extracted from page 1")).otherwise(F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(": "), "p_name"))
    score = figures.relevance(F.lit(0), caption, F.lit(""), kind, F.lit(3), F.lit("the pipeline for red widget"))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@query("d5_plural_referents", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [c_custkey, c_custkey + 1] WHEN 1 THEN [c_custkey + 7, c_custkey] ELSE [] END AS documents FROM customer")
def d5_plural_referents(spark, sf_dir):
    k, r = F.col("c_custkey"), F.col("c_custkey") % 4
    durable = F.when(r == 0, F.array(k, k + 1, k)).otherwise(F.array(k))
    found = figures.plural_referents(durable, F.when(r != 2, F.array(k + 7)), F.array(k), r != 3)
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("documents"))


@query("d11_table_inventory", """
WITH f AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT l_orderkey AS document_id, l_orderkey * 10 + l_linenumber AS table_id, l_linenumber AS i FROM lineitem JOIN f ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 2) QUALIFY row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber) = 1),
s AS (SELECT o_orderkey AS document_id, NULL AS table_id, o_orderkey AS a FROM orders WHERE o_orderkey % 3 = 0)
SELECT document_id, table_id, row_number() OVER (ORDER BY part, a, i, document_id) AS place FROM (SELECT document_id, table_id, 0 AS part, document_id AS a, i FROM t UNION ALL SELECT document_id, table_id, 1, a, 0 FROM s)""")
def d11_table_inventory(spark, sf_dir):
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    focus = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("place"))
    tables = i.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("table_id"), F.col("l_linenumber").alias("table_number"), F.col("l_linenumber").alias("table_index"))
    mixed = o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 10 + 1).alias("table_id"), F.col("o_orderkey").alias("rank"))
    return figures.table_inventory(mixed, tables, focus, [1, 2])


@query("d16_graph_modes", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'global' WHEN o_orderstatus = 'F' THEN 'hybrid' WHEN o_orderstatus = 'O' THEN 'local' ELSE 'mix' END AS mode FROM orders")
def d16_graph_modes(spark, sf_dir):
    intent = F.when(F.col("o_orderstatus") == "F", "compare").when(F.col("o_orderstatus") == "O", "define").otherwise("other")
    mode = F.when(F.col("o_orderkey") % 5 == 0, "GLOBAL").otherwise("unknown")
    return table(spark, sf_dir, "orders").select("o_orderkey", figures.graph_mode(intent, mode).alias("mode"))
