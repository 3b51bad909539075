"""Figure captions and relevance, focused table inventories, plural referents, graph query modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranking import global_rank

from ..functions.more import figure_label

_start = r"(?i)^(?:fig\.?|figure|hình)\s*(\d+)\s*[.:–-]"

# Words of a query that ask for an architecture or for numbers, and words that don't count as shared.
ARCHITECTURE_WORDS = ["architecture", "architectural", "kiến trúc", "cấu trúc", "pipeline", "framework", "model overview", "overall model", "sơ đồ tổng thể"]
QUANTITY_WORDS = ["benchmark", "ablation", "confusion matrix", "kết quả", "so sánh", "accuracy", " acc", " f1", " ccc", "uar"]
UNSHARED_WORDS = ["của", "cho", "với", "the", "and", "for", "về", "các", "một", "này", "đó", "làm", "sao", "gì", "như", "thế", "tôi", "mình", "bài", "paper", "pdf"]
# What the number asked for, kinds for an architecture, kinds for numbers, a shared word and a fallback crop add to a figure's score.
RELEVANCE = {"number": 80, "architecture": 70, "diagram": 50, "other_kind": -15, "quantity": 35, "word": 20, "fallback": -200}
# Modes of a graph query, and those that an intent asks for.
GRAPH_MODES = ["local", "global", "hybrid", "naive", "mix"]
HYBRID_INTENTS, LOCAL_INTENTS = ["compare", "infer_structure"], ["direct_answer", "define", "simplify", "example"]


def plain_caption(text: Column) -> Column:
    """One line, with words that a line end cut joined again."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"-\s+(?=[a-z])", ""), r"\s+", " "))


def caption_title(text: Column, most: int = 180) -> Column:
    """The longest of repeated captions of one figure, to the end of its first sentence."""
    flat = plain_caption(text)
    number = F.regexp_extract(flat, _start, 1)
    mark = F.concat(F.lit(r"(?i)(?=(?:fig\.?|figure|hình)\s*"), number, F.lit(r"\s*[.:–-])"))
    parts = F.filter(F.transform(F.split(flat, mark), F.trim), lambda p: p != "")
    longest = F.element_at(F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), 1)["p"]
    best = F.when(number != "", longest).otherwise(flat)
    stop = F.instr(best, ". ")
    return F.when((number != "") & (stop > 21) & (stop <= most), F.substring(best, F.lit(1), stop)).when(F.length(best) <= most, best).otherwise(F.concat(F.rtrim(F.substring(best, 1, most - 1)), F.lit("…")))


def truncated(caption: Column) -> Column:
    """Whether a caption looks cut off: empty, ending in a dash, or long and ending in a short word."""
    flat = plain_caption(F.coalesce(caption, F.lit("")))
    return (flat == "") | flat.rlike(r"[-–]$") | ((F.length(flat) >= 24) & flat.rlike(r" \p{Ll}{1,3}$"))


def best_caption(caption: Column, summary_title: Column, from_text: Column) -> Column:
    """A whole labelled caption; else the longest of what there is; else `Figure`."""
    sound = figure_label(plain_caption(caption))["number"].isNotNull() & ~truncated(caption)
    found = F.array_compact(F.array(*[F.nullif(caption_title(c), F.lit("")) for c in (caption, summary_title, from_text)]))
    ordered = F.array_sort(F.transform(found, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("c"))))
    return F.when(sound, caption_title(caption)).otherwise(F.coalesce(F.try_element_at(ordered, F.lit(1))["c"], F.lit("Figure")))


def low_signal(caption: Column, content: Column) -> Column:
    """Whether a figure is a page's fallback rather than a picture of something, by its caption or content."""
    own = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    cap, body = own(caption), own(content)
    return cap.contains("visual fallback") | body.contains("visual fallback") | cap.startswith("figure extracted from page") | body.startswith("figure extracted from page")


def relevance(score: Column, caption: Column, content: Column, kind: Column, wanted: Column, query: Column) -> Column:
    """A figure's score for a query: fallback crops far below, 80 for the number asked for, by kind for what is asked, 20 for each shared word."""
    low, body = F.lower(caption), F.lower(F.concat_ws("\n", caption, content))
    fallback = low.startswith("figure extracted from page") | F.lower(content).startswith("figure extracted from page") | body.contains("visual fallback")
    asked = F.lower(query)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: asked.contains(w))
    numbered = F.when(figure_label(caption)["number"] == wanted, RELEVANCE["number"]).otherwise(0)
    shape = F.when(any_of(ARCHITECTURE_WORDS), F.when(kind == "architecture", RELEVANCE["architecture"]).when(kind == "diagram", RELEVANCE["diagram"]).when(kind.isin("chart", "plot", "photo"), RELEVANCE["other_kind"]).otherwise(0)).otherwise(0)
    counts = F.when(any_of(QUANTITY_WORDS) & kind.isin("chart", "plot", "table"), RELEVANCE["quantity"]).otherwise(0)
    words = F.filter(F.regexp_extract_all(asked, F.lit("[a-z0-9à-ỹ]{3,}"), F.lit(0)), lambda w: ~w.isin(UNSHARED_WORDS))
    shared = F.size(F.filter(words, lambda w: body.contains(w))) * RELEVANCE["word"]
    return score + F.when(F.coalesce(fallback, F.lit(False)), RELEVANCE["fallback"]).otherwise(F.coalesce(numbered, F.lit(0)) + shape + counts + shared)


def table_inventory(sources: DataFrame, tables: DataFrame, focus: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """The tables of the focused documents first, each once, then the other sources, with their place.

    With requested numbers only those tables come, and no other table stays among the sources. A table that is a source keeps its rank.
    focus has document_id and place; tables: document_id, table_id, table_number, table_index.
    """
    wanted = tables.join(focus.groupBy("document_id").agg(F.min("place").alias("place")), "document_id")
    if numbers:
        wanted = wanted.where(F.col("table_number").isin(numbers))
    once = F.row_number().over(W.partitionBy("table_id").orderBy("place", "table_index"))
    wanted = wanted.withColumn("_n", once).where("_n = 1")
    first = wanted.select("document_id", "table_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("a"), F.col("table_index").cast("long").alias("b"))
    rest = sources.join(wanted.select("table_id"), "table_id", "left_anti")
    rest = rest.where(F.col("table_id").isNull()) if numbers else rest
    rest = rest.select("document_id", "table_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    many = first.agg(F.count("*").alias("_first"))  # one row
    after = global_rank(rest, "a", ["b", "document_id"]).join(F.broadcast(many)).withColumn("place", (F.col("place") + F.col("_first")).cast("int")).drop("_first")
    return global_rank(first, "a", ["b", "document_id"]).unionByName(after).drop("part", "a", "b")


def plural_referents(durable: Column, previous: Column, active: Column, explicit_pair: Column) -> Column:
    """Documents that a plural pronoun means: a durable set of two or more (8 at most), else for an explicit pair the thread before and the active one."""
    none = F.array().cast("array<bigint>")
    clean = lambda a: F.array_distinct(F.coalesce(a, none))
    pair = F.array_distinct(F.concat(clean(previous), clean(active)))
    return F.when(F.size(clean(durable)) >= 2, F.slice(clean(durable), 1, 8)).when(F.coalesce(explicit_pair, F.lit(False)) & (F.size(pair) >= 2), F.slice(pair, 1, 2)).otherwise(none)


def graph_mode(intent: Column, mode: Column) -> Column:
    return F.when(F.lower(mode).isin(GRAPH_MODES), F.lower(mode)).when(intent.isin(HYBRID_INTENTS), "hybrid").when(intent.isin(LOCAL_INTENTS), "local").otherwise("mix")
