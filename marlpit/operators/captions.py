"""Captions of tables and figures that were printed elsewhere on their page: unique matching and first-hit lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a figure's label looks like, a printed table caption, the rule under a table's head, and the starts of a figure's text in their order.
FIGURE_LABEL = r"(?iU)^\s*(?:fig(?:ure)?\.?|hình|hinh)\s*(?:no\.?\s*)?[#:]?\s*(?:\d+|[ivxlcdm]+)(?!\w)"
TABLE_LABEL = r"(?im)^\s*(table\s*(?:no\.?\s*)?[#:]?\s*\d+\s*[:.]\s*[^\r\n]*)"
TABLE_RULE = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"
FIGURE_STARTS = ["figure ", "fig. ", "fig "]
_number = r"(?i)^table\s*(?:no\.?\s*)?[#:]?\s*(\d+)"


def labels_figure(caption: Column) -> Column:
    """Whether a caption's own label says that it is a figure's."""
    return F.coalesce(caption, F.lit("")).rlike(FIGURE_LABEL)


def structured(markdown: Column) -> Column:
    """Whether a table has a head with bars, a rule and at least one row."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    return (F.size(lines) >= 3) & F.coalesce(F.get(lines, F.lit(0)).contains("|") & F.get(lines, F.lit(1)).rlike(TABLE_RULE), F.lit(False))


def _printed(text: Column) -> Column:
    """Printed table captions of a text, in order, with single spaces."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TABLE_LABEL), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def reconcile(tables: DataFrame, chunks: DataFrame, key: str = "table_id", doc: str = "document_id", page: str = "page_number", caption: str = "caption", markdown: str = "markdown", order: str = "chunk_index", content: str = "content") -> DataFrame:
    """tables with `caption` mended, `reconciled_number` and `original_caption` (null where nothing was mended).

    A table that has structure but is labelled as a figure takes the caption that its page's text prints for a table, if it is the only such
    table of the page and exactly one printed number of the page belongs to no other table there. A number that is printed several
    times has its longest caption, of equally long ones the first. Pages that are null, and everything ambiguous, stay as they are.
    """
    place = [doc, page]
    known = tables.where(F.col(page).isNotNull() & F.col(doc).isNotNull())
    owned = known.select(*place, F.regexp_extract(F.get(_printed(F.col(caption)), F.lit(0)), _number, 1).try_cast("decimal(38,0)").alias("_n"), F.coalesce(F.col(caption), F.lit("")).rlike(r"(?i)\A\s*table\s*(?:no\.?\s*)?[#:]?\s*\d+\s*[:.]").alias("_own"))
    owned = owned.where("_own AND _n IS NOT NULL").select(*place, "_n").distinct()
    suspects = known.where(labels_figure(F.col(caption)) & structured(F.col(markdown))).groupBy(*place).agg(F.count("*").alias("_c"), F.min(key).alias(key)).where("_c = 1")
    texts = chunks.join(suspects.select(*place), place, "left_semi").select(*place, F.col(order).alias("_o"), F.posexplode(_printed(F.col(content))).alias("_i", "_label"))
    numbered = texts.withColumn("_n", F.regexp_extract("_label", _number, 1).try_cast("decimal(38,0)")).where("_n IS NOT NULL")
    printed = numbered.groupBy(*place, "_n").agg(F.max(F.struct(F.length("_label").alias("l"), (-F.col("_o")).alias("o"), (-F.col("_i")).alias("i"), "_label")).alias("m"))
    free = printed.join(owned, [*place, "_n"], "left_anti")
    one = free.groupBy(*place).agg(F.count("*").alias("_c"), F.min("_n").alias("_n"), F.min("m._label").alias("_label")).where("_c = 1")
    mended = suspects.select(*place, key).join(one, place).select(F.col(key).alias("_key"), F.col("_n").cast("long").alias("reconciled_number"), "_label")
    out = tables.join(mended, F.col(key) == F.col("_key"), "left")
    kept = [F.coalesce("_label", F.col(caption)).alias(c) if c == caption else F.col(c) for c in tables.columns]
    return out.select(*kept, "reconciled_number", F.when(F.col("_key").isNotNull(), F.coalesce(F.col(caption), F.lit(""))).alias("original_caption"))


def figure_texts(figures: DataFrame, chunks: DataFrame, doc: str = "document_id", number: str = "figure_number", order: str = "chunk_index", content: str = "content") -> DataFrame:
    """figures with `content`: the first chunk of their document that begins with the figure's number after `Figure`, else `Fig.`, else `Fig`; null without one.

    Case doesn't matter, and a number is found at the start of a longer one too, as in a LIKE pattern. An equi-join on the document and on each
    number that a chunk's digits begin with.
    """
    start = r"(?i)\A(" + "|".join(s.replace(".", r"\.") for s in FIGURE_STARTS) + r")(\d+)"
    word, digits = F.lower(F.regexp_extract(content, start, 1)), F.regexp_extract(content, start, 2)
    found = chunks.select(F.col(doc).alias("_doc"), F.col(order).alias("_o"), F.col(content).alias("_content"), word.alias("_w"), digits.alias("_d")).where("_d <> ''")
    heads = F.transform(F.sequence(F.lit(1), F.least(F.length("_d"), F.lit(18))), lambda n: F.substring(F.col("_d"), F.lit(1), n))
    each = found.withColumn("_head", F.explode(heads)).where((F.col("_head") == "0") | ~F.col("_head").startswith("0")).withColumn("_number", F.col("_head").cast("long"))
    rank = F.coalesce(*[F.when(F.col("_w") == s, i) for i, s in enumerate(FIGURE_STARTS)])
    wanted = figures.where(F.col(doc).isNotNull() & F.col(number).isNotNull()).select(F.col(doc).alias("_doc"), F.col(number).cast("long").alias("_number")).distinct()
    first = each.join(wanted, ["_doc", "_number"], "left_semi").groupBy("_doc", "_number").agg(F.min(F.struct(rank.alias("rank"), "_o", "_content")).alias("m"))
    first = first.select("_doc", "_number", F.col("m._content").alias("_found"))
    kept = [c for c in figures.columns if c != content]
    return figures.join(first, (F.col(doc) == F.col("_doc")) & (F.col(number).cast("long") == F.col("_number")), "left").select(*[figures[c] for c in kept], F.col("_found").alias(content))
