"""Quantitative claims in prose and pipe tables, and their support by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import fold_accents

#: Names under which a metric may be written.
METRICS = {"accuracy": ["accuracy", "acc"], "f1": ["f1", "f1-score", "macro-f1"], "precision": ["precision"], "recall": ["recall"], "ccc": ["ccc", "concordance"], "war": ["war"], "uar": ["uar"], "wer": ["wer"], "auc": ["auc", "auroc"], "mae": ["mae"], "rmse": ["rmse"], "bleu": ["bleu"]}
_names = "|".join(sorted((n for names in METRICS.values() for n in names), key=lambda n: (-len(n), n)))
_number = r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:\s?\.\s?\d+)?"
_claim = rf"(?i)\b({_names})\b[^0-9.!?|\n]{{0,40}}?({_number})\s?(%|percent\b|[kmb]\b)?"


def canonical_metric(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*[F.when(low.isin(names), F.lit(m)) for m, names in METRICS.items()])


def canonical_value(number: Column, unit: Column) -> Column:
    """A decimal: grouping commas and blanks around the point go; k, m and b multiply."""
    plain = F.regexp_replace(F.regexp_replace(number, ",(?=[0-9]{3})", ""), r"\s", "")
    factor = F.when(F.lower(unit) == "k", 1_000).when(F.lower(unit) == "m", 1_000_000).when(F.lower(unit) == "b", 1_000_000_000).otherwise(1)
    return (plain.try_cast("decimal(28,8)") * factor).cast("decimal(38,8)")


def prose_claims(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, claim_index, metric, value, percent, sentence) for each metric with a number after it in the same sentence."""
    whole = F.regexp_replace(F.col(text), r"(\d)\s\.\s?(\d)", "$1.$2")  # a decimal that an extractor took apart
    cut = F.split(whole, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])|\n+")
    sentences = rows.select(key, F.posexplode(cut).alias("s", "sentence"))
    found = sentences.select(key, "s", "sentence", F.posexplode(F.regexp_extract_all("sentence", F.lit(_claim), F.lit(0))).alias("i", "m"))
    metric, number, unit = (F.regexp_extract("m", _claim, g) for g in (1, 2, 3))
    out = found.select(key, (F.col("s") * 1000 + F.col("i")).alias("claim_index"), canonical_metric(metric).alias("metric"), canonical_value(number, unit).alias("value"), F.lower(unit).isin("%", "percent").alias("percent"), "sentence")
    return out.where(F.col("metric").isNotNull() & F.col("value").isNotNull())


def table_claims(tables: DataFrame, key: str, markdown: str = "markdown") -> DataFrame:
    """(key, claim_index, subject, metric, value, percent) for each number under a metric's column; the first cell of a row is its subject."""
    lines = F.split(markdown, "\n")
    cells = lambda row: F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"\|"), F.trim)
    rows = tables.select(key, cells(F.element_at(lines, 1)).alias("head"), F.posexplode(F.slice(lines, F.lit(3), F.size(lines))).alias("r", "row"))
    rows = rows.select(key, "r", F.element_at(cells(F.col("row")), 1).alias("subject"), F.posexplode(F.arrays_zip(F.col("head").alias("h"), cells(F.col("row")).alias("c"))).alias("i", "x"))
    name, number, unit = F.regexp_extract("x.h", rf"(?i)\b({_names})\b", 1), F.regexp_extract("x.c", rf"({_number})", 1), F.regexp_extract("x.c", r"(%)", 1)
    out = rows.where("i > 0").select(key, (F.col("r") * 1000 + F.col("i")).alias("claim_index"), "subject", canonical_metric(name).alias("metric"), canonical_value(number, F.lit("")).alias("value"), ((unit == "%") | F.col("x.h").contains("%")).alias("percent"))
    return out.where(F.col("metric").isNotNull() & F.col("value").isNotNull())


_known = {x.replace("-", " ").lower(): m for m, names in fixed.METRIC_NAMES.items() for x in names}
_metric = r"(?i)(?<![\w-])(" + "|".join(r"[\s_-]+".join(x.split()) for x in sorted(_known, key=lambda x: (-len(x), x))) + r")(?![\w-])"


def metric_of(cell: Column) -> Column:
    """The metric that a table's cell names, by any of its names; null without one."""
    name = F.regexp_replace(F.lower(F.regexp_extract(cell, _metric, 1)), r"[\s_-]+", " ")
    of = {m: [x for x, of in _known.items() if of == m] for m in fixed.METRIC_NAMES}
    return F.when(fold_accents(F.trim(cell)).rlike(fixed.MILLIONS_HEADER), "parameters").otherwise(F.coalesce(*[F.when(name.isin(*names), m) for m, names in of.items()]))


def _dimension(word: Column) -> Column:
    return F.coalesce(*[F.when(word.isin(*names), d) for d, names in fixed.DIMENSIONS.items()])


def qualifier_of(cell: Column) -> Column:
    """What a cell qualifies values by: its words joined by dashes, a dimension by its name; null for general words and without letters."""
    words = F.trim(F.regexp_replace(fold_accents(cell), r"[^a-z0-9]+", " "))
    return F.coalesce(_dimension(words), F.when(words.rlike("[a-z]") & ~words.isin(*fixed.GENERIC_QUALIFIERS), F.replace(words, F.lit(" "), F.lit("-"))))


def _numbers(cell: Column) -> Column:
    """Numbers of a cell as (value, unit, percent), without years and references in brackets. A comma is a decimal point, as in a point that an extractor took apart."""
    plain = F.regexp_replace(cell, r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]", " ")
    found = F.regexp_extract_all(plain, F.lit(fixed.METRIC_NUMBER), F.lit(0))
    group = lambda m, i: F.regexp_extract(m, fixed.METRIC_NUMBER, i)
    point = lambda m: F.replace(F.regexp_replace(group(m, 1), r"\s", ""), F.lit(","), F.lit("."))
    each = F.transform(found, lambda m: F.struct(point(m).try_cast("decimal(28,8)").alias("value"), F.lower(group(m, 2)).alias("unit"), (group(m, 3) == "%").alias("percent")))
    year = lambda n: (n["unit"] == "") & ~n["percent"] & (n["value"] == F.floor(n["value"])) & n["value"].between(1900, 2100)
    return F.filter(each, lambda n: n["value"].isNotNull() & ~year(n))


def grid_claims(tables: DataFrame, key: str, markdown: str = "markdown") -> DataFrame:
    """(key, claim_index, metric, value, percent, subject, qualifiers) of the values of pipe tables, whatever their headers say.

    The head is the row above the first rule, else the first that names a metric. Three layouts, for each head of a table:

    - columns: a metric heads its column; dimensions in the head qualify it. A later row of metrics without numbers is a new head.
    - rows: a column of metrics and columns of values; the metric is the row's.
    - sections: one metric in the whole head, and rows of one label (alone, or in every cell) above those with numbers. The metric is the whole table's, and
      section and column qualify it.

    Units are a percent sign in cell or head, k, m and b in the cell, and millions in the head of parameters. The subject is the cell of
    the column headed model (method, system and so on), else the row's first cell that has letters and is neither metric nor value. A column's
    cell that names metrics itself gives these. Tables without a head, rows that are empty and null tables give nothing.
    """
    first = lambda cells, test: F.array_position(F.transform(cells, test), True).cast("int") - 1
    lines = tables.select(F.col(key).alias("_k"), F.posexplode(F.split(markdown, r"\r?\n")).alias("_r", "_line")).where(F.length("_line") - F.length(F.replace("_line", F.lit("|"), F.lit(""))) >= 2)
    rows = lines.withColumn("cells", F.transform(F.split(F.regexp_replace(F.trim("_line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(F.regexp_replace(c, "[*`~]", ""))))
    rows = rows.withColumn("filled", F.filter("cells", lambda c: F.regexp_replace(c, r"[\s:|_-]", "") != ""))
    rows = rows.withColumns({"rule": (F.size(F.filter("cells", lambda c: c != "")) > 0) & F.forall(F.filter("cells", lambda c: c != ""), lambda c: c.rlike(r"\A:?-{3,}:?\z")), "metrics": F.transform("cells", metric_of), "counted": F.exists("cells", lambda c: F.size(_numbers(c)) > 0)})
    named = F.exists("metrics", lambda m: m.isNotNull())
    label = F.when((F.size(F.array_distinct("filled")) == 1) & ~F.col("counted") & ~named, qualifier_of(F.get("filled", F.lit(0))))
    table_, order = W.partitionBy("_k"), W.partitionBy("_k").orderBy("_r")
    rows = rows.withColumns({"named": named, "label": label, "nth": F.row_number().over(order), "general": F.exists("cells", lambda c: fold_accents(c).rlike(fixed.METRIC_HEADER))})
    ruled = F.min(F.when(F.col("rule"), F.col("nth"))).over(table_)
    rows = rows.withColumn("top", F.when(ruled > 1, ruled - 1).otherwise(F.min(F.when(F.col("named") | F.col("general"), F.col("nth"))).over(table_))).where("nth >= top AND NOT rule")
    is_head = (F.col("nth") == F.col("top")) | (F.col("named") & ~F.col("counted"))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("is_head", is_head).withColumns({
        "head": F.last(F.when(F.col("is_head"), F.struct("nth", "cells", "metrics")), ignorenulls=True).over(so_far),
        "section": F.last(F.when(~F.col("is_head") & F.col("label").isNotNull(), F.struct("nth", "label")), ignorenulls=True).over(so_far),
    })
    rows = rows.withColumn("section", F.when(F.col("section.nth") > F.col("head.nth"), F.col("section.label")))
    of_head = W.partitionBy("_k", "head.nth")
    by_metric, by_value = first("head.cells", lambda c: fold_accents(c).rlike(fixed.METRIC_HEADER)), lambda c: fold_accents(c).rlike(fixed.VALUE_HEADER)
    only = F.size(F.filter("head.metrics", lambda m: m.isNotNull())) == 1
    at = first("head.metrics", lambda m: m.isNotNull())
    rows = rows.withColumns({"m": by_metric, "at": at, "model": first("head.cells", lambda c: fold_accents(c).rlike(fixed.MODEL_HEADER)), "sections": only & (F.max(F.col("section").isNotNull()).over(of_head))})
    layout = F.when((F.col("m") >= 0) & F.exists("head.cells", by_value), "rows").when(F.col("sections"), "sections").otherwise("columns")
    rows = rows.withColumn("layout", layout).where(~F.col("is_head") & (F.col("label").isNull() | (F.col("layout") != "sections")))
    cell = rows.select("_k", "nth", "cells", "head", "section", "m", "at", "model", "layout", F.posexplode("cells").alias("c", "cell")).withColumns({"top_cell": F.get("head.cells", F.col("c")), "of_column": F.get("head.metrics", F.col("c"))})
    metric = F.when(F.col("layout") == "rows", F.when((F.col("c") != F.col("m")) & by_value(F.col("top_cell")), metric_of(F.get("cells", F.col("m"))))).when(F.col("layout") == "sections", F.when((F.col("c") != F.col("at")) & F.col("section").isNotNull() & qualifier_of(F.col("top_cell")).isNotNull(), F.get("head.metrics", F.col("at")))).otherwise(F.col("of_column"))
    cell = cell.withColumn("metric", metric).where("metric IS NOT NULL")

    # a cell with names of its own is cut before each of them
    inline = (F.col("layout") == "columns") & metric_of(F.col("cell")).isNotNull()
    pieces = F.when(inline, F.filter(F.split("cell", "(?=" + _metric.replace("(?i)", "(?i:", 1) + "))"), lambda p: metric_of(p).isNotNull())).otherwise(F.array("cell"))
    cell = cell.withColumn("inline", inline).select("*", F.posexplode(pieces).alias("p", "piece")).withColumn("metric", F.when(F.col("inline"), metric_of(F.col("piece"))).otherwise(F.col("metric")))
    cell = cell.select("*", F.posexplode(_numbers(F.when(F.col("inline"), F.regexp_replace("piece", _metric, " ")).otherwise(F.col("piece")))).alias("q", "n"))

    head_of = F.when(F.col("layout") == "sections", F.concat_ws(" ", F.get("head.cells", F.col("at")), "top_cell")).when(F.col("layout") == "rows", F.concat_ws(" ", "top_cell", F.get("cells", F.col("m")))).otherwise(F.coalesce("top_cell", F.lit("")))
    millions = (F.col("n.unit") == "") & (F.col("metric") == "parameters") & fold_accents(F.trim("top_cell")).rlike(fixed.MILLIONS_HEADER)
    factor = F.when(F.col("n.unit") == "k", 1_000).when((F.col("n.unit") == "m") | millions, 1_000_000).when(F.col("n.unit") == "b", 1_000_000_000).otherwise(1)
    outside = F.transform("cells", lambda x, i: F.when(x.rlike(r"\p{L}") & F.get("head.metrics", i).isNull() & metric_of(x).isNull() & ~F.coalesce(by_value(F.get("head.cells", i)), F.lit(False)), x))
    subject = F.when(F.col("layout") == "sections", F.get("cells", F.col("at"))).when(F.col("model") >= 0, F.get("cells", F.col("model"))).otherwise(F.get(F.array_compact(outside), F.lit(0)))
    words = F.split(F.lower(F.concat_ws(" ", "top_cell", F.when(F.col("inline"), F.col("piece")))), "[^a-z]+")
    dimensions = F.array_distinct(F.array_compact(F.transform(words, _dimension)))
    qualifiers = F.when(F.col("layout") == "sections", F.array_distinct(F.array("section", qualifier_of(F.col("top_cell"))))).when(F.col("layout") == "columns", F.when(F.col("inline"), F.array_distinct(F.array_compact(F.transform(F.split(F.lower(F.regexp_extract("piece", _metric, 1)), "[^a-z]+"), _dimension)))).otherwise(dimensions)).otherwise(F.array().cast("array<string>"))
    place = F.row_number().over(W.partitionBy("_k").orderBy("nth", "c", "p", "q")) - 1
    out = cell.select(F.col("_k").alias(key), place.alias("claim_index"), "metric", (F.col("n.value") * factor).cast("decimal(38,8)").alias("value"), (F.col("n.percent") | F.contains(head_of, F.lit("%"))).alias("percent"), F.nullif(subject, F.lit("")).alias("subject"), qualifiers.alias("qualifiers"))
    return out


def supported(claims: DataFrame, evidence: DataFrame, claim_key: list[str], tolerance: str = "0.005") -> DataFrame:
    """claims with `supported`: some evidence has the metric with an equal value, a fraction and a percentage of it being equal, and the claim's subject where both name one."""
    hundred = lambda v, p: F.when(p, v).otherwise(v * 100)
    e = evidence.select(F.col("metric").alias("e_metric"), F.col("value").alias("e_value"), F.col("percent").alias("e_percent"), (F.lower("subject") if "subject" in evidence.columns else F.lit(None).cast("string")).alias("e_subject"))
    same = F.abs(F.col("value") - F.col("e_value")) <= F.lit(tolerance).cast("decimal(38,8)")
    scaled = (F.col("percent") != F.col("e_percent")) & (F.abs(hundred(F.col("value"), F.col("percent")) - hundred(F.col("e_value"), F.col("e_percent"))) <= F.lit(tolerance).cast("decimal(38,8)"))
    mine = F.col("e_subject").isNull() | (F.lower("subject").eqNullSafe(F.col("e_subject"))) if "subject" in claims.columns else F.lit(True)
    hits = claims.join(e, (F.col("metric") == F.col("e_metric")) & (same | scaled) & mine, "left_semi").select(*claim_key).distinct().withColumn("_ok", F.lit(True))
    return claims.join(hits, claim_key, "left").withColumn("supported", F.coalesce("_ok", F.lit(False))).drop("_ok")


#: Subjects that stand for whoever a document proposes, and for whom it compares with.
PROPOSED, BASELINE = "__proposed__", "__baseline__"


def _owned(answer: Column, evidence: Column, identity: Column) -> Column:
    """Whether the subjects of a claim are those of an evidence, whose document has the names `identity`."""
    has = lambda x, name: F.array_contains(x, name)
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    rest = F.array_except(answer, identity)
    proposed = within(F.array_remove(rest, PROPOSED), evidence) & (has(evidence, PROPOSED) | F.arrays_overlap(evidence, identity))
    named = F.when(F.size(rest) > 0, within(rest, evidence)).otherwise(F.arrays_overlap(evidence, identity) | has(evidence, PROPOSED))
    nobody = ~has(evidence, BASELINE) & (has(evidence, PROPOSED) | F.when(F.size(identity) > 0, F.arrays_overlap(evidence, identity)).otherwise(F.size(evidence) == 0))
    return F.when(has(answer, PROPOSED), proposed).when(F.size(answer) > 0, named).otherwise(nobody)


def supported_by(claims: DataFrame, evidence: DataFrame, claim_key: list[str]) -> DataFrame:
    """claims with `supported`: some evidence has the metric, the value (a fraction and its percentage are equal), all the claim's qualifiers, and its subjects.

    Both have metric, value, percent, qualifiers and subjects; evidence also has identity, the names of its own document. Qualifiers only
    count where both sides have some. Null arrays count as empty, null metrics and values support nothing; claims that share a key are one, and
    claims with a null key stay unsupported.

    One equi-join: values meet as they are or a hundredfold, qualifiers as an inverted list, of which a claim looks up the one that is rarest in the
    evidence. What meets is tested for containment, and evidence that says the same is there once.
    """
    names = ["qualifiers", "subjects"]
    sets = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(c), F.array().cast("array<string>")))))
    number = F.col("value").cast("decimal(38,10)")
    e = evidence.where("metric IS NOT NULL AND value IS NOT NULL").select("metric", number.alias("value"), F.coalesce("percent", F.lit(False)).alias("percent"), *[sets(n).alias(f"e_{n}") for n in names], sets("identity").alias("identity")).distinct()
    c = claims.where("metric IS NOT NULL AND value IS NOT NULL").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(claim_key)], "metric", number.alias("value"), F.coalesce("percent", F.lit(False)).alias("percent"), *[sets(n).alias(n) for n in names])
    uses = e.select(F.explode("e_qualifiers").alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    looked = c.where("size(qualifiers) > 0").select("qualifiers", F.explode("qualifiers").alias("q")).distinct().join(uses, "q", "left")
    rarest = looked.groupBy("qualifiers").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "q"))["q"].alias("rarest"))
    any_, none = F.struct(F.lit(0).alias("kind"), F.lit("").alias("q")), F.struct(F.lit(1).alias("kind"), F.lit("").alias("q"))
    of = lambda q: F.struct(F.lit(2).alias("kind"), q.alias("q"))
    listed = e.withColumn("token", F.explode(F.concat(F.array(any_), F.when(F.size("e_qualifiers") == 0, F.array(none)).otherwise(F.transform("e_qualifiers", of)))))
    same = lambda v, p: F.struct(v.cast("decimal(38,10)").alias("value"), p.alias("percent"))
    v, p = F.col("value"), F.col("percent")
    values = F.array_distinct(F.array(same(v, p), same(v, ~p), same(v * 100, ~p), same(v / 100, ~p)))
    tokens = F.when(F.size("qualifiers") == 0, F.array(any_)).otherwise(F.array(none, of(F.col("rarest"))))
    asked = c.join(rarest, "qualifiers", "left").withColumn("x", F.explode(values)).withColumn("token", F.explode(tokens)).select(*[f"_k{i}" for i in range(len(claim_key))], "metric", "x.*", "token", *names)
    fits = (F.size("e_qualifiers") == 0) | (F.size(F.array_except("qualifiers", "e_qualifiers")) == 0)
    hits = asked.join(listed, ["metric", "value", "percent", "token"]).where(fits & _owned(F.col("subjects"), F.col("e_subjects"), F.col("identity")))
    hits = hits.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(claim_key)]).distinct().withColumn("_ok", F.lit(True))
    return claims.join(hits, claim_key, "left").withColumn("supported", F.coalesce("_ok", F.lit(False))).drop("_ok")


def without_unsupported(lines: DataFrame, bad: DataFrame, key: str, line: str = "line", claim: str = "sentence") -> DataFrame:
    """Answer lines without those of which an unsupported claim is a prefix, or the other way round."""
    b = bad.select(F.col(key).alias("_k"), F.trim(claim).alias("_c")).distinct()
    either = F.trim(line).startswith(F.col("_c")) | F.col("_c").startswith(F.trim(line))
    return lines.join(b, (F.col(key) == F.col("_k")) & (F.trim(line) != "") & either, "left_anti")


def accepted(answers: DataFrame, checked: str = "checked_metrics", requested: str = "requested_metrics") -> Column:
    """Whether an answer holds: it is valid and all requested metrics were checked."""
    return F.col("valid") & (F.size(F.array_except(requested, checked)) == 0)


def quoted(quote: Column, source: Column, least: int = 24) -> Column:
    """Whether a source has a quote: as text with single spaces, or, if long enough, by letters and digits alone."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    compact = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return source.isNotNull() & (flat(source).contains(flat(quote)) | ((F.length(compact(quote)) >= least) & compact(source).contains(compact(quote))))
