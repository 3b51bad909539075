"""Deterministic routing and curation rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.text import squeeze


def words(alternatives: list[str]) -> str:
    """A pattern of whole words, of any script and case."""
    return r"(?iuU)(?<!\w)(?:" + "|".join(alternatives) + r")(?!\w)"


def _has(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def normal(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def comparison(text: Column) -> Column:
    """Whether a question compares: by a cue, by `vs`, or by a choice that is judged soon after."""
    low = normal(text)
    choice = words(fixed.CHOICE_WORDS) + rf"(?s:.{{0,{fixed.CHOICE_REACH}}})" + words(fixed.CHOICE_JUDGEMENTS)
    return low.rlike(words(fixed.COMPARISON_CUES)) | low.rlike(r"(?i)(?<![a-z0-9])vs\.?(?![a-z0-9])") | low.rlike(choice)


def route(text: Column, focused: Column) -> Column:
    """What decides a turn's route without a model, else null: social and casual turns, questions for a facet of a named or focused document."""
    task, low = F.coalesce(text, F.lit("")), normal(text)
    social = task.rlike(r"(?iuU)^\s*(?:" + "|".join(fixed.SOCIAL_ACTS) + r")(?:\s*[!.…]+)?\s*$")
    named = task.rlike(r"(?iuU)(?<!\w)" + fixed.DOCUMENT_REFERENCE) | task.rlike(r"(?iuU)(?<!\w)" + fixed.DOCUMENT_FILE + r"(?!\w)")
    facet, compares = task.rlike(words(fixed.DOCUMENT_FACETS)), comparison(text)
    about = named | facet | task.rlike(words(fixed.DOCUMENT_ANALYSES)) | task.rlike(words(fixed.DOCUMENT_VISUALS)) | compares
    casual = ~focused & ~about & low.rlike(r"(?iuU)^(?:" + "|".join(fixed.CASUAL_STARTS) + r")\b")
    structured = F.when(named, "explicit_structured_document_request").when(focused, "focused_structured_document_followup")
    return F.when(social, "deterministic_social_acknowledgement").when(casual, "deterministic_casual_chat").when(facet & ~compares, structured)


def intent(text: Column) -> Column:
    """infer_structure, compare, example, simplify, elaborate or direct_answer, by the first that fits."""
    low = normal(text)
    fits = {name: _has(low, markers) for name, markers in fixed.INTENT_MARKERS}
    fits["compare"] = fits["compare"] | comparison(text)
    return F.coalesce(*[F.when(fit, name) for name, fit in fits.items()], F.lit("direct_answer"))


def depth(text: Column) -> Column:
    """detailed, brief or normal."""
    return F.coalesce(*[F.when(_has(normal(text), markers), name) for name, markers in fixed.DEPTH_MARKERS], F.lit("normal"))


def wants_visual(text: Column) -> Column:
    """Whether a question asks for a figure."""
    rest = F.regexp_replace(normal(text), words(fixed.MODEL_PHRASES), " ")
    return _has(rest, fixed.VISUAL_MARKERS) | rest.rlike(words(fixed.IMAGE_WORDS))


def wants_results(text: Column) -> Column:
    """Whether a question asks for a table of results."""
    return _has(normal(text), fixed.RESULT_MARKERS) | normal(text).rlike(words(fixed.RESULT_METRICS))


def enriched(text: Column, topic: Column, intent: Column, scoped: Column) -> Column:
    """A question with anchors of its kind before it, if it has a topic in scope and wants an explanation; else, or if they are there, as it is.

    scoped: whether documents are in focus or the topic is the name of something. Null texts and topics count as empty.
    """
    asked, name, low = F.coalesce(text, F.lit("")), F.trim(F.coalesce(topic, F.lit(""))), normal(text)
    explains = _has(low, fixed.EXPLAIN_MARKERS) | F.coalesce(intent.isin(fixed.EXPLAIN_INTENTS), F.lit(False))
    results = F.when(low.contains("ablation"), fixed.ANCHORS["ablation"]).when(low.rlike(words([fixed.NUMBERED_TABLE])), fixed.ANCHORS["numbered"]).otherwise(fixed.ANCHORS["results"])
    anchors = F.concat_ws(" ", name, F.when(wants_results(text), results).when(wants_visual(text), fixed.ANCHORS["visual"]).otherwise(fixed.ANCHORS["model"]))
    fits = (name != "") & explains & F.coalesce(scoped, F.lit(False)) & ~F.contains(low, F.lower(anchors))
    return F.when(fits, F.trim(F.concat_ws(" ", anchors, asked))).otherwise(asked)


def resumes(text: Column) -> Column:
    """Whether a turn goes back to a document."""
    low = normal(text)
    return low.rlike(words(fixed.RESUME_WORDS)) & low.rlike(words(fixed.RESUMED_DOCUMENTS))


def follow_up(text: Column) -> Column:
    """Whether a turn leans on the one before: it resumes a document, has a marker or metric, or is short without a mixed-case name or PDF."""
    low = normal(text)
    topic = F.coalesce(text, F.lit("")).rlike(r"(?U)\b[A-Za-z]*[A-Z][A-Za-z]*[A-Z][A-Za-z]*\b|\.pdf\b")
    return resumes(text) | _has(low, fixed.FOLLOW_UP_MARKERS) | low.rlike(words(fixed.FOLLOW_UP_METRICS)) | ((F.length(low) <= fixed.FOLLOW_UP_LENGTH) & ~topic)


def _compounds(low: Column) -> Column:
    """Labels of the known names of several words that a lower-cased text with single spaces has, in the order of the list."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike("(?U)" + p), label) for p, label in fixed.COMPOUND_NAMES])))


def is_name(word: Column) -> Column:
    """Whether a word names something: a known name, a PDF, an acronym, letters with digits, mixed case, or parts joined by underscores; no common word or metric."""
    w = F.trim(word)
    low, compact = F.lower(w), F.regexp_replace(w, "[_-]", "")
    known = reduce(lambda a, b: a | b, [low.rlike("(?U)" + p) for p, _ in fixed.COMPOUND_NAMES]) | low.endswith(".pdf")
    acronym = w.rlike(r"\A[A-Z][A-Z0-9]*(?:[-_][A-Z0-9]+)*\z") & (F.length(compact) >= 2)
    mixed = (w.rlike("[A-Za-z]") & w.rlike(r"(?U)\d") & (F.length(compact) >= 3)) | w.rlike("[a-z][A-Z]") | (w.contains("_") & (F.length(compact) >= 4))
    return (F.length(w) >= 3) & ~low.isin(*fixed.UNNAMED_WORDS, *fixed.UNNAMED_METRICS) & (known | acronym | mixed)


def entities(text: Column, most: int = 8) -> Column:
    """Names in order of first use, distinct without case, and after them the labels of known names of several words; at most `most`. Null has none."""
    own = F.coalesce(text, F.lit(""))
    words_ = F.regexp_extract_all(own, F.lit(rf"(?U)\b{fixed.NAME_WORD}\b"), F.lit(0))
    found = F.concat(F.filter(words_, lambda w: ~F.lower(w).isin(*fixed.QUESTION_WORDS) & is_name(w)), F.filter(_compounds(normal(own)), is_name))
    first = F.slice(F.array_distinct(F.transform(found, F.lower)), 1, most)
    return F.transform(first, lambda low: F.get(F.filter(found, lambda w: F.lower(w) == low), F.lit(0)))


def targets(text: Column) -> Column:
    """Whether a turn names the document it wants: a name after a noun for documents or a numbered table, or a PDF."""
    own = F.coalesce(text, F.lit(""))
    after = lambda before: F.exists(F.regexp_extract_all(own, F.lit(rf"(?iuU)(?<!\w){before}({fixed.NAME_WORD})(?!\w)"), F.lit(1)), is_name)
    return after(fixed.TARGET_NOUNS) | after(fixed.TARGET_TABLES) | own.rlike(rf"(?iU)(?<!\w){fixed.DOCUMENT_FILE}(?!\w)")


def mentioned(name: Column, text: Column) -> Column:
    """Whether a text has a name, without case, or its letters and digits alone."""
    low, key = F.lower(F.coalesce(text, F.lit(""))), F.trim(F.lower(name))
    compact = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")
    return (key != "") & (low.contains(key) | ((compact(key) != "") & compact(low).contains(compact(key))))


def topic_switch(text: Column, history: Column) -> Column:
    """Whether a turn leaves the topic of the turns before it (`history`: their text, null without any).

    A turn that resumes a document doesn't. One that names the document it wants does, and one with a name that the history lacks; known
    names of several words are in the history under any of their spellings. Without a history, a name and a word for turning do.
    """
    names = entities(text)
    said = F.array_join(F.concat(F.array(F.coalesce(history, F.lit(""))), _compounds(normal(history))), " ")
    fresh = F.exists(names, lambda n: ~mentioned(n, said))
    turns = normal(text).rlike(r"(?U)\b(?:" + "|".join(fixed.SWITCH_WORDS) + r")\b")
    return ~resumes(text) & (targets(text) | F.when(F.coalesce(history, F.lit("")) != "", fresh).otherwise(turns & (F.size(names) > 0)))


def recent(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", messages: int = 6, chars: int = 1600) -> DataFrame:
    """turns with `history`: the lines `role: text` of the last messages before, oldest first, up to the newest that would pass `chars`; null without any."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    lines = turns.withColumn("_line", F.when(flat != "", F.concat(F.coalesce(role, F.lit("message")), F.lit(": "), flat)))
    w = W.partitionBy(conversation).orderBy(order).rowsBetween(-messages, -1)
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))

    def add(s: Column, line: Column) -> Column:
        used = s["used"] + F.length(line)
        return F.struct(used.alias("used"), F.when(used <= chars, F.array_prepend(s["kept"], line)).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(F.reverse("_all"), state, add, lambda s: s["kept"])
    return lines.withColumn("_all", F.collect_list("_line").over(w)).withColumn("history", F.nullif(F.array_join(kept, "\n"), F.lit(""))).drop("_line", "_all")


def budgets(rows: DataFrame, intent: str = "intent", depth: str = "depth") -> DataFrame:
    """rows with the six context limits of their intent and depth."""
    kind = F.when((F.col(depth) == "detailed") | F.col(intent).isin(fixed.DETAILED_INTENTS), "detailed").when(F.col(depth) == "brief", "brief").otherwise("normal")
    names = list(fixed.CONTEXT_LIMITS["normal"])
    return rows.withColumns({n: F.coalesce(*[F.when(kind == k, F.lit(limits[n])) for k, limits in fixed.CONTEXT_LIMITS.items()]) for n in names})


def best_table(scored: DataFrame, by: str, key: str) -> DataFrame:
    """The one table with the best positive score; none on a tie."""
    w = W.partitionBy(by).orderBy(F.desc("score"), key)
    led = scored.withColumns({"_n": F.row_number().over(w), "_next": F.lead("score").over(w)})
    return led.where((F.col("_n") == 1) & (F.col("score") > 0) & (F.col("_next").isNull() | (F.col("_next") < F.col("score")))).drop("_n", "_next")


def curate(figures: DataFrame, mode: str, by: str, doc: str, rank: str = "rank") -> DataFrame:
    """Figures that pass the gate: `one`, `one_per_document`, `two_per_document` (4 at most), or three."""
    per_doc, most = {"one": (1, 1), "one_per_document": (1, 1000), "two_per_document": (2, 4)}.get(mode, (3, 3))
    a, b = W.partitionBy(by, doc).orderBy(rank), W.partitionBy(by).orderBy(rank)
    kept = figures.where("passes").withColumn("_d", F.row_number().over(a)).where(F.col("_d") <= per_doc)
    return kept.withColumn("_n", F.row_number().over(b)).where(F.col("_n") <= most).drop("_d", "_n")


def figure_gate(width: Column, height: Column, caption: Column, kind: Column) -> Column:
    """Whether an image is worth indexing: not a sliver, large enough, and captioned or of a known kind."""
    shape = F.greatest(width, height) / F.greatest(F.least(width, height), F.lit(1))
    return F.coalesce((width * height >= 10_000) & (shape <= 12) & ((F.length(F.trim(caption)) > 0) | kind.isin("figure", "chart", "diagram")), F.lit(False))


def asset_class(rows: DataFrame, caption: str = "caption", method: str = "method", source: str = "caption_source", kind: str = "asset_type", size: tuple[str, str] = ("width", "height"), box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), page: tuple[str, str] = ("page_width", "page_height"), repeated: str = "repeated") -> DataFrame:
    """rows with status, asset_kind, confidence and reasons of their visual assets.

    Page renders and tiny rasters are rejected at once; of the rest, what speaks for and against an asset is named in order and the
    first class that it allows is taken. Null sizes, boxes and pages name nothing; null captions count as empty.
    """
    limit, sure = fixed.ASSET_LIMITS, fixed.ASSET_CONFIDENCE
    low, lower = normal(F.col(caption)), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    truth = lambda c: F.coalesce(c, F.lit(False))
    direct, labelled = lower(source).isin(fixed.DIRECT_CAPTIONS), low.rlike(fixed.FIGURE_LABEL)
    width, height = (F.col(c).cast("double") for c in size)
    known = truth((width != 0) & (height != 0))
    x0, y0, x1, y1 = (F.col(c) / F.nullif(F.col(page[i % 2]).cast("double"), F.lit(0.0)) for i, c in enumerate(box))
    share, middle = (x1 - x0) * (y1 - y0), (y0 + y1) / 2
    small = known & (width * height < limit["small_area"]) & ~direct
    tiny_share = truth(share < limit["tiny_share"]) & ~direct
    margin = truth(((middle < limit["margin"]) | (middle > 1 - limit["margin"])) & (share < limit["margin_share"])) & ~direct
    again = truth(F.col(repeated) >= 2) & ~direct
    tests = {"figure_caption": labelled, "direct_caption_anchor": direct, "small_raster_without_direct_caption": small, "tiny_page_area": tiny_share, "header_footer_asset": margin, "repeated_across_pages": again}
    reasons = F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    lacks = F.when(low.startswith(fixed.EXTRACTED_CAPTION) | (low == ""), "missing_caption_anchor").when(labelled, "unverified_caption_assignment").otherwise("non_figure_caption")
    rendered = (lower(kind) == "page") | lower(method).isin(fixed.PAGE_METHODS) | low.contains(fixed.PAGE_CAPTION)
    tiny = known & (F.least(width, height) < limit["tiny_side"])
    as_ = lambda status, name, share_, why: F.struct(F.lit(status).alias("status"), F.lit(name).alias("asset_kind"), F.lit(sure[share_]).alias("confidence"), why.alias("reasons"))
    verdict = (
        F.when(rendered, as_("rejected", "page", "page", F.array(F.lit("page_render_fallback"))))
        .when(tiny, as_("rejected", "decorative", "decorative", F.array(F.lit("tiny_raster"))))
        .when(margin | again, as_("rejected", "branding", "branding", reasons))
        .when(small | tiny_share, as_("needs_review", "panel", "panel", reasons))
        .when(direct, as_("accepted", "figure", "direct", reasons))
        .when(labelled & ~lower(source).isin(fixed.GUESSED_CAPTIONS), as_("accepted", "figure", "labelled", reasons))
        .otherwise(as_("needs_review", "unknown", "unknown", F.array_append(reasons, lacks)))
    )
    return rows.withColumn("_v", verdict).select(*rows.columns, "_v.*")


def topics(rows: DataFrame, wanted: list[str], tags: str = "tags") -> DataFrame:
    """Rows with all wanted tags; all rows if none has them."""
    fits = F.size(F.array_except(F.array(*map(F.lit, wanted)), F.col(tags))) == 0 if wanted else F.lit(True)
    marked = rows.withColumn("_f", fits)
    some = marked.agg(F.coalesce(F.bool_or("_f"), F.lit(False)).alias("_any"))
    return marked.join(F.broadcast(some)).where(F.col("_f") | ~F.col("_any")).drop("_f", "_any")


def tool_contract(actual: Column, required: Column, allowed: Column) -> Column:
    """Whether the tools used have all that are required and none that isn't allowed."""
    return (F.size(F.array_except(required, actual)) == 0) & (F.size(F.array_except(actual, allowed)) == 0)


def coverage(found: DataFrame, requested: list[str], key: str, facet: str) -> DataFrame:
    """(key, covered, missing) facets of each document."""
    want = F.array(*map(F.lit, requested))
    return found.groupBy(key).agg(F.array_intersect(want, F.array_sort(F.collect_set(facet))).alias("covered"), F.array_except(want, F.collect_set(facet)).alias("missing"))


def failures(events: DataFrame, case: str, rules: dict[str, Column]) -> DataFrame:
    """(case, failures): names of the aggregate rules that a case's events break."""
    tested = events.groupBy(case).agg(*[F.coalesce(t, F.lit(False)).alias(n) for n, t in rules.items()])
    return tested.select(case, F.array_compact(F.array(*[F.when(~F.col(n), n) for n in rules])).alias("failures"))


def facets(text: Column, markers: dict[str, list[str]]) -> Column:
    """Facets in the order in which their first markers occur."""
    low = F.lower(text)
    at = lambda words: F.array_min(F.array(*[F.when(F.instr(low, w) > 0, F.instr(low, w)) for w in words]))
    found = F.array(*[F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.struct(at(words).alias("p"), F.lit(n).alias("n"))) for n, words in markers.items()])
    return F.transform(F.array_sort(F.array_compact(found)), lambda x: x["n"])


def basename_conflicts(documents: DataFrame, key: str, path: str) -> DataFrame:
    """(base, documents): base names that several documents have."""
    base = F.lower(F.substring_index(path, "/", -1)).alias("base")
    return documents.groupBy(base).agg(F.countDistinct(key).alias("documents")).where("documents > 1")
