"""Redaction, bounds, cache and retention rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

def _rules() -> list[tuple[str, str, list[str], str | None]]:
    """(pattern, replacement, cues, pattern of what is replaced if not all) of each rule in order: header lines, shapes of secrets, labelled secrets, local paths.

    A rule's pattern occurs only in texts that hold one of its cues. A labelled value that is a mark already counts, but stays.
    """
    mark = fixed.SECRET_MARK
    shapes = [(p, f"{kept}{mark}" + ("@" if "://" in p and kept else ""), cues, None) for (p, kept), cues in zip(fixed.SECRET_SHAPES, fixed.SECRET_CUES, strict=True)]
    unmarked = rf"(?iu)({fixed.SECRET_LABEL})(?![\"']?\[REDACTED_){fixed.SECRET_VALUE}"
    return [
        (fixed.HEADER_LINE, f"$1{mark}", ["authorization", "cookie"], None), *shapes,
        (fixed.LABELLED_SECRET, f"$1$2{mark}$2", fixed.SECRET_LABEL_CUES, unmarked), (fixed.LOCAL_PATH, fixed.PATH_MARK, ["/users/", "/home/", "/private/", ":\\users\\"], None),
    ]


def _low(text: Column) -> Column:
    """Lower case, also of the two characters outside ASCII that equal a letter of it when case is ignored."""
    return F.lower(F.translate(text, "\u017f\u212a", "sk"))


def redact_table(rows: DataFrame, column: str) -> DataFrame:
    """rows with `column` redacted and n_redacted, rule by rule; null texts stay null with none redacted.

    A rule's pattern only runs on texts with one of its cues. Each rule's text is a column of its own, so that none is evaluated twice.
    """
    out = rows.withColumns({"n_redacted": F.lit(0), "_low": _low(F.col(column))})
    for pattern, replacement, cues, changed in _rules():
        cued = reduce(lambda a, b: a | b, [F.contains("_low", F.lit(c)) for c in cues])
        out = out.withColumn("_n", F.when(cued, F.regexp_count(F.col(column), F.lit(pattern))).otherwise(0))
        done = F.regexp_replace(F.col(column), changed or pattern, replacement)
        out = out.withColumns({column: F.when(F.col("_n") > 0, done).otherwise(F.col(column)), "n_redacted": F.col("n_redacted") + F.coalesce("_n", F.lit(0))}).drop("_n")
    return out.drop("_low")


def denied_key(name: Column) -> Column:
    """Whether a key's value must not be shown; CamelCase counts as words."""
    words = F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_"), r"[^A-Za-z0-9]+", "_")
    return F.lower(words).rlike(r"(^|_)(" + "|".join(fixed.DENIED_KEYS) + ")_*$")


def redact_map(payload: Column) -> Column:
    """A map with the values of denied keys replaced."""
    return F.transform_values(payload, lambda k, v: F.when(denied_key(k), fixed.SECRET_MARK).otherwise(v))


def cache_live(expires_at: Column, now: Column) -> Column:
    return expires_at.isNull() | (expires_at > now)


def valid_payload(payload: Column) -> Column:
    """Cached results with documents, whose validation is not false."""
    documents = F.get_json_object(payload, "$.documents")
    return F.coalesce(documents.isNotNull() & (F.coalesce(F.json_array_length(documents), F.lit(0)) > 0) & F.coalesce(F.get_json_object(payload, "$.validation.ok") != "false", F.lit(True)), F.lit(False))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def bound_bytes(text: Column, most: int) -> tuple[Column, Column]:
    """A text of at most `most` UTF-8 bytes, halved until it fits, and whether it was cut."""
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(24)), text, lambda t, _: F.when(F.octet_length(t) > most, F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))).otherwise(t))
    return halved, F.octet_length(text) > most
