"""Conversation memory: episodes, pairs, ring buffers, versioned items, queues and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import overlap_ratio


def episodes(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """User and assistant rows with their episode: each user row opens one; assistant rows before the first are episode 0."""
    kept = messages.where(F.col(role).isin("user", "assistant"))
    count = F.sum((F.col(role) == "user").cast("int")).over(W.partitionBy(conversation).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return kept.withColumn("episode", count)


def pairs(messages: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, user_text, assistant_text) where an assistant row directly follows a user row, system rows left out."""
    w = W.partitionBy(conversation).orderBy(order)
    kept = messages.where(F.col(role).isin("user", "assistant"))
    led = kept.withColumns({"next_role": F.lead(role).over(w), "assistant_text": F.lead(text).over(w)})
    return led.where((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(conversation, order, F.col(text).alias("user_text"), "assistant_text")


def newest(rows: DataFrame, n: int, by: list[str], partition: list[str] | None = None) -> DataFrame:
    """The newest n rows of each partition, or of all: a ring buffer or retention."""
    if partition is None:
        return rows.orderBy(*[F.desc(c) for c in by]).limit(n)
    place = F.row_number().over(W.partitionBy(*partition).orderBy(*[F.desc(c) for c in by]))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def next_sequence(turns: DataFrame, conversation: str, sequence: str) -> DataFrame:
    return turns.groupBy(conversation).agg((F.coalesce(F.max(sequence), F.lit(0)) + 1).alias("next_seq"))


def number_from(new: DataFrame, next_seq: DataFrame, conversation: str, order: str) -> DataFrame:
    """New turns with durable numbers that go on from each conversation's next one."""
    place = F.row_number().over(W.partitionBy(conversation).orderBy(order)) - 1
    return new.join(next_seq, conversation, "left").withColumn("turn_seq", F.coalesce("next_seq", F.lit(1)) + place).drop("next_seq")


def versions(operations: DataFrame, key: list[str], at: str, seq: str, content: str, action: str = "action") -> DataFrame:
    """Versioned items from upsert and forget operations: one row for each upsert with valid_from, valid_to and status.

    An upsert closes the version before it, also with equal content; a forget closes it without a new one. Versions know their
    predecessor (supersedes, a sequence number; null after a forget).
    """
    w = W.partitionBy(*key).orderBy(at, seq)
    led = operations.withColumns({"valid_to": F.lead(at).over(w), "_next": F.lead(action).over(w), "_before": F.lag(action).over(w), "_seq": F.lag(seq).over(w)})
    status = F.when(F.col("valid_to").isNull(), "active").when(F.col("_next") == "forget", "forgotten").otherwise("superseded")
    supersedes = F.when(F.col("_before") == "upsert", F.col("_seq"))
    return led.where(F.col(action) == "upsert").select(*key, F.col(seq).alias("version"), content, F.col(at).alias("valid_from"), "valid_to", status.alias("status"), supersedes.alias("supersedes"))


def as_of(items: DataFrame, moment: Column) -> DataFrame:
    """Versions valid at a moment, closed ones too; intervals are half-open."""
    return items.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def in_scope(conversation: Column | None) -> Column:
    """Global items, and those of one conversation; without a conversation global ones only."""
    everyone = F.col("scope") == "global"
    return everyone if conversation is None else everyone | F.coalesce((F.col("scope") == "conversation") & (F.col("conversation_id") == conversation), F.lit(False))


def relevance(procedural: Column, query: Column, key: Column, content: Column, phrase: Column) -> Column:
    """1 for procedural items, twice the overlap with the key, the overlap with the content, 1 for the whole phrase."""
    return F.when(procedural, 1.0).otherwise(0.0) + 2 * overlap_ratio(query, key) + overlap_ratio(query, content) + F.when(phrase, 1.0).otherwise(0.0)


def memory_order() -> list[Column]:
    """Procedural first, then relevance, confidence and recency, then id."""
    return [F.when(F.col("kind") == "procedural", 0).otherwise(1), F.desc("relevance"), F.desc("confidence"), F.desc("updated_at"), F.asc("id")]


def prefix_batch(rows: DataFrame, partition: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows up to the first that would overflow the budget; the first row always counts."""
    w = W.partitionBy(partition).orderBy(order)
    total, place = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)), F.row_number().over(w)
    return rows.withColumns({"_t": total, "_n": place}).where((F.col("_t") <= budget) | (F.col("_n") == 1)).drop("_t", "_n")


def newest_suffix(rows: DataFrame, partition: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest rows that fit the budget, with the number of omitted ones before them."""
    back = W.partitionBy(partition).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_t", F.sum(size).over(back))
    omitted = F.sum(F.when(F.col("_t") > budget, 1).otherwise(0)).over(W.partitionBy(partition))
    return marked.withColumn("omitted", omitted).where(F.col("_t") <= budget).drop("_t")


def cursors(dirty: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """(key, dirty_through, summary_through): the furthest of either kind of event; a late, smaller one changes nothing."""
    a = dirty.groupBy(key).agg(F.max("seq").alias("dirty_through"))
    b = folded.groupBy(key).agg(F.max("seq").alias("summary_through"))
    return a.join(b, key, "left").withColumn("summary_through", F.coalesce("summary_through", F.lit(0)))


def due(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with turns to fold that are not dormant and whose next attempt is due."""
    return jobs.where((F.col("dirty_through") > F.col("summary_through")) & (F.col("status") != "dormant") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def backoff(attempts: Column, base: float = 2, most: float = 60) -> Column:
    """Seconds to wait after attempt n: base * 2^(n - 1), at most `most`."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(60))))


def apply_once(operations: DataFrame, receipts: DataFrame, fingerprint: list[str], order: str) -> DataFrame:
    """Operations without a receipt, once each, with their fingerprint: replay changes nothing."""
    mark = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(fingerprint)])), 256)
    place = F.row_number().over(W.partitionBy("fingerprint").orderBy(order))
    fresh = operations.withColumn("fingerprint", mark).join(receipts.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return fresh.withColumn("_n", place).where("_n = 1").drop("_n")


def history_scores(messages: DataFrame, query: Column, tokens: str = "tokens") -> DataFrame:
    """Per message the largest of its lexical (2 + 1/rank), substring (1 + overlap) and overlap scores."""
    share = overlap_ratio(query, F.col(tokens))
    lexical = F.when(F.col("position").isNotNull(), 2 + 1.0 / F.col("position")).otherwise(0.0)
    like = F.when(F.col("contained"), 1 + share).otherwise(0.0)
    return messages.withColumn("score", F.round(F.greatest(lexical, like, share), 6))
