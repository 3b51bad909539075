"""When to fold a conversation into its summary: once it has been quiet for a while, not while its user is at it, and again after failures, ever later.

`debounced` and `retries` say it for events that are all there; `fold_queue` says it on a stream, with timers in state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import spans
from ..operators.memory import backoff

#: Events of a conversation within a day are one task's at a time.
DAY = 86_400_000_000
KINDS = ["done", "failed", "turn", "foreground"]


def debounced(events: DataFrame, quiet: float, conversation: str = "conv_id", at: str = "at", dirty: str = "dirty") -> DataFrame:
    """(conversation, fold_at, through, coalesced): one fold for all turns that came without `quiet` seconds between events.

    `dirty` tells turns from events that only defer a fold. A fold is due `quiet` seconds after the last event, also if the next comes at that
    moment; through counts the conversation's turns up to it, coalesced those since the fold before. Without a turn there is none. Null conversations and times
    give nothing. A conversation's events are split into days, so that a long one is many tasks' work.
    """
    gap = int(quiet * 1_000_000)
    kept = events.where(F.col(conversation).isNotNull() & F.col(at).isNotNull())
    kept = kept.select(F.col(conversation).alias("c"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.coalesce(F.col(dirty), F.lit(False)).cast("long").alias("d"))
    kept = spans.beside(kept, ["c"], "t", F.col("t"), "before", ahead=False, width=DAY)
    opens = (F.col("before").isNull() | (F.col("t") - F.col("before") >= gap)).cast("long")
    kept = spans.running(kept, ["c"], "t", opens, "session", width=DAY)
    sessions = kept.groupBy("c", "session").agg(F.max("t").alias("last"), F.sum("d").alias("coalesced")).where("coalesced > 0")
    total = spans.running(sessions, ["c"], "session", F.col("coalesced"), "through")
    return total.select(F.col("c").alias(conversation), F.timestamp_micros(F.col("last") + gap).alias("fold_at"), "through", "coalesced")


def retries(outcomes: DataFrame, conversation: str = "conv_id", at: str = "at", failed: str = "failed", order: str | None = None, base: float = 2, most: float = 60) -> DataFrame:
    """(conversation, at, attempt, next_attempt_at) of failures: the attempts since the last success, and when the next is allowed. `order` breaks ties of time."""
    w = W.partitionBy(conversation).orderBy(at, *([order] if order else []))
    run = F.sum((~F.col(failed)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    counted = outcomes.withColumn("_run", run).where(failed)
    attempt = F.row_number().over(W.partitionBy(conversation, "_run").orderBy(at, *([order] if order else [])))
    wait = (backoff(F.col("attempt"), base, most) * 1_000_000).cast("long")
    return counted.withColumn("attempt", attempt).select(conversation, at, "attempt", F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + wait).alias("next_attempt_at"))


class Timer:
    """A conversation's fold: what is asked for, when, and how often it failed. Times in microseconds."""

    __slots__ = ("attempts", "dirty", "due", "folded", "gate", "quiet")

    def __init__(self, quiet: int, dirty: int = 0, folded: int = 0, due: int = -1, gate: int = 0, attempts: int = 0):
        self.quiet, self.dirty, self.folded, self.due, self.gate, self.attempts = quiet, dirty, folded, due, gate, attempts

    def state(self) -> tuple[int, int, int, int, int]:
        return self.dirty, self.folded, self.due, self.gate, self.attempts

    def fire(self, now: int) -> Iterator[tuple[int, int, int]]:
        """The fold that is due by now: (due, through, attempt)."""
        if 0 <= self.due <= now:
            yield self.due, self.dirty, self.attempts + 1
            self.folded, self.due = self.dirty, -1

    def take(self, t: int, kind: str) -> None:
        if kind == "turn":
            self.dirty += 1
            self.due = max(t + self.quiet, self.gate)
        elif kind == "foreground" and self.due >= 0:
            self.due = max(self.due, t + self.quiet)
        elif kind == "failed":
            self.attempts += 1
            self.gate = t + int(min(60.0, 2.0 * 2 ** min(self.attempts - 1, 60)) * 1_000_000)
            self.due = max(self.due, self.gate)
        elif kind == "done":
            self.attempts = self.gate = 0


def fold_queue(events: DataFrame, quiet: float, late: str = "10 seconds", conversation: str = "conv_id", at: str = "at", kind: str = "kind") -> DataFrame:
    """(conversation, fold_at, through, attempt): folds as they come due on a stream of events.

    Kinds: `turn` makes a conversation dirty; `foreground` puts a fold off; `failed` brings the last one back after memory.backoff() seconds, and `done`
    ends the count of attempts. Other kinds only let time pass. A fold comes out once the watermark (`late` behind the newest event of all
    conversations) passes its time, or before an event at or after it. State is five numbers a conversation; a restarted stream goes on with it. Events without a
    conversation or time give nothing, and those later than `late` are left out.
    """
    pause = int(quiet * 1_000_000)
    name = events.schema[conversation].dataType.simpleString()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        timer, out = Timer(pause, *(state.get if state.exists else ())), []
        if state.hasTimedOut:
            out += timer.fire(state.getCurrentWatermarkMs() * 1000)
        else:
            rows = sorted((int(t), KINDS.index(k) if k in KINDS else len(KINDS), k) for df in frames for t, k in zip(df["t"], df["kind"], strict=True))
            for t, _, k in rows:
                out += timer.fire(t)
                timer.take(t, k)
            out += timer.fire(state.getCurrentWatermarkMs() * 1000)
        state.update(timer.state())
        if timer.due >= 0:
            state.setTimeoutTimestamp(max(-(-timer.due // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({conversation: key[0], "fold_at": pd.to_datetime([d for d, _, _ in out], unit="us", utc=True).tz_convert(None), "through": [x for _, x, _ in out], "attempt": [a for *_, a in out]})

    kept = events.where(F.col(conversation).isNotNull() & F.col(at).isNotNull()).select(F.col(conversation).alias("c"), F.col(at).cast("timestamp").alias("ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(kind).alias("kind"))
    return kept.withWatermark("ts", late).groupBy("c").applyInPandasWithState(step, f"{conversation} {name}, fold_at timestamp, through long, attempt long", "dirty long, folded long, due long, gate long, attempts long", "append", GroupStateTimeout.EventTimeTimeout)
