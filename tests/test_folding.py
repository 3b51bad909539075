"""Debounced folds: batch against a loop, and a stream in several batches and after a restart against a clock that ticks through all events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marlpit.streaming import folding, windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "conv_id int, at timestamp, kind string"


def moment(s):
    return START + dt.timedelta(seconds=s)


def simulate(rows, quiet, end):
    """Folds by a clock of whole and half seconds."""
    out = []
    for conv in {c for c, *_ in rows}:
        mine = sorted(((t, folding.KINDS.index(k) if k in folding.KINDS else 9, k) for c, t, k in rows if c == conv), reverse=True)
        dirty, due, gate, attempts = 0, None, 0, 0
        for half in range(int(end * 2) + 1):
            now = half / 2
            if due is not None and due <= now:
                out.append((conv, moment(due), dirty, attempts + 1))
                due = None
            while mine and mine[-1][0] <= now:
                t, _, kind = mine.pop()
                if kind == "turn":
                    dirty += 1
                    due = max(t + quiet, gate)
                elif kind == "foreground" and due is not None:
                    due = max(due, t + quiet)
                elif kind == "failed":
                    attempts += 1
                    gate = t + min(60, 2 * 2 ** (attempts - 1))
                    due = max(due or 0, gate)
                elif kind == "done":
                    attempts = gate = 0
    return sorted(out)


def test_stream_equals_clock(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.randint(1, 5), rng.randint(0, 800) / 2, rng.choices(["turn", "foreground", "failed", "done", "other"], [6, 3, 2, 1, 1])[0]) for _ in range(250)]
    rows = sorted(set(rows), key=lambda r: r[1])
    want = simulate(rows, 5, 700)
    assert any(r[3] > 2 for r in want) and len(want) > 40
    source, sink, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    write = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    cuts = [rows[i : i + 60] for i in range(0, len(rows), 60)] + [[(99, 699.0, "other")], [(99, 700.0, "other")]]
    for part in cuts:
        rng.shuffle(part)  # order within a batch doesn't matter
        write([(c, moment(t), k) for c, t, k in part] + [(None, moment(1), "turn"), (3, None, "turn")])
        folds = folding.fold_queue(windows.read_stream(spark, source, SCHEMA), 5, "0 seconds")
        windows.to_table(folds, sink, mark)  # each call is a restart
    got = spark.read.parquet(sink).collect()
    assert sorted((r.conv_id, r.fold_at, r.through, r.attempt) for r in got) == want


def test_debounced_equals_stream_rule(spark):
    rng = random.Random(12)
    rows = sorted({(rng.randint(1, 6), rng.randint(0, 400_000), rng.choice(["turn", "foreground"])) for _ in range(400)})
    want = [r[:3] for r in simulate([(c, float(t), k) for c, t, k in rows], 1800, 410_000)]
    frame = spark.createDataFrame([(c, moment(t), k == "turn") for c, t, k in rows] + [(None, moment(3), True), (1, None, True)], "conv_id int, at timestamp, dirty boolean")
    got = folding.debounced(frame, 1800)
    # a clock's fold that only a mark deferred is due with its session's end
    assert sorted((r.conv_id, r.fold_at, r.through) for r in got.collect()) == want
    assert folding.debounced(frame.limit(0), 5).count() == 0


def test_retries(spark):
    rows = [(1, 0, True), (1, 10, True), (1, 20, False), (1, 30, True), (2, 5, False), *[(3, i, True) for i in range(9)]]
    got = folding.retries(spark.createDataFrame([(c, moment(t), f) for c, t, f in rows], "conv_id int, at timestamp, failed boolean"))
    found = sorted((r.conv_id, int((r.at - START).total_seconds()), r.attempt, (r.next_attempt_at - r.at).total_seconds()) for r in got.collect())
    assert found == [(1, 0, 1, 2.0), (1, 10, 2, 4.0), (1, 30, 1, 2.0), *[(3, i, i + 1, float(min(60, 2 ** (i + 1)))) for i in range(9)]]
    assert got.where(F.col("attempt") < 1).count() == 0
