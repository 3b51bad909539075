"""Sinks by bucket: results of many batches, replays and interrupted batches, and which files a batch touches."""

import random
from pathlib import Path

from marlpit.streaming import windows

SCHEMA = "k int, name string, v int, text string"


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def buckets(changed):
    return {p.split("bucket=")[1].split("/")[0] for p in changed}


def batches():
    rng = random.Random(2)
    return [[(rng.randint(0, 40), "x", rng.randint(0, 9), f"{b}-{i}") for i in range(rng.randint(1, 12))] for b in range(8)]


def test_upserts_touch_their_buckets(spark, tmp_path):
    path, newest = str(tmp_path / "t"), {}
    write = windows.bucket_upsert_sink(path, ["k", "name"], "v", 16)
    for n, rows in enumerate(batches()):
        rows = list({(r[0], r[2]): r for r in rows}.values())  # a batch has no ties
        before = files(path)
        write(spark.createDataFrame(rows, SCHEMA), n)
        after = files(path)
        touched = buckets({p for p in after if before.get(p) != after[p]} | {p for p in before if p not in after})
        assert len(touched) <= len({r[0] for r in rows})
        for r in sorted(rows, key=lambda r: r[2]):
            if r[0] not in newest or newest[r[0]][2] <= r[2]:
                newest[r[0]] = r
        write(spark.createDataFrame(rows, SCHEMA), n)  # a replay
        got = spark.read.parquet(path).drop("bucket").collect()
        assert sorted(map(tuple, got)) == sorted(newest.values())
    write(spark.createDataFrame([], SCHEMA), 99)
    assert len(spark.read.parquet(path).collect()) == len(newest)


def test_outbox_delivers_once(spark, tmp_path):
    path, sent = str(tmp_path / "t"), {}
    write = windows.bucket_outbox_sink(path, ["k"], 16)
    for n, rows in enumerate(batches()):
        rows = list({r[0]: r for r in rows}.values())
        for _ in range(2):  # each batch is replayed
            write(spark.createDataFrame(rows, SCHEMA), n)
        for r in rows:
            sent.setdefault(r[0], (n, r))
        got = spark.read.parquet(path).collect()
        assert sorted((r.batch, (r.k, r.name, r.v, r.text)) for r in got) == sorted(sent.values())


def test_a_stream_into_buckets(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n, rows in enumerate(batches()[:3]):
        spark.createDataFrame([(*r[:2], n * 10 + r[2], r[3]) for r in {r[0]: r for r in rows}.values()], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        windows.run_once(windows.read_stream(spark, source, SCHEMA), mark, windows.bucket_upsert_sink(path, ["k"], "v", 8))
    want = {}
    for n, rows in enumerate(batches()[:3]):
        for r in {r[0]: r for r in rows}.values():
            want[r[0]] = r[3]
    assert {r.k: r.text for r in spark.read.parquet(path).collect()} == want
