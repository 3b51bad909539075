"""The jobs over growing copies of their input: only what is new is taken, reruns change nothing, and a run that was cut short is mended."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import digest_conversations, index_documents
from marlpit.operators import index

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def postings(spark, path):
    return sorted(map(tuple, index.live_postings(spark, path).collect()))


def add(frame, folder):
    frame.coalesce(1).write.mode("append").parquet(str(folder))


def test_index_grows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    folder, to, mark, whole = (str(tmp_path / x) for x in ("in", "index", "mark", "whole"))
    first = docs.where("doc_id % 4 <> 0")
    add(first, folder)
    assert index_documents.run(spark, folder, to, mark) == {"batches": 1, "rows": first.count()}
    before = files(to)
    assert index_documents.run(spark, folder, to, mark) == {"batches": 0, "rows": 0} and files(to) == before
    # the rest, some that are there already, one with another text and one that goes
    more = docs.where("doc_id % 4 = 0 OR doc_id < 20").withColumn("text", F.when(F.col("doc_id") == 1, "quite another text").when(F.col("doc_id") != 2, F.col("text")))
    add(more, folder)
    assert index_documents.run(spark, folder, to, mark) == {"batches": 1, "rows": more.count()}
    assert {k: v for k, v in files(to).items() if k in before} == before
    now = docs.withColumn("text", F.when(F.col("doc_id") == 1, "quite another text").otherwise(F.col("text"))).where("doc_id <> 2")
    index.append(now, whole, 0, "doc_id", {"text": 1.0})
    assert postings(spark, to) == postings(spark, whole) and index.check(spark, to).count() == 0
    brought = {r.batch: r.documents for r in index.manifest(spark, to).collect()}
    assert brought[1] == docs.where("doc_id % 4 = 0").count() + 2


def test_index_batch_that_was_cut_short(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    folder, to, mark, whole = (str(tmp_path / x) for x in ("in", "index", "mark", "whole"))
    add(docs.where("doc_id < 30"), folder)
    index_documents.run(spark, folder, to, mark)
    add(docs.where("doc_id >= 30"), folder)
    real = index._write
    monkeypatch.setattr(index, "_write", lambda df, path, by: real(df, path, by) if not path.endswith("versions") else 1 / 0)
    with pytest.raises(Exception):  # noqa: B017
        index_documents.run(spark, folder, to, mark)
    monkeypatch.setattr(index, "_write", real)
    assert index.live(spark, to).count() == 30
    assert index_documents.run(spark, folder, to, mark)["batches"] == 1
    index.append(docs, whole, 0, "doc_id", {"text": 1.0})
    assert postings(spark, to) == postings(spark, whole) and index.check(spark, to).count() == 0


def digest_rows(spark, path):
    return sorted(map(repr, digest_conversations.read(spark, path).collect()))


def test_digest_grows(spark, tmp_path):
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    folder, to, whole = (str(tmp_path / x) for x in ("in", "digest", "whole"))
    add(talks.where("turn < 3"), folder)
    took = digest_conversations.run(spark, folder, to)
    assert took["changed"] == took["conversations"] > 0
    before = files(to)
    assert digest_conversations.run(spark, folder, to) == {"conversations": took["conversations"], "changed": 0, "buckets": 0} and files(to) == before
    # further turns of some conversations
    add(talks.where("turn >= 3 AND conv_id % 16 IN (2, 5)"), folder)
    second = digest_conversations.run(spark, folder, to)
    assert second["buckets"] == 2 and 0 < second["changed"] < took["conversations"]
    after = files(to)
    touched = lambda k: k.startswith(("bucket=2/", "bucket=5/"))
    assert {k: v for k, v in after.items() if not touched(k)} == {k: v for k, v in before.items() if not touched(k)}
    digest_conversations.run(spark, folder, whole)
    assert digest_rows(spark, to) == digest_rows(spark, whole)
    for p in Path(to, "bucket=5").iterdir():  # what a run that was cut short may leave out
        p.unlink()
    assert digest_conversations.run(spark, folder, to)["buckets"] == 1 and digest_rows(spark, to) == digest_rows(spark, whole)


def test_digest_of_odd_turns(spark, tmp_path):
    rows = [
        (1, 0, "assistant", "before"), (1, 1, "user", "What is this?"), (1, 2, "tool", "x"), (1, 3, "assistant", "an answer"), (1, 4, "user", None), (1, 5, "user", "thanks"), (1, 5, "user", "thanks"),
        (1, 2000, "user", "far"), (1, 5000, "assistant", "late"), (2, 1, "assistant", "alone"), (None, 1, "user", "x"), (3, None, "user", "x"), (4, 1, None, "x"), (-1, 1, "user", "minus"),
    ]
    spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("episode", F.lit("clash")).write.parquet(str(tmp_path / "in"))
    assert digest_conversations.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"buckets": 4}) == {"conversations": 2, "changed": 2, "buckets": 2}
    got = digest_conversations.read(spark, str(tmp_path / "out")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.episode, r.answered, r.answer_chars, r.turns, r.last_turn) for r in got] == [(-1, 1, 1, False, 0, 1, 1), (1, 1, 1, True, 9, 8, 5000), (1, 4, 2, False, 0, 8, 5000), (1, 5, 3, False, 0, 8, 5000), (1, 2000, 4, True, 4, 8, 5000)]
    with pytest.raises(ValueError):
        digest_conversations.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), {"bucket": 4})


@pytest.mark.parametrize(("name", "args"), [
    ("index_documents", ["--documents", f"{SF}/documents.parquet", "--index", "{0}/index", "--checkpoint", "{0}/mark"]),
    ("digest_conversations", ["--conversations", f"{SF}/conversations.parquet", "--digest", "{0}/digest"]),
])
def test_command_lines(name, args, tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *[a.format(tmp_path) for a in args]], cwd=ROOT, env=env, capture_output=True, text=True, timeout=240, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"{tmp_path}" in done.stderr and files(tmp_path)
