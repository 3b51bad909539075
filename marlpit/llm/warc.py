"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about `frame_bytes`, each compressed on its own; a bundle is a run of frames and a
skippable frame with the seek table (compressed and full size of every frame). The index maps a record's id to
(bundle, frame, offset in the frame, length), so one record is read by decompressing one frame. Bundles are rows of a
table with their exact bytes in `content`, so any store that Spark writes to can hold them; export_files() writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, setting, shared_dir, slices, store, table

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: Stands for a null key in record ids; a key's own star is encoded.
NO_KEY = "*"
INDEX = "array<struct<record_id:string,frame:int,offset:long,length:long>>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, digest: str, copy: str = "") -> str:
    """An id from the percent-encoded key and the payload's digest; copy tells apart rows that have both in common."""
    return f"urn:page:{NO_KEY if page is None else quote(str(page), safe='')}:{digest}{copy and ':'}{copy}"


def page_of(name: str) -> str | None:
    key = name.split(":")[2]
    return None if key == NO_KEY else unquote(key)


def _clean(value: str) -> str:
    return "".join(c if c > "\x20" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: object, url: str | None, payload: bytes, first: object, copy: str = "") -> tuple[str, bytes]:
    """(id, bytes) of a record; a revisit of page `first` unless that is None. Its HTTP head has the full payload's length either way."""
    digest = base32_sha1(payload)
    name = record_id(page, digest, copy)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url or '') or name}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: <{record_id(first, digest)}>", f"WARC-Profile: {PROFILE}"]
    block = HTTP % len(payload) + (payload if first is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no record at this offset")
    head = dict(x.split(": ", 1) for x in lines)
    end = stop + 4 + int(head["Content-Length"])
    return head, data[stop + 4 : end], end + 4


class Bundle:
    """Builds one bundle; index entries are made as records come."""

    def __init__(self, frame_bytes: int, level: int = 3):
        import zstandard

        self._zstd, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.content, self.frame, self.sizes, self.index = bytearray(), bytearray(), [], []

    def add(self, name: str, data: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.sizes), "offset": len(self.frame), "length": len(data)})
        self.frame += data
        if len(self.frame) >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self._zstd.compress(bytes(self.frame))
            self.sizes.append((len(packed), len(self.frame)))
            self.content += packed
            self.frame.clear()

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.content += struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.content)


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, full size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, full in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, packed, full))
        at += packed
    return out


def frame_of(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, full = entry
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=full)


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(k, digest, first, copies), a stored table of narrow rows: keys whose payload a smaller key has too, with the smallest; and those that
    have one payload in several rows (copies > 1; first is null if theirs is the smallest key).
    """
    body = F.coalesce(payload, F.lit(""))
    narrow = pages.select(F.col(key).alias("k"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("n"))
    narrow = store(narrow.groupBy("k", "digest", "n").agg(F.count("*").alias("copies")), "keys")
    firsts = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("keys")).where("keys > 1 AND first IS NOT NULL")
    firsts = store(firsts.select(F.col("digest").alias("of"), "first"), "firsts")  # a plain table, so that the keys of a hot payload can be split
    found = narrow.join(firsts, F.col("digest") == F.col("of"), "left").withColumn("first", F.when(~F.col("k").eqNullSafe(F.col("first")), F.col("first")))
    out = store(found.where("first IS NOT NULL OR copies > 1").select("k", "digest", "first", "copies"), "revisits")
    for t in (narrow, firsts):
        discard(t)
    return out


def write_bundles(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes a record for each row to a table of bundles at `path`: bundle, content, index.

    Null payloads are empty. Of rows with equal payloads of at least `least_bytes` bytes, those with the smallest key
    are responses (several if that key is repeated) and the others revisit it; a null key counts as larger than any
    other, and payloads that only null keys have are all responses. Rows with key and payload in common get record ids with
    an ending of their own, while a revisit names the id without one. Keys may be of any type and hold any character. An empty
    table gives no bundle. Other columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    known = revisits(pages, key, payload, least_bytes)
    digest = F.sha1(F.encode("payload", "UTF-8"))
    rows = rows.join(known, F.col("page").eqNullSafe(F.col("k")) & (digest == F.col("digest")), "left").select("page", "url", "payload", F.col("first").cast(kind), F.coalesce("copies", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, seen, bundle = TaskContext.get().partitionId(), 0, 0, Bundle(frame_bytes)

        def row() -> pa.RecordBatch:
            content = bundle.finish()
            index = pa.array([bundle.index], pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.zst"]), pa.array([content], pa.binary()), index], ["bundle", "content", "index"])

        for batch in slices(batches):
            payloads = batch.column(2).cast(pa.binary())
            for i, (page, address, first, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                seen += copies > 1
                bundle.add(*record(page, address, payloads[i].as_py(), first, f"{task}-{seen}" if copies > 1 else ""))
                if len(bundle.content) >= bundle_bytes:
                    yield row()
                    n, bundle = n + 1, Bundle(frame_bytes)
        if bundle.index:
            yield row()

    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        out = rows.mapInArrow(run, f"bundle string, content binary, index {INDEX}")
        # few rows to a row group: readers hold a group's bundles at once
        out.write.option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.row.count.limit", "2").parquet(path)
    discard(known)


def read_bundles(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of a table of bundles: record_id, page, digest, record_type, refers_to (a page), target, payload_bytes (of the full payload), and payload (null for revisits).

    Goes from frame to frame by the seek table and stops with an error where a response's payload doesn't have its digest or length.
    A null key reads back as null, an empty payload as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page", "digest", "record_type", "refers_to", "target", "payload_bytes", *(["payload"] if payloads else [])]
        types = [*[pa.string()] * 6, pa.int64(), *([pa.binary()] if payloads else [])]
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(0)[i].as_py()
                for entry in seek_table(content):
                    data, at, out = frame_of(content, entry), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        name, kind, digest = head["WARC-Record-ID"][1:-1], head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                        stop = block.index(b"\r\n\r\n")
                        body, size = block[stop + 4 :], int(block[block.index(b"Content-Length: ") + 16 : stop])
                        if kind == "response" and (base32_sha1(body) != digest or len(body) != size):
                            raise ValueError(f"{name}: the payload doesn't have its digest")
                        first = head.get("WARC-Refers-To", "")[1:-1]
                        out.append((name, page_of(name), digest, kind, page_of(first) if first else None, head["WARC-Target-URI"], size, *([body if kind == "response" else None] if payloads else [])))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = "record_id string, page string, digest string, record_type string, refers_to string, target string, payload_bytes long" + (", payload binary" if payloads else "")
    return spark.read.parquet(path).select("content").mapInArrow(run, schema)


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """record_id and data (the record's bytes) for the ids asked for, by the index: one frame is decompressed for each.

    Ids that are null, repeated or in no bundle give no row of their own; ids without any give an empty table. Only bundles that hold a
    wanted record are opened; they are found by a join whose small side Spark broadcasts by its size on disk.
    """
    hits = spark.read.parquet(path).select("bundle", F.explode("index").alias("e")).select("bundle", "e.*").join(ids.select("record_id").distinct(), "record_id")
    wanted = hits.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("wanted"))  # a bundle's records at most
    wanted = store(wanted, "wanted")
    both = spark.read.parquet(path).select("bundle", "content").join(wanted, "bundle").select("content", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                frames = seek_table(r["content"])
                found = [(w["record_id"], frame_of(r["content"], frames[w["frame"]])[w["offset"] : w["offset"] + w["length"]]) for w in r["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.binary())], ["record_id", "data"])

    return both.mapInArrow(run, "record_id string, data binary")


def export_files(spark: SparkSession, path: str, folder: str) -> None:
    """Writes the bundles, with the bytes they have, as .warc.zst files to a folder that all executors mount. An empty table gives an empty folder."""

    def save(rows) -> None:
        for r in rows:
            Path(folder, r.bundle).write_bytes(r.content)

    Path(folder).mkdir(parents=True, exist_ok=True)
    spark.read.parquet(path).select("bundle", "content").foreachPartition(save)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(table(spark, sf_dir, "pages"), path)
    records = read_bundles(spark, path, payloads=False)
    return records.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS hex FROM p),
b AS (
  SELECT page_id, n, hex,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      (('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INTEGER), 10))::BIGINT >> CAST(5 * (7 - i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS digest,
    min(page_id) OVER (PARTITION BY hex) AS first
  FROM h
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
