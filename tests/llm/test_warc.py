from marlpit.llm.warc import Bundle, base32_sha1, export_files, fetch, frame_of, parse, read_bundles, record, seek_table, write_bundles

ROWS = [(1, "http://a/\r\nX: y", "same", "z"), (2, None, "same", "z"), (2, "http://b", "same", "z"), (3, "http://c", None, "z"), (4, "http://d", "", "z"), (5, "http://e", "é" * 400_000, "z"), (None, "http://f", "same", "z"), (None, "http://g", "alone", "z"), (1, "http://h", "same", "z")]


def test_bundle_is_seekable_and_round_trips():
    b = Bundle(100)
    made = [record(i, f"http://x/{i}", b"p" * i, None) for i in range(40)]
    for name, data in made:
        b.add(name, data)
    content, at = b.finish(), {e["record_id"]: e for e in b.index}
    frames = seek_table(content)
    assert len(frames) > 10
    for name, data in made:
        e = at[name]
        assert frame_of(content, frames[e["frame"]])[e["offset"] : e["offset"] + e["length"]] == data
        assert parse(data, 0)[2] == len(data)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole == b"".join(d for _, d in made)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/t"
    write_bundles(pages, path, frame_bytes=200, bundle_bytes=300)
    rows = read_bundles(spark, path).collect()
    got = sorted((r.page or "null", r.digest, r.record_type, r.refers_to or "") for r in rows)
    assert len({r.record_id for r in rows}) == len(rows) and all(r.payload_bytes == len((h or "").encode()) for r in rows for _, _, h, _ in ROWS if base32_sha1((h or "").encode()) == r.digest)
    d = lambda s: base32_sha1(s.encode())
    want = [("1", d("same"), "response", "")] * 2 + [("2", d("same"), "revisit", "1")] * 2 + [("3", d(""), "response", ""), ("4", d(""), "revisit", "3"), ("5", d("é" * 400_000), "response", ""), ("null", d("same"), "revisit", "1"), ("null", d("alone"), "response", "")]
    assert got == sorted(want)
    assert {r.page: bytes(r.payload).decode() for r in read_bundles(spark, path).where("record_type = 'response'").collect()}["5"] == "é" * 400_000
    ids = spark.createDataFrame([(f"urn:page:5:{d('é' * 400_000)}",), (f"urn:page:4:{d('')}",)], "record_id string")
    assert {r.record_id.split(":")[2]: parse(bytes(r.data), 0)[0]["WARC-Type"] for r in fetch(spark, path, ids).collect()} == {"5": "response", "4": "revisit"}
    export_files(spark, path, f"{tmp_path}/files")
    assert list((tmp_path / "files").glob("*.warc.zst"))
    write_bundles(pages, f"{path}2", least_bytes=5)
    assert spark.read.parquet(f"{path}2").count() and read_bundles(spark, f"{path}2").where("record_type = 'revisit'").count() == 0
    write_bundles(pages.limit(0), f"{path}3")
    assert read_bundles(spark, f"{path}3").count() == 0


def test_keys_of_any_text(spark, tmp_path):
    keys = ["a:b", "k\r\nX: y", "null", None, "*", "%2A", "", "é/ü?", "a"]
    pages = spark.createDataFrame([(k, "http://u", f"page {i % 3}") for i, k in enumerate(keys)], "page_id string, url string, html string")
    write_bundles(pages, f"file://{tmp_path}/t")
    rows = read_bundles(spark, f"file://{tmp_path}/t").collect()
    assert sorted(map(repr, (r.page for r in rows))) == sorted(map(repr, keys)) and len({r.record_id for r in rows}) == len(keys)
    least = {p: min(k for i, k in enumerate(keys) if i % 3 == p and k is not None) for p in range(3)}
    for r in rows:
        first = least[keys.index(r.page) % 3]
        assert (r.refers_to, r.record_type) == ((None, "response") if r.page == first else (first, "revisit"))


def test_one_payload_in_most_rows(spark, tmp_path):
    pages = spark.range(4000).selectExpr("id AS page_id", "'http://u' AS url", "CASE WHEN id % 4 > 0 THEN NULL ELSE concat('p', id) END AS html")
    write_bundles(pages, f"file://{tmp_path}/t")
    rows = read_bundles(spark, f"file://{tmp_path}/t", payloads=False)
    assert rows.where("refers_to = '1' AND record_type = 'revisit' AND payload_bytes = 0").count() == 2999 and rows.where("record_type = 'response'").count() == 1001
