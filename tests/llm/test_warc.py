from __future__ import annotations

import io

import zstandard

from chronoform.llm import warc
from chronoform.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip(spark):
    rows = [(1, "http://a/é x", "same", "z"), (2, None, "same", None), (3, "u", None, ""), (4, "u", "", ""), (5, "u", "only ünï", ""), (5, "u", "only ünï", ""), (6, "u", "x" * 300_000, ""), (None, "u", "same", "")]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, SCHEMA), path, archive_bytes=1000)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, path).collect()}
    assert got == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 10), (6, "response", None, 300_000), (None, "revisit", 2, 4)}
    assert warc.read(spark, path).count() == len(rows)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read(spark, path).where("payload is not null").collect()}
    assert payloads[6] == "x" * 300_000 and payloads[5] == "only ünï"


def test_archives_are_zstd_files_with_a_leading_dictionary(spark):
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} of many, all much alike {i * 7}</body></html>" * 5) for i in range(300)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, archive_bytes=20_000)
    found = warc.archives(spark, path).collect()
    assert len(found) > 1
    for archive in found:
        content = bytes(archive.content)
        assert content[:4] == warc.SKIPPABLE.to_bytes(4, "little")
        size = int.from_bytes(content[4:8], "little")
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
        text = tool.stream_reader(io.BytesIO(content[8 + size :]), read_across_frames=True).read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") == archive.n_records + 1


def test_files_hold_the_same_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"page {i} " * 40) for i in range(200)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path, archive_bytes=5_000)
    done = {r.archive: r.bytes for r in warc.export(spark, path, f"file://{tmp_path}/out").collect()}
    assert {f.name: f.stat().st_size for f in (tmp_path / "out").iterdir() if not f.name.endswith(".crc")} == {f"{k}.warc.zst": n for k, n in done.items()}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"file://{tmp_path}/out")
    columns = ["page_id", "url", "payload_digest", "record_type", "refers_to", "payload"]
    assert sorted(warc.unpacked(files).select(columns).collect(), key=str) == sorted(warc.read(spark, path).select(columns).collect(), key=str)


def test_without_broadcasts_and_payload_shuffles(spark):
    rows = [(i, "u", "hot" if i % 2 else f"text {i // 4}") for i in range(3000)] + [(None, "u", "hot"), (9000, "u", None), (9001, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    shown = lambda d: sorted(((r.page_id, r.refers_to, r.revisit) for r in d.collect()), key=str)
    assert shown(warc.classified(df)) == shown(warc.classified(df, max_broadcast_rows=0))
    assert "Exchange hashpartitioning" not in warc.classified(df)._jdf.queryExecution().executedPlan().toString()


def test_minimum_size_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.revisit) for r in warc.classified(rows, min_bytes=3).collect())
    assert got == [(1, False), (2, False), (3, True), (4, False)]
    path = new_path(spark, "warc")
    warc.write(rows.where("false"), path)
    assert warc.read(spark, path).count() == 0

def test_ids_beyond_the_whole_numbers_of_doubles(spark, tmp_path):
    """Equal payloads with ids around 2^60 and a null id, in one partition: each id comes back as it was."""
    big = 2**60
    for extra in ([], [(None, "u", "same")]):
        rows = [(big + 1, "u", "same"), (big + 3, "u", "same"), (big + 7, "v", "other"), *extra]
        path = f"file://{tmp_path}/{len(extra)}"
        warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
        got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=str)
        assert got == sorted([(big + 1, "revisit", big + 3), (big + 3, "response", None), (big + 7, "response", None), *[(None, "revisit", big + 3)] * len(extra)], key=str)
