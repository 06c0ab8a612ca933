"""The WARC data source: round trips, predicates on headers, payloads left alone; and archived pages."""

from __future__ import annotations

import gzip
import hashlib
import os
import zlib

import pytest
from compare import TABLES, connect, differences

from evenstep.llm.queries import LLM_ORACLES, LLM_QUERIES
from evenstep.llm.warc import archived_pages, register

PAGES = "page_id long, url string, html string"


def archive(spark, folder, rows, **options):
    register(spark)
    schema = "record_id string, record_type string, target_uri string, payload binary"
    writer = spark.createDataFrame(rows, schema).coalesce(1).write.format("warc").mode("append")
    writer.options(**options).save(str(folder))
    return sorted(p for p in folder.iterdir() if p.name.endswith(".warc.gz"))


def noise(n, seed=0):
    import random

    return random.Random(seed).randbytes(n)


def test_payloads_and_headers_come_back(spark, tmp_path):
    rows = [(f"urn:r:{i}", "response", f"http://h/{i} é", noise(i * 1000, i) + b"\r\n\r\n") for i in range(20)]
    archive(spark, tmp_path / "a", rows)
    got = {r.record_id: r for r in spark.read.format("warc").load(str(tmp_path / "a")).collect()}
    assert len(got) == 20
    for record_id, kind, uri, payload in rows:
        row = got[record_id]
        assert bytes(row.payload) == payload and row.payload_bytes == len(payload) and row.record_type == kind
        assert row.payload_digest == hashlib.sha256(payload).hexdigest()
        assert row.target_uri == uri.replace(" ", "%20") and row.headers["warc-type"] == kind


def test_other_readers_can_open_it(spark, tmp_path):
    (path,) = archive(spark, tmp_path / "a", [("urn:r:1", "response", "http://h/", b"one"), ("urn:r:2", "response", "http://h/", b"two")])
    plain = gzip.decompress(path.read_bytes())
    assert plain.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\none\r\n\r\n" in plain


def test_files_are_bounded_and_become_partitions(spark, tmp_path):
    rows = [(f"urn:r:{i}", "response", "u", noise(10_000, i)) for i in range(30)]
    files = archive(spark, tmp_path / "a", rows, file_bytes=50_000)
    assert len(files) >= 5 and not (tmp_path / "a" / "_temporary" / "x").exists()
    read = spark.read.format("warc").option("partition_bytes", 120_000).load(str(tmp_path / "a"))
    assert 2 < read.rdd.getNumPartitions() < len(files)
    assert read.count() == 30


def test_predicates_are_pushed_and_right(spark, tmp_path, capsys):
    rows = [(f"urn:r:{i}", ("response", "resource", "metadata")[i % 3], f"http://h{i % 2}/{i}", b"x" * i) for i in range(30)]
    archive(spark, tmp_path / "a", rows)
    read = spark.read.format("warc").load(str(tmp_path / "a"))
    for text in (
        "record_type = 'resource'",
        "record_type in ('resource', 'metadata') and target_uri like 'http://h1/%'",
        "record_type != 'response' and target_uri like '%3'",
        "refers_to is null and target_uri > 'http://h1'",
        "not (target_uri like '%2%') and length(payload) > 5",
    ):
        frame = read.where(text)
        capsys.readouterr()
        frame.explain("formatted")
        plan = capsys.readouterr().out
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan
        plain = spark.createDataFrame([(*r, None) for r in rows], "record_id string, record_type string, target_uri string, payload binary, refers_to string")
        want = {r.record_id for r in plain.where(text).collect()}
        assert {r.record_id for r in frame.collect()} == want and want, text


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    rows = [("urn:r:0", "response", "u", b"kept"), ("urn:r:1", "resource", "u", noise(400_000)), ("urn:r:2", "response", "u", b"too")]
    (path,) = archive(spark, tmp_path / "a", rows)
    data = bytearray(path.read_bytes())
    data[200_000:200_400] = bytes(400)  # inside the payload of the second record
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "broken.warc.gz").write_bytes(data)
    read = spark.read.format("warc").load(str(tmp_path / "b"))
    assert [bytes(r.payload) for r in read.where("record_type = 'response'").collect()] == [b"kept", b"too"]
    headers = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path / "b"))
    assert [r.record_type for r in headers.collect()] == ["response", "resource", "response"]
    with pytest.raises(Exception, match="data check|rror"):
        read.where("record_type = 'resource'").collect()


def foreign(*blocks, folded=False):
    out = b""
    for i, (kind, block) in enumerate(blocks):
        extra = b"X-Note: a\r\n b\r\n" if folded else b""
        out += b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:f:%d>\r\n%sContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, extra, len(block), block)
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, packed):
    blocks = [(b"warcinfo", b"software: x\r\n"), (b"resource", noise(100_000)), (b"resource", b""), (b"resource", b"WARC/1.0\r\nnot a record")]
    if packed:  # members without a length in their header
        content, name = b"".join(gzip.compress(foreign(b)) for b in blocks), "f.warc.gz"
    else:
        content, name = foreign(*blocks, folded=True), "f.warc"
    (tmp_path / name).write_bytes(content)
    register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [bytes(r.payload) for r in got] == [b for _, b in blocks]
    assert [r.payload_bytes for r in got] == [len(b) for _, b in blocks]
    if not packed:
        assert got[0].headers["x-note"] == "a b"
    only = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'resource'").collect()
    assert [bytes(r.payload) for r in only] == [b for k, b in blocks if k == b"resource"]


def test_broken_and_empty_folders(spark, tmp_path):
    register(spark)
    assert spark.read.format("warc").load(str(tmp_path)).count() == 0
    (tmp_path / "x.warc").write_bytes(b"no archive at all\r\n\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        spark.read.format("warc").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="has no"):
        spark.createDataFrame([(1,)], "other long").write.format("warc").mode("append").save(str(tmp_path / "n"))


def test_long_headers(spark, tmp_path):
    rows = [("urn:r:0", "response", "http://h/" + "x" * 50_000, b"p"), ("urn:r:1", "response", None, b"")]
    archive(spark, tmp_path / "a", rows)
    got = spark.read.format("warc").load(str(tmp_path / "a")).collect()
    assert [(len(r.target_uri or ""), bytes(r.payload)) for r in got] == [(50_009, b"p"), (0, b"")]


def test_overwrite_and_append(spark, tmp_path):
    archive(spark, tmp_path / "a", [("urn:r:0", "response", "u", b"one")])
    archive(spark, tmp_path / "a", [("urn:r:1", "response", "u", b"two")])
    read = spark.read.format("warc").load(str(tmp_path / "a"))
    assert sorted(r.record_id for r in read.collect()) == ["urn:r:0", "urn:r:1"]
    spark.createDataFrame([("urn:r:2", b"three")], "record_id string, payload binary").write.format("warc").mode("overwrite").save(str(tmp_path / "a"))
    assert [r.record_id for r in spark.read.format("warc").load(str(tmp_path / "a")).collect()] == ["urn:r:2"]
    assert not any(files for _, _, files in os.walk(tmp_path / "a" / "_temporary"))


def test_pages_ties_nulls_and_repeats(spark):
    long, short = "ö" * 50, "x" * 99
    rows = [(5, "a", long), (3, "b\nc", long), (3, None, long), (None, "d", long), (7, "e", short), (8, "f", short), (9, "g", None), (10, "h", ""), (None, "i", "y" * 200)]
    got = archived_pages(spark.createDataFrame([(*r, "clash") for r in rows], PAGES + ", payload string")).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [
        (5, 100, digest(long), "revisit", 3),
        (3, 100, digest(long), "response", None),
        (3, 100, digest(long), "response", None),
        (None, 100, digest(long), "revisit", 3),
        (7, 99, digest(short), "response", None),
        (8, 99, digest(short), "response", None),
        (9, 0, digest(""), "response", None),
        (10, 0, digest(""), "response", None),
        (None, 200, digest("y" * 200), "response", None),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_whole_pages_equal_their_sql(spark):
    got = LLM_QUERIES["op12_warc"](spark, str(TABLES / "sf0.01")).toPandas().astype({"refers_to": "Int64"})
    assert differences(got, connect("sf0.01").execute(LLM_ORACLES["op12_warc"]).df().astype({"refers_to": "Int64"})) is None


def test_a_member_is_plain_gzip():
    from evenstep.llm.warc import _member

    content = noise(10_000) + b"a" * 10_000
    assert gzip.decompress(_member(content)) == content and zlib.decompress(_member(b""), 31) == b""
