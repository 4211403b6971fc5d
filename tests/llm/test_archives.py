"""Archives as files: members, lengths, and what other tools write."""

import glob
import gzip
import hashlib
import zlib

from demoflux.llm import warc

PAGES = [(i, f"http://h/{i}", "<p>WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n</p>" * (i % 7) + "é" * i) for i in range(60)]
PAGES += [(100, "u", PAGES[20][2]), (101, None, PAGES[20][2]), (102, "a\r\nWARC-Type: x", None), (103, "u", "\0\n\0"), (100, "u", PAGES[20][2])]
SCHEMA = "page_id bigint, url string, html string"


def members_of(data):
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data)
        assert unpack.eof
        data = unpack.unused_data


def test_every_record_is_a_member(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(PAGES, SCHEMA), path)
    found = []
    for name in glob.glob(f"{path}/part-*"):
        data = open(name, "rb").read()
        records = list(members_of(data))
        assert gzip.decompress(data) == b"".join(records)
        for number, record in enumerate(records):
            fields, block = warc.parsed(record)
            assert record.endswith(block + b"\r\n\r\n") and len(block) == int(fields["content-length"])
            assert (fields["warc-type"] == "warcinfo") == (number == 0)
            if number:
                found.append((int(fields["page-id"]), fields["warc-type"], fields.get("warc-refers-to")))
    assert sorted(i for i, _, _ in found) == sorted(i for i, _, _ in PAGES)
    original = next(i for i, _, html in PAGES if html == PAGES[20][2])
    assert {kind for i, kind, _ in found if i in (100, 101)} == {"revisit"} and original == 20
    read = warc.read_archives(spark, path).collect()
    bodies = {i: (html or "").encode() for i, _, html in PAGES}
    assert len(read) == len(PAGES)
    assert all(bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else bodies[r["page_id"]]) for r in read)


def test_long_records_are_several_members():
    record = bytes(range(256)) * 40
    data = warc.packed(record, piece=1000)
    assert data.count(warc.HEADER) == 1 and len(list(members_of(data))) == 11
    assert warc.unpacked(data) == gzip.decompress(data) == record
    assert warc.packed(b"x" * warc.PIECE)[-1:] == b"\0" and warc.packed(b"")[-1:] == b""


def test_splits_do_not_cut_records(spark, tmp_path):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(500)]
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        read = warc.read_archives(spark, path)
        assert read.rdd.getNumPartitions() > 10
        assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.collect()} == {i: html for i, _, html in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def other_record(kind, content, block):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\nWARC-Target-URI: http://x/WARC/1.0\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_other_tools_are_read(spark, tmp_path):
    tricky = b"a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nzWARC/1."
    page = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + tricky
    parts = [other_record("warcinfo", "application/warc-fields", b"software: x\r\n"), other_record("response", "application/http; msgtype=response", page),
             other_record("resource", "text/plain", tricky), other_record("resource", "image/png", b"\xff\0\x80"), other_record("response", "application/http", b"")]
    for name, data in (("one.warc.gz", gzip.compress(b"".join(parts))), ("many.warc.gz", b"".join(gzip.compress(p) for p in parts))):
        (tmp_path / name).write_bytes(data)
        read = warc.read_gzip_archives(spark, str(tmp_path / name)).collect()
        assert [(r["record_type"], bytes(r["payload"])) for r in read] == [
            ("response", tricky), ("resource", tricky), ("resource", b"\xff\0\x80"), ("response", b"")]
        assert {r["url"] for r in read} == {"http://x/WARC/1.0"} and {r["page_id"] for r in read} == {None}
