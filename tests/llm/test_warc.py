from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricetrail.llm import warc

SCHEMA = "page_id long, url string, html string, row string, digest string"
LONG = "<p>" + "long text é中\U0001f600 " * 200_000 + "</p>"  # over the indexer's block
ROWS = [
    (1, "http://a/1", "<p>one</p>", "x", "y"),
    (2, "http://a/2", "<p>two</p>", "x", "y"),
    (3, "http://a/3", "<p>one</p>", "x", "y"),
    (4, None, None, None, None),
    (5, "http://a/5\r\nWARC-Type: resource", "", "x", "y"),
    (6, "http://a/6", LONG, "x", "y"),
    (7, "http://a/7", LONG, "x", "y"),
    (8, "http://a/8", "WARC/1.1\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n\n\n", "x", "y"),
    (None, "http://a/0", "<p>one</p>", "x", "y"),
    (None, None, "only here", "x", "y"),
    (10, "http://a/10", "same row", "x", "y"),
    (10, "http://a/10", "same row", "x", "y"),
    (10, "http://a/11", "same row", "x", "y"),
    (-3, "http://a/12", "\r\n\r\n", "x", "y"),
]


def plain(rows, least=0):
    """Type and reference of each row as a multiset: of equal payloads one row with the largest id is the response."""
    groups, out = {}, []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        if len(data) < least:
            out.append((page_id, len(data), digest, "response", None))
        else:
            groups.setdefault((len(data), digest), []).append(page_id)
    for (size, digest), ids in groups.items():
        first = max(ids, key=lambda i: (i is not None, i or 0))
        ids.remove(first)
        out.append((first, size, digest, "response", None))
        out += [(i, size, digest, "revisit", first) for i in ids]
    return sorted(out, key=str)


def written(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3, "page_id").write.parquet(f"{folder}/pages.parquet")


def run(spark, folder):
    found = warc.op13_warc(spark, str(folder)).collect()
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str)


def test_query_against_plain(spark, tmp_path):
    written(spark, ROWS, tmp_path)
    assert run(spark, tmp_path) == plain(ROWS)


def test_empty_table(spark, tmp_path):
    written(spark, [], tmp_path)
    assert run(spark, tmp_path) == []


def test_many_copies_and_hot_payload(spark, tmp_path):
    rows = [(i, f"http://b/{i}", ["hot", f"own {i}", f"pair {i // 2}"][i % 3], None, None) for i in range(900)] + [(None, None, None, None, None)] * 300
    written(spark, rows, tmp_path)
    assert run(spark, tmp_path) == plain(rows)


def archived(spark, tmp_path, rows, least=0):
    folder = str(tmp_path / "out")
    pages = spark.createDataFrame(rows, SCHEMA).drop("row").withColumn("row", F.monotonically_increasing_id())
    warc.write_archives(pages, folder, least)
    return folder, warc.index(spark, folder)


def test_archives_parse_and_places_are_exact(spark, tmp_path):
    """Every byte of the files belongs to one record, and a record's bytes are those that the index names."""
    folder, index = archived(spark, tmp_path, ROWS, least=5)
    assert index.count() == len(ROWS)
    payloads = []
    for path in Path(folder).glob("part-*"):
        raw, at = path.read_bytes(), 0
        own = index.where(F.col("path").endswith(path.name)).orderBy("offset").collect()
        for r in own:
            assert r["offset"] == at
            one = raw[at : at + r["length"]]
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
            header, _, block = one[:-4].partition(b"\r\n\r\n")
            assert f"Content-Length: {len(block)}".encode() in header.split(b"\r\n")
            http, _, body = block.partition(b"\r\n\r\n")
            if r["type"] == "response":
                payloads.append(body.decode())
                assert r["digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert body == b"" and r["refers_to"]
            at += r["length"]
        assert at == len(raw)
    small = [h or "" for _, _, h, *_ in ROWS if len((h or "").encode()) < 5]
    assert sorted(payloads) == sorted(small + list({h for _, _, h, *_ in ROWS if h and len(h.encode()) >= 5}))


def test_only_the_selected_records_are_read(spark, tmp_path):
    _, index = archived(spark, tmp_path, ROWS)
    some = index.where("type = 'response' and record_id like '<urn:page:2:%'")
    found = warc.read_records(some.unionAll(some)).collect()
    assert [bytes(r["payload"]) for r in found] == [b"<p>two</p>"] * 2
    assert warc.read_records(index.limit(0)).collect() == []


def test_ranges_are_coalesced():
    near = [("a", 0, 10), ("a", 10, 20), ("a", 30 + warc.GAP, 5), ("a", 36 + 2 * warc.GAP, 5), ("b", 0, 7), ("b", 7, warc.READ), ("b", 7 + warc.READ, 1)]
    found = [(p, s, e, len(own)) for p, s, e, own in warc.ranges(iter(near))]
    assert found == [("a", 0, 35 + warc.GAP, 3), ("a", 36 + 2 * warc.GAP, 41 + 2 * warc.GAP, 1), ("b", 0, 7, 1), ("b", 7, 7 + warc.READ, 1), ("b", 7 + warc.READ, 8 + warc.READ, 1)]
    assert list(warc.ranges(iter([]))) == []


def test_a_broken_archive_is_an_error(spark, tmp_path):
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "part-0").write_bytes(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(Exception, match="no record at 0"):
        warc.index(spark, str(folder)).collect()
