"""Archives as an exact round trip."""

import base64
import hashlib

from dakspark.llm import warc
from dakspark.llm.common import fresh_path

PAGES = "page_id long, url string, html string, record_type string"


def run(spark, rows, smallest=0):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, smallest)
    return warc.read_archives(spark, path).collect()


def test_round_trip(spark):
    rows = [(5, "u5", "<p>é</p>", "x"), (2, "u2", "<p>é</p>", "x"), (3, None, None, None), (4, "u\r\n4", "", "x"), (9, "u9", "a\r\n\r\nWARC/1.1\r\n" * 9000, "x"), (None, "n", "<p>é</p>", "x")]
    got = {r["page_id"]: r for r in run(spark, rows)}
    assert len(got) == 6 and all(r["payload_ok"] for r in got.values())
    for page, _, html, _ in rows:
        body = (html or "").encode()
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert got[page]["payload_bytes"] == len(body)
        if got[page]["record_type"] == "response":
            assert bytes(got[page]["payload"]) == body
    assert (got[5]["record_type"], got[5]["refers_to"]) == ("revisit", 2)
    assert (got[4]["record_type"], got[4]["refers_to"]) == ("revisit", 3)
    assert got[None]["record_type"] == "response" and got[9]["record_type"] == "response"


def test_small_payloads_and_repeats(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in run(spark, rows, smallest=4))
    assert got == [(1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert run(spark, []) == []


def test_pieces_and_small_files(spark, monkeypatch):
    """Archives in many files and pieces; payloads that end in or hold what ends a record."""
    monkeypatch.setattr(warc, "PIECE_BYTES", 7)
    bodies = ["", "\r\n", "x\r\n", "x\r\n\r\n", "\r\n\r\n\r\nWARC/1.1\r\n", "\n\r\n\r", "é" * 500]
    rows = [(i, f"u{i}", b, "") for i, b in enumerate(bodies * 3)]
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, file_bytes=3000)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).count() > 3
    got = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got.values())
    for page, body in enumerate(bodies):
        assert bytes(got[page]["payload"]) == body.encode() and got[page + 7]["refers_to"] == page


def test_records_cut_off():
    import pytest

    with pytest.raises(ValueError):
        list(warc.parse_records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    with pytest.raises(ValueError):
        list(warc.parse_records(iter([b"HTTP/1.1\r\n\r\n"])))
