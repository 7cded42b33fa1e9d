"""WARC archives with revisit records.

Headers (id, payload digest, payload length) are shuffled by digest; the smallest id of a digest is
the response, the others are joined to it as revisits.  The archive is written by Spark's own text
writer, one record per row, so a lost task is written again and a half-written file never shows.

Defined cases: null payload = empty payload; null url = no target URI; a row with a null id is a
response and is never referred to; rows that repeat the smallest id are all responses; an empty
table gives an archive without records; archives of any size are read as streams; a record that is cut off
or has no header is an error; further columns are ignored.  A file is one gzip stream, as Spark writes it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

EPOCH = "2024-01-01T00:00:00Z"
#: What ends headers and records; the bytes that a reader joins at a time; the payloads that a file is to hold.
END, PIECE_BYTES, FILE_BYTES = b"\r\n\r\n", 1 << 20, 256 << 20
RECORDS = (
    "page_id long, record_type string, payload_digest string, refers_to long, target_uri string, "
    "payload binary, payload_bytes long, payload_ok boolean, file string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.upper(F.concat(*parts)), HEX_DIGITS, BASE32_DIGITS)


def resolve_revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Per page: payload_bytes, payload_digest, record_type, refers_to, refers_to_uri.

    `pages` has page_id, url, html.  Payloads under `smallest` bytes are never revisited.
    Only headers move here, never payloads.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select(
        "page_id",
        "url",
        F.octet_length(body).cast("long").alias("payload_bytes"),
        base32_sha1(body.cast("binary")).alias("payload_digest"),
    )
    first = (
        heads.where((F.col("payload_bytes") >= smallest) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct("page_id", "url")).alias("first"))
    )
    is_first = F.col("first").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("first.page_id"))
    return heads.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("first.page_id")).alias("refers_to"),
        F.when(~is_first, F.col("first.url")).alias("refers_to_uri"),
    )


def _uri(url: Column) -> Column:
    """A header's value holds no line breaks."""
    return F.regexp_replace(url, "[\\r\\n]+", "%0A")


def _record_id(page_id: Column, uri: Column) -> Column:
    seed = F.md5(F.concat_ws("|", F.lit("warc"), page_id.cast("string"), uri))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.regexp_replace(seed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        F.lit(">"),
    )


def _line(name: str, value: Column) -> Column:
    """One header line, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def record_text(date: str = EPOCH) -> Column:
    """The whole record, without the two line breaks that end it."""
    answer = F.col("record_type") == "response"
    uri, body = _uri(F.col("url")), F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(answer, body).otherwise(F.lit("")))
    return F.concat(
        F.lit(VERSION + "\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), uri)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("X-Page-Id", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        _line("WARC-Refers-To", F.when(~answer, _record_id(F.col("refers_to"), _uri(F.col("refers_to_uri"))))),
        _line("WARC-Refers-To-Target-URI", _uri(F.col("refers_to_uri"))),
        _line("WARC-Refers-To-Date", F.when(~answer, F.lit(date))),
        _line("WARC-Profile", F.when(~answer, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, smallest: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes `pages` (page_id, url, html) as gzipped WARC files under `path`, each payload once.

    Files end after as many records as have about `file_bytes` of payloads by their mean.
    """
    pages = pages.select("page_id", "url", "html")
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 1
    records_per_file = max(1, int(file_bytes / mean))
    known = pages.where(F.col("page_id").isNotNull())
    heads = resolve_revisits(known, smallest).distinct()
    body = F.coalesce(F.col("html"), F.lit(""))
    # Ids can repeat with different payloads, so the digest is part of the key.
    whole = known.withColumn("payload_digest", base32_sha1(body.cast("binary"))).join(
        heads, ["page_id", "payload_digest"]
    )
    loose = pages.where(F.col("page_id").isNull()).select(
        "*",
        base32_sha1(body.cast("binary")).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_uri"),
    )
    (
        whole.unionByName(loose)
        .select(record_text().alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of each record, by its Content-Length, of bytes that come in pieces.

    No more is held than a record and a piece.
    """
    held, at = bytearray(), 0

    def more() -> bool:
        nonlocal held, at
        piece = next(pieces, None)
        if piece is None:
            return False
        if at:
            del held[:at]
            at = 0
        held += piece
        return True

    while True:
        # Behind the last record, whose end may lie across a break, there can be empty lines.
        while held[at : at + 2] == b"\r\n":
            at += 2
        while (end := held.find(END, at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("a record without an end")
                return
        lines = held[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {lines[0][:40]!r}")
        heads = dict(x.split(": ", 1) for x in lines[1:])
        size = int(heads["Content-Length"])
        begin = end + 4 - at
        while len(held) < at + begin + size + 4:
            if not more():
                raise ValueError("a record is cut off")
        yield heads, bytes(held[at + begin : at + begin + size])
        at += begin + size + 4


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path`; payload_ok tells if the digest is the payload's.

    Spark's text reader unpacks a file as a stream, in pieces between empty lines, so a task holds a few pieces and one
    record, however large an archive is.  A file is read by one task, in its order.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for name, pieces in groupby(_pieces(batches), lambda x: x[0]):
            for heads, block in parse_records(piece for _, piece in pieces):
                front, _, payload = block.partition(END)
                kind, digest = heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha1:")
                own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                stated = int(front.rpartition(b"Content-Length: ")[2])
                page, refers = heads.get("X-Page-Id"), heads.get("X-Refers-To-Page-Id")
                out.append(
                    (
                        int(page) if page else None,
                        kind,
                        digest,
                        int(refers) if refers else None,
                        heads.get("WARC-Target-URI"),
                        payload if payloads and kind == "response" else None,
                        stated,
                        kind == "revisit" or (own == digest and stated == len(payload)),
                        name,
                    )
                )
                if len(out) >= 200:
                    yield _frame(out)
                    out = []
        if out:
            yield _frame(out)

    lines = spark.read.option("lineSep", END.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")).mapInPandas(records, RECORDS)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """A file's bytes in pieces, the breaks between them included."""
    for batch in batches:
        for name, rows in groupby(zip(batch["path"], batch["piece"]), lambda x: x[0]):
            held, size = [], 0
            for _, piece in rows:
                held.append(piece)
                size += len(piece) + 4
                if size >= PIECE_BYTES:
                    yield name, END.join(held) + END
                    held, size = [], 0
            if held:
                yield name, END.join(held) + END


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """op5: writes the archives of `pages` and returns what reading them back says."""
    from .common import read_table

    path = fresh_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload_ok"
    )
