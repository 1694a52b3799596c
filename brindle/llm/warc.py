"""Legacy archive converter: ARC records to equivalent WARC records, archives written and read by Spark.

ARC: the first record, filedesc, declares the version; each later record is one header line, whose fields are those of
that version, and as many bytes as its last field declares. Version 1 has five fields and version 2 ten; fields are
taken from the right, as only the URL may hold blanks. A body shorter than declared is kept and marked as truncated.
A converted record gets a name-based UUID, its 14-digit time as a W3C time, its type from the body (HTTP responses are
`response`, other bodies `resource`, filedesc `warcinfo`) and SHA-1 digests of block and payload.

Archives are written by Spark's text writer: a WARC record ends in CRLF CRLF, which is the line separator given; so the
files are committed like any table, in any store. They are read as whole files, of `records_per_file` records each, and
parsed by declared lengths alone.

Edge cases: null html is an empty payload and null url is `unknown:`; blanks and control characters of a URL are
percent-encoded; rows with a null page_id are written too, count lowest, and read back as null; repeated rows are
written each, and only the first of those with the largest page_id in a group is no revisit if their ids differ (equal
ids all stay `response`); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

NAME = "op2_warc_convert"
CRLF = b"\r\n"
#: Fixed field names of the two ARC versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def quoted(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def arc_header(version: int, name: str = "brindle.arc", when: str = "20240101000000") -> bytes:
    """The filedesc record."""
    body = f"{version} 0 brindle\n{' '.join(FIELDS[version])}\n\n".encode()
    rest = "text/plain " if version == 1 else "text/plain 200 - - 0 x "
    return f"filedesc://{name} 0.0.0.0 {when} {rest}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, body: bytes, when: str = "20240101000000", kind: str = "text/html") -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(body).hexdigest()} - 0 x "
    return f"{url} 0.0.0.0 {when} {kind} {middle}{len(body)}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Fields, body and whether it is truncated, of filedesc and each record after it."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not version:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC archive begins with filedesc")
            version = int(data[end + 1 : data.find(b" ", end + 1)])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"not an ARC header line of version {version}: {line[:80]}")
        fields = dict(zip(names, parts))
        size = int(fields["Archive-length"])
        body = data[end + 1 : end + 1 + size]
        yield fields, body, len(body) < size
        at = end + 1 + size


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block and payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, gap, rest = body.partition(CRLF + CRLF)
    return (head + gap, rest) if gap else (body, b"")


def w3c_time(stamp: str) -> str:
    """A time of up to 14 digits; what is missing is filled up, what is no time is the epoch."""
    s = stamp + "19700101000000"[len(stamp) :] if stamp.isdigit() and 4 <= len(stamp) <= 14 else "19700101000000"
    out = f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"
    ok = re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ", out)
    return out if ok else "1970-01-01T00:00:00Z"


def digest_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(fields: dict[str, str], body: bytes, truncated: bool = False, key: object = "", refers_to: tuple | None = None, place: object = "") -> bytes:
    """The equivalent WARC record, without the CRLF CRLF that ends it. refers_to: (key, url) of the record whose payload is the same; then the
    payload is left out, and the record is named by its target and time. place: where the row is, so that repeated rows have identifiers of their own."""
    head, payload = split_http(body)
    kind = "warcinfo" if fields["URL"].startswith("filedesc:") else "response" if head else "resource"
    url, when, mark = fields["URL"], w3c_time(fields["Archive-date"]), digest_name(payload)
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id(url, when, mark, key, place), "WARC-Date": when}
    if kind == "warcinfo":
        lines["WARC-Filename"] = url.removeprefix("filedesc://")
    else:
        lines["WARC-Target-URI"] = url
    if fields["IP-address"] not in ("0.0.0.0", "-"):
        lines["WARC-IP-Address"] = fields["IP-address"]
    block = body
    if refers_to is not None:
        block = head
        lines |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": refers_to[1], "WARC-Refers-To-Date": when, "X-Refers-To-Key": str(refers_to[0])}
    if kind != "warcinfo":
        lines["WARC-Payload-Digest"] = mark
    lines["WARC-Block-Digest"] = digest_name(block)
    if truncated:
        lines["WARC-Truncated"] = "length"
    if key != "":
        lines["X-Key"] = str(key)
    lines |= {"Content-Type": "application/http;msgtype=response" if head else "application/warc-fields" if kind == "warcinfo" else fields["Content-type"], "Content-Length": str(len(block))}
    return CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in lines.items()), b"", block])


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _convert(most: int, most_bytes: int):
    """key, url, payload, other key, other url -> an ARC archive of one record -> WARC record. A row of the result is up to `most` records and about `most_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, held, size = TaskContext.get().partitionId(), 0, [], 0

        def joined() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(CRLF + CRLF).join(held)], pa.binary()).cast(pa.string())], names=["value"])

        for batch in batches:
            for key, url, payload, other, other_url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                payload = payload.as_py()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                version = 1 + (key or 0) % 2
                archive = arc_header(version) + arc_record(version, quoted(url), body)
                for fields, data, cut in read_arc(archive):
                    if not fields["URL"].startswith("filedesc:"):
                        held.append(warc_record(fields, data, cut, "" if key is None else key, None if other is None else (other, quoted(other_url)), f"{part}.{row}"))
                        size += len(held[-1])
                row += 1
                if len(held) >= most or size >= most_bytes:
                    yield joined()
                    held, size = [], 0
        if held:
            yield joined()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for data in batch.column(0):
            raw, out = data.as_py(), []
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            for f, block in read_warc(raw):
                head, payload = split_http(block)
                if f["WARC-Type"] == "revisit":
                    n = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                elif digest_name(payload) != f.get("WARC-Payload-Digest"):
                    raise ValueError(f"digest of {f['WARC-Record-ID']}")
                else:
                    n = len(payload)
                sha = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                key, other = f.get("X-Key"), f.get("X-Refers-To-Key")
                out.append((key and int(key), n, sha, f["WARC-Type"], other and int(other), f["WARC-Record-ID"], f.get("WARC-Target-URI"), f["WARC-Date"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * len(names), kinds)], names=names)


def convert(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, records_per_file: int = 2000, file_bytes: int = 64 << 20) -> None:
    """Writes one WARC record per row under path; of equal payloads of `least` bytes or more all but the largest id are revisits.

    records_per_file, file_bytes: records and their bytes in a file, about; a longer record is a part of a file by itself."""
    rows = pages.select(pages[id_col].cast("long").alias("key"), pages[url_col].alias("url"), F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    same = rows.filter(F.col("n") >= least).groupBy(F.col("sha").alias("g_sha"), F.col("n").alias("g_n"))
    same = same.agg(F.count(F.lit(1)).alias("size"), F.max("key").alias("other"), F.max_by("url", "key").alias("other_url")).filter("size > 1")
    rows = rows.join(same, (rows["sha"] == same["g_sha"]) & (rows["n"] == same["g_n"]), "left")
    again = ~F.coalesce(F.col("key") == F.col("other"), F.lit(False))
    rows = rows.select("key", "url", "payload", F.when(again, F.col("other")).alias("other"), F.when(again, F.col("other_url")).alias("other_url"))
    parts = min(8, records_per_file)
    written = rows.mapInArrow(_convert(records_per_file // parts, file_bytes // parts), "value string").write
    written.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", parts).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC archives under path."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("archives")
    convert(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""
