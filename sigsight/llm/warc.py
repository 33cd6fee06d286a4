"""WARC archives with revisit resolution.

``write_archives`` writes one response record per page through Spark's text
writer, whose commit protocol survives lost executors; records end with the
line separator CRLF CRLF, as WARC demands.  ``read_archives`` parses archives by
their Content-Length headers.  ``deduplicate`` shuffles the records' headers
alone by payload digest, joins each to the record that keeps the payload, and
rewrites each archive, every other one as a revisit record with fresh headers.

An archive is one gzip file of about ``ARCHIVE_BYTES`` before compression, which
bounds what a task holds.

Defined cases: null html is an empty payload; a null url or page_id gives no
such header, and page_id comes back null; payloads under ``LEAST_BYTES`` stay
responses; of equal rows one is the response and the others revisit it; a null
page_id yields to any other; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsight.llm.common import table
from sigsight.session import ensure_checkpoint_dir, remove_folder

LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: About what a record's headers take.
HEADER_BYTES = 500
#: WARC-Date of written records: pages carry no time, and the clock would make runs differ.
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "path string, offset long, type string, page_id long, uri string, digest string, payload_bytes long, refers_to long"


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def page_records(pages: DataFrame) -> DataFrame:
    """The text of a response record for each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
                    _line("Content-Length", F.octet_length(html).cast("string")), F.lit(END))
    head = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: response{END}"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("long").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "")),
        F.lit(f"WARC-Date: {DATE}{END}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode(html, "UTF-8")))),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(html)).cast("string")), F.lit(END))
    return pages.select(F.concat(head, http, html).alias("record"))


def write_archives(records: DataFrame, path: str, record_bytes: float) -> None:
    records.write.option("lineSep", END * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / max(record_bytes, 1)))).text(path)


def _fields(lines: bytes) -> dict[str, str]:
    parts = (x.partition(":") for x in lines.decode("utf-8").split(END)[1:])
    return {k.strip().lower(): v.strip() for k, _, v in parts}


def _page(uri: str | None) -> int | None:
    return int(uri.removeprefix("<urn:page:").removesuffix(">")) if uri else None


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        start = data.index(b"\r\n\r\n", at) + 4
        fields = _fields(data[at : start - 4])
        end = start + int(fields["content-length"])
        if data[at:at + 5] != b"WARC/" or data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"damaged WARC record at byte {at}")
        yield at, fields, data[start:end]
        at = end + 4


def _unzipped(content: bytes) -> bytes:
    return zlib.decompress(content, wbits=31) if content else b""


def _header_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            for at, fields, block in parse(_unzipped(content)):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest differs at byte {at} of {path}")
                else:
                    size = int(_fields(http)["content-length"])
                rows.append((path, at, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), digest, size,
                             _page(fields.get("warc-refers-to"))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADERS.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The headers of every record, its payload's digest checked."""
    return _archives(spark, path).mapInPandas(_header_rows, HEADERS)


def revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(path, offset, original_id, original_uri) of every record whose payload another one keeps.

    The keeper of a digest is found by a maximum, combined before the shuffle.
    """
    long = headers.filter(F.col("payload_bytes") >= least_bytes)
    rank = F.struct(F.col("page_id"), F.col("path"), F.col("offset"), F.col("uri"))
    kept = long.groupBy("digest", "payload_bytes").agg(F.max(rank).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    pairs = long.join(kept, ["digest", "payload_bytes"])
    same = (F.col("path") == F.col("kept.path")) & (F.col("offset") == F.col("kept.offset"))
    return pairs.filter(~same).select("path", "offset", F.col("kept.page_id").alias("original_id"), F.col("kept.uri").alias("original_uri"))


def _rewritten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content, found in zip(batch["content"], batch["found"], strict=True):
            originals = {r["offset"]: r for r in found} if found is not None else {}
            out, size = [], 0
            for at, fields, block in parse(_unzipped(content)):
                kept = originals.get(at)
                out.append(_response(fields, block) if kept is None else _revisit(fields, block, kept))
                size += len(out[-1])
                if size > 4 << 20:
                    yield pd.DataFrame({"record": out})
                    out, size = [], 0
            if out:
                yield pd.DataFrame({"record": out})


def _text(kind: str, fields: dict[str, str], more: list[tuple[str, str | None]], block: bytes) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", fields.get("warc-record-id")), ("WARC-Target-URI", fields.get("warc-target-uri")),
             ("WARC-Date", fields["warc-date"]), ("WARC-Payload-Digest", fields["warc-payload-digest"]), *more,
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}{END}" for k, v in lines if v is not None)
    return f"WARC/1.1{END}{head}{END}{block.decode('utf-8')}"


def _response(fields: dict[str, str], block: bytes) -> str:
    return _text("response", fields, [], block)


def _revisit(fields: dict[str, str], block: bytes, kept) -> str:
    """The revisit record: the HTTP headers (whose Content-Length tells the payload's size) without the payload."""
    original = kept["original_id"]
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", None if original is None else f"<urn:page:{original}>"),
            ("WARC-Refers-To-Target-URI", kept["original_uri"]), ("WARC-Refers-To-Date", DATE)]
    return _text("revisit", fields, more, block[: block.index(b"\r\n\r\n") + 4])


def deduplicate(spark: SparkSession, source: str, target: str, record_bytes: float, least_bytes: int = LEAST_BYTES) -> None:
    """Rewrite the archives under ``source`` to ``target``, repeated payloads as revisit records."""
    found = revisits(read_archives(spark, source), least_bytes)
    # As many decisions as an archive has records: bounded with its size.
    by_archive = found.groupBy("path").agg(F.collect_list(F.struct("offset", "original_id", "original_uri")).alias("found"))
    joined = _archives(spark, source).join(by_archive, "path", "left").select("content", "found")
    write_archives(joined.mapInPandas(_rewritten, "record string"), target, record_bytes)


def op5_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read from deduplicated archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    shared = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    size = (pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0.0) + HEADER_BYTES
    write_archives(page_records(pages), f"{shared}/raw", size)
    deduplicate(spark, f"{shared}/raw", f"{shared}/deduplicated", size)
    remove_folder(spark, f"{shared}/raw")
    return read_archives(spark, f"{shared}/deduplicated").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
