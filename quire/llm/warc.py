"""WARC archives: write captures, read them back, assemble transactions.

Writing.  Every page becomes a request, a response or revisit, and a
metadata record; request and metadata name the response by
WARC-Concurrent-To.  Pages with equal payloads share one response (the
smallest page id); the others revisit it.  A record ends with two line
ends, so archives are written by Spark's text writer with that separator,
to any file system that Spark can write, gzip-compressed.

Reading.  Archives are bounded files (``records_per_file``), read whole by
Spark's binary reader and cut into records by Content-Length, so payloads
may hold anything.  The payload digest of every response is computed again
and compared with its header.

Assembly.  Records are joined through WARC-Concurrent-To: a record's key is
the record it names, or what that one names, or itself; records of one key
are one capture, collected into one nested row.

*Plan.*  Payload digests are read once into a narrow table; only digests
that more than one page has are joined back to the pages (Spark broadcasts
that table if it is small).  Reading shuffles record headers, and payloads
only if they are asked for.

*Defined results.*  Null html is an empty payload; a null url is left out;
line ends in a url are percent-encoded.  A null page id is never the
smallest; if all pages of a payload lack ids, all are responses.  Repeated
rows with the smallest id are all responses.  Payloads under ``least`` bytes
are never revisits.  An empty table writes archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import col
from quire.session import cut_lineage, scratch_path

# The format's version, line end and revisit profile.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32(hexes: pa.Array) -> pa.Array:
    return pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in hexes.to_pylist()], pa.string())


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a string column's UTF-8 bytes."""
    return F.arrow_udf(_base32, "string")(F.sha1(payload.cast("binary")))


def _record(kind: str, ident: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its two closing line ends.  Null headers are left out."""
    lines = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), ident, F.lit(f"{CRLF}WARC-Date: {STAMP}{CRLF}")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def write_archives(
    pages: DataFrame,
    path: str,
    least: int = 0,
    records_per_file: int = 6000,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write all pages as gzip-compressed WARC files under ``path``."""
    html = F.coalesce(col(html_col).cast("string"), F.lit(""))
    given = pages.select(col(id_col).cast("string").alias("page"), col(id_col).alias("id"), col(url_col).cast("string").alias("url"), html.alias("html"))
    given = given.withColumn("digest", payload_digest(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    narrow = cut_lineage(given.select("id", "digest", "bytes"), "digests")
    shared = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    shared = cut_lineage(shared.where("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"), "shared")
    rows = given.join(shared, F.col("digest") == F.col("of"), "left").withColumn("row", F.monotonically_increasing_id().cast("string"))
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    # an encoded url has no line ends
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.withColumn("url", url)
    key = _urn(F.lit("response"), F.col("row"), F.coalesce("page", F.lit("")), F.col("digest"))
    uri, about = ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", F.col("key"))
    rows = rows.withColumn("key", key)
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.nullif(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF)
    )
    sha = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    reply = ("Content-Type", F.lit("application/http; msgtype=response"))
    fields = F.concat(
        F.lit("page-id: "), F.coalesce("page", F.lit("")), F.lit(f"{CRLF}payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF)
    )
    records = F.array(
        _record("request", _urn(F.lit("request"), F.col("key")), [uri, about, ("Content-Type", F.lit("application/http; msgtype=request"))], request),
        F.when(
            again, _record("revisit", F.col("key"), [uri, sha, ("WARC-Profile", F.lit(PROFILE)), reply], head)
        ).otherwise(_record("response", F.col("key"), [uri, sha, reply], F.concat(head, F.col("html")))),
        _record("metadata", _urn(F.lit("metadata"), F.col("key")), [uri, about, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def _inflate(data: memoryview) -> bytes:
    """All members of a gzip file; other bytes as they are."""
    if bytes(data[:2]) != b"\x1f\x8b":
        return bytes(data)
    out = []
    while len(data):
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = memoryview(member.unused_data)
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an archive."""
    at, end = 0, len(data)
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= end:
            return
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        headers: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        at = stop + 4
        size = int(headers["content-length"])
        if at + size > end:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, data[at : at + size]
        at += size


RECORD = (
    "record_id string, kind string, concurrent_to string, target_uri string, date string, digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; ``payload`` only if asked for."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out: list[dict] = []
                for headers, block in parse(_inflate(memoryview(content.as_buffer()))):
                    kind, payload = headers.get("warc-type"), None
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if digest != (digest := digest_of(payload)) and "warc-payload-digest" in headers:
                            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                    fields = []
                    if kind == "metadata":
                        pairs = (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if ":" in x)
                        fields = list({a.strip(): b.strip() for a, _, b in pairs}.items())
                    out.append(
                        {
                            "record_id": headers.get("warc-record-id"), "kind": kind, "concurrent_to": headers.get("warc-concurrent-to"),
                            "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "digest": digest,
                            "payload_bytes": None if payload is None else len(payload), "fields": fields, "payload": payload if payloads else None,
                        }
                    )
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "kind", "concurrent_to", "target_uri", "date", "digest")]
    + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata.

    A record that names another by concurrent-to joins it; if that one names
    a third, both join the third.  A capture lacking a record has a null there.
    """
    step = records.where("concurrent_to IS NOT NULL").select(F.col("record_id").alias("named"), F.col("concurrent_to").alias("onward"))
    step = step.groupBy("named").agg(F.min("onward").alias("onward"))
    # records that name none get a key of their own, so that they spread
    asks = F.coalesce("concurrent_to", F.concat(F.lit(" "), "record_id"))
    linked = records.withColumn("asks", asks).join(step, F.col("asks") == F.col("named"), "left")
    first = F.coalesce("concurrent_to", "record_id")
    # two records that name each other meet at the smaller id
    key = F.when(F.col("onward") == F.col("record_id"), F.least("record_id", "concurrent_to")).otherwise(F.coalesce("onward", first))
    body = F.struct("record_id", "kind", "target_uri", "date", "digest", "payload_bytes", "payload")
    note = F.struct("record_id", F.to_json("fields").alias("fields"))
    captured = linked.withColumn("capture_id", key).groupBy("capture_id").agg(
        F.max(F.when(F.col("kind") == "request", F.struct("record_id", "target_uri", "date"))).alias("request"),
        F.max(F.when(F.col("kind").isin("response", "revisit"), body)).alias("response"),
        F.max(F.when(F.col("kind") == "metadata", note)).alias("metadata"),
    )
    return captured


def captures(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and return one digest row per
    page: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least, id_col=id_col, url_col=url_col, html_col=html_col)
    kind = pages.select(col(id_col)).dtypes[0][1]
    fields = F.from_json("metadata.fields", "map<string,string>")
    rows = assemble(read_archives(spark, path)).select(
        F.nullif(fields["page-id"], F.lit("")).cast(kind).alias("id"),
        F.coalesce("response.payload_bytes", fields["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
    )
    rows = cut_lineage(rows, "captures")
    first = rows.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("id").alias("first"))
    again = rows.where("record_type = 'revisit'").select(F.col("payload_digest").alias("of")).distinct()
    first = first.join(again, F.col("payload_digest") == F.col("of"), "left_semi").withColumnRenamed("payload_digest", "of")
    out = rows.join(cut_lineage(first, "revisited"), F.col("payload_digest") == F.col("of"), "left")
    return out.select(
        F.col("id").alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("first")).alias("refers_to"),
    )
