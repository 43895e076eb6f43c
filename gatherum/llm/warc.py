"""WARC archives: write captures, read archives back, and assemble transactions.

A capture is three records, ``request``, ``response`` (or ``revisit``) and ``metadata``; the request and the metadata name
the response in ``WARC-Concurrent-To``. Writing is a text sink whose line separator is the blank lines that end a record,
so archives go to any file system that Spark can write, each file by one task and of a bounded size. Reading walks each archive by its
Content-Length headers. ``assemble`` joins records by their concurrent-to identifiers into one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatherum.llm.common import discard, materialise

CRLF = "\r\n"
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 100
#: Bytes of payload that a file holds at most (or one capture). Pages of more than so many times the mean go to files of their own.
FILE_BYTES, LARGE_TIMES = 1 << 28, 16
DATE = "2024-01-01T00:00:00Z"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[str, object]], block) -> object:
    """A record as text, without the blank lines that end it. ``headers``: a null value leaves its line out."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def _pages(pages: DataFrame) -> DataFrame:
    """page, page_id, url, payload, digest, bytes. ``page`` is the id as text, never null."""
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    return one.withColumns({"page": F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("long")})


def roles(digests: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page, digest, refers_to, copies) from the pages without their payloads: only pages that refer to a response, or that come several times.

    ``refers_to`` is the smallest page_id with an equal payload of ``least`` bytes or more, for the pages that aren't that one. A
    page without a page_id never is what others refer to. Rows with the same page_id as the response are responses.
    """
    each = digests.groupBy("page", "page_id", "digest", "bytes").agg(F.count("*").alias("copies"))
    first = each.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages")).where("pages > 1 and first_id is not null")
    refers = F.when((F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return each.join(first, "digest", "left").select("page", "digest", refers.alias("refers_to"), "copies").where("refers_to is not null or copies > 1")


def _key(page, digest):
    """The part of a record's id that names the capture: page and payload."""
    return F.concat_ws("-", page, F.left(digest, F.lit(16)))


def records(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """One text per WARC record (column ``value``) and ``bytes`` of its payload, three for each row of ``pages`` (page_id, url, html).

    Ids are made of page and payload, so that a revisit can name the response it refers to (``facts`` are ``roles`` of the pages).
    Rows that come several times are numbered from the second on; those without a page_id, which nothing refers to, by their place.
    """
    known = _pages(pages).join(facts, ["page", "digest"], "left")
    base = _key(F.col("page"), F.col("digest"))
    once = known.where("copies is null or copies = 1").withColumn("key", base)
    turn = F.row_number().over(Window.partitionBy("page", "digest").orderBy("url"))
    again = known.where("copies > 1 and page_id is not null").withColumn("_turn", turn).withColumn("key", F.when(F.col("_turn") == 1, base).otherwise(F.concat_ws("-", base, "_turn"))).drop("_turn")
    nameless = known.where("copies > 1 and page_id is null").withColumn("key", F.concat_ws("-", base, F.hex(F.monotonically_increasing_id())))
    rows = once.unionByName(again).unionByName(nameless)
    urn = lambda kind, key: F.concat(F.lit(f"<urn:gatherum:{kind}:"), key, F.lit(">"))
    common = [("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")), ("WARC-Date", DATE), ("X-Page-Id", F.col("page_id"))]
    answer = urn("response", F.col("key"))
    revisit = F.col("refers_to").isNotNull()
    http = lambda length: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", answer),
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, urn("response", _key(F.col("refers_to").cast("string"), F.col("digest"))))),
            ("WARC-Profile", F.when(revisit, F.lit(_REVISIT_PROFILE))),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.when(revisit, http(F.col("bytes").cast("string"))).otherwise(F.concat(http(F.col("bytes").cast("string")), F.col("payload"))),
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", urn("request", F.col("key"))), ("WARC-Concurrent-To", answer), *common, ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"\s+", "%20"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}")),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", urn("metadata", F.col("key"))), ("WARC-Concurrent-To", answer), *common, ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF)),
    )
    return rows.select("bytes", F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Archives (gzip) of all captures, in folders under ``path``; a file holds at most ``file_bytes`` of payloads, or one capture.

    Payloads of any length are written whole. Null html counts as empty, rows that come several times are all written, other
    columns are ignored; an empty table gives no record. Each file is one gzip member.
    """
    digests = materialise(_pages(pages).select("page", "page_id", "digest", "bytes"), "warc-digests")
    size = digests.agg(F.avg("bytes").alias("mean"), F.max("bytes").alias("most")).first()
    facts = materialise(roles(digests, least), "warc-roles")
    limit = max(1 << 16, int(LARGE_TIMES * (size["mean"] or 0)))
    parts = [("pages", F.octet_length("html") <= limit, limit), ("large", F.octet_length("html") > limit, size["most"] or 0)]
    for name, kept, most in parts[: 1 + ((size["most"] or 0) > limit)]:
        rows = records(pages.where(F.coalesce(kept, F.lit(name == "pages"))), facts).select("value")
        rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * max(1, file_bytes // max(1, most))).text(f"{path}/{name}")
    discard(digests, facts)


_FIELDS = {b"warc-type": 0, b"warc-record-id": 1, b"warc-concurrent-to": 2, b"warc-target-uri": 3, b"warc-payload-digest": 4, b"warc-refers-to": 5, b"x-page-id": 6}


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[list[str | None], bytes]]:
    """(the seven fields, block) of each record; a record that breaks off ends the archive.

    A record whose Content-Length is missing or no number has type ``bad`` and an empty block; reading goes on at the next line that begins a record.
    """
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: list[str | None] = [None] * 7
        length = -1
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip()
            if name == b"content-length":
                length = int(value) if value.isdigit() else -1
            elif name in _FIELDS:
                fields[_FIELDS[name]] = value.decode("utf-8", "replace")
        if length < 0:
            fields[0] = "bad"
            yield fields, b""
            continue
        block = stream.read(length)
        if len(block) < length:
            return
        yield fields, block


def _page_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[+-]?[0-9]{1,18}", text) else None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record: type, record_id, concurrent_to, uri, declared_digest, refers_to, page_id, payload_bytes, payload_digest.

    ``payload`` adds the payload itself (the block behind the HTTP header of requests and responses). Bytes and digest are
    taken from what was read; for revisits, which hold no payload, they are null. A record with a bad header has type ``bad``, a page
    number that is none is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(memoryview(content.as_buffer()))
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows: list[tuple] = []
                size = 0
                for fields, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw):
                    body = block if fields[0] == "metadata" else block.partition(b"\r\n\r\n")[2]
                    full = fields[0] == "response"
                    page = _page_number(fields[6])
                    rows.append((*fields[:6], page, len(body) if full else None, hashlib.sha256(body).hexdigest() if full else None, body if payload else None))
                    size += len(body) if payload else 200
                    if size > 4_000_000:
                        yield _batch(rows, payload)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, payload)

    schema = "type string, record_id string, concurrent_to string, uri string, declared_digest string, refers_to string, page_id long, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema + ", payload binary" * payload)


_TYPES = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["type", "record_id", "concurrent_to", "uri", "declared_digest", "refers_to", "page_id", "payload_bytes", "payload_digest", "payload"]


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    n = 9 + payload
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows))[:n], _TYPES)], names=_NAMES[:n])


def assemble(parsed: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, request, response, metadata (structs; null where the record is missing).

    Requests and metadata belong to the response or revisit they are concurrent to; those that name none, or one that isn't
    there, give a capture without a response. Of several requests for one response the first by record_id counts.
    """
    fields = [c for c in parsed.columns if c != "concurrent_to"]
    row = F.struct(*[F.col(c) for c in fields])
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    of = lambda *kinds: F.min_by(F.when(F.col("type").isin(*kinds), row), F.when(F.col("type").isin(*kinds), F.col("record_id")))
    return (
        parsed.groupBy(key.alias("capture_id"))
        .agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))
        .withColumn("page_id", F.coalesce("response.page_id", "request.page_id", "metadata.page_id"))
    )


def capture_table(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, has_request, has_metadata of assembled captures.

    A revisit takes bytes and digest of the response that it refers to by id, which are those of the full payload, and in
    ``refers_to`` that response's page_id; all three are null if there is no such response.
    """
    flat = captures.where("response is not null").select(
        "page_id", F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("named"),
        F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("own_digest"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"),
    )
    ends = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "has_request", "has_metadata"]
    full = flat.where("record_type = 'response'")
    first = full.select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"))
    # Only responses that some revisit names take part in the join, and those whose payload many share are few against the revisits.
    again = flat.where("record_type = 'revisit'").select("page_id", "record_type", "named", "has_request", "has_metadata").join(first, "named", "left")
    return full.withColumnsRenamed({"own_bytes": "payload_bytes", "own_digest": "payload_digest"}).withColumn("refers_to", F.lit(None).cast("long")).select(*ends).unionByName(again.select(*ends))
