"""WARC archives: writing, reading and resolution of revisit records.

Payloads are hashed and written once, with a number for each row. Headers (number, id, digest, length) are shuffled by payload
digest; each group's smallest id is the response and the others become revisit records that refer to it. Archives are
written by Spark's text sink, one record a row: the sink's line separator is the CRLF that ends a record.
Reading takes each archive as a whole file and walks it by Content-Length, so a payload may hold any bytes; so archives
are bounded by bytes. A record that is cut off is an error, and records read are held against those written.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.columns import small
from tablewright.plans.scratch import Scratch

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive's payloads together have at most so many bytes, unless it is of one larger payload.
ARCHIVE_BYTES = 1 << 26
#: Records of an archive at most, so that those of small payloads, whose headers are most of them, are bounded too.
ARCHIVE_RECORDS = 1 << 14

RECORD_SCHEMA = "record_id string, record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, refers_to_record string, payload binary"


def base32_of_sha1(sha1_hex: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hex digits: four groups of 40 bits, each eight letters."""
    groups = [F.conv(F.substring(sha1_hex, 10 * g + 1, 10), 16, 10).cast("long") for g in range(4)]
    letters = [F.lit(BASE32).substr((F.shiftright(g, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for g in groups for k in range(8)]
    return F.concat(*letters)


def payload_headers(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``pages`` with payload (null: empty), payload_digest, payload_bytes and row_id, which numbers the rows once written."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload"))
        .withColumn("sha1_hex", F.sha1("payload"))
        .select(F.monotonically_increasing_id().alias("row_id"), "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_sha1(F.col("sha1_hex")).alias("payload_digest"))
    )


def revisit_roles(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(row_id, original: page_id, row_id and url) of the rows of ``headers`` that revisit another.

    Payloads under ``min_bytes`` are always responses. Rows that tie for the smallest page_id are repeats of one page
    and all stay responses; a null page_id comes after every other.
    """
    slim = headers.select("row_id", "page_id", "url", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= min_bytes)
    least = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row_id", "url")).alias("original")
    firsts = slim.groupBy("payload_digest").agg(least, F.count("*").alias("n")).filter("n > 1")
    # Only digests met twice or more come here; their pages are the ones that can be revisits.
    return slim.join(firsts, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("original.page_id"))).select("row_id", "original")


def _record_id(row_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", row_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def record_text(date: str) -> Column:
    """One record without its last CRLF, from row_id, page_id, url, payload, payload_bytes, payload_digest, original."""
    original = F.col("original")
    revisit = original.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    uri = lambda c: F.regexp_replace(c, r"[\x00-\x20]", "")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("row_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        line("WARC-Refers-To", F.when(revisit, _record_id(original["row_id"], F.col("payload_digest")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, uri(original["url"]))),
        line("WARC-Refers-To-Date", F.when(revisit, date)),
        line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
        block,
        F.lit(CRLF),
    )


def archive_of(row_id: Column, size: Column, archive_bytes: int = ARCHIVE_BYTES, records: int = ARCHIVE_RECORDS) -> Column:
    """Name of the archive that a row goes to, without a look at any other row.

    Rows are told apart by the power of two that bounds their size. Of a class bounded by s bytes, so many consecutive row
    numbers share an archive as payloads of s bytes fit into one; rows of other classes between them only leave room.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int"))
    run = F.greatest(F.lit(1), F.least(F.lit(records), F.floor(F.lit(float(archive_bytes)) / F.pow(F.lit(2.0), bits))).cast("long"))
    return F.concat_ws("-", bits.cast("string"), F.floor(row_id / run).cast("string"))


def write_deduplicated(pages: DataFrame, path: str, scratch: Scratch, min_bytes: int = 0, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Writes a record per row of ``pages`` (page_id, url, html) as gzip archives under ``path``; returns their number.

    Null html is an empty payload, a null url has no target header, a null page_id no id header. Repeated rows have a record
    each, of its own id. Very long payloads have archives of their own. Other columns are ignored, whatever their names.
    An empty table gives a folder without records. ``date`` is that of all records, by default the time of writing.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = scratch.table(payload_headers(pages), "payloads")
    roles = small(scratch.table(revisit_roles(rows, min_bytes), "roles"), text=F.col("original.url"))
    full = rows.join(roles, "row_id", "left")
    size = F.when(F.col("original").isNull(), F.col("payload_bytes")).otherwise(0)
    records = full.select(record_text(date).alias("value"), archive_of(F.col("row_id"), size, archive_bytes).alias("archive"))
    records.write.option("lineSep", CRLF).option("compression", "gzip").partitionBy("archive").text(path)
    return rows.count()


def inflate(raw: bytes) -> bytes:
    """Plain bytes of an archive: gzip members one after another, or no gzip at all."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    parts = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(parts)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; a record that is cut off is an error."""
    at = 0
    while True:
        start = data.find(b"WARC/", at)
        if start < 0:
            if data[at:].strip():
                raise ValueError("what follows the last record is no record")
            return
        end = data.find(b"\r\n\r\n", start)
        headers = {}
        for line in data[start:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", "0"))
        at = end + 4 + length
        if end < 0 or at > len(data):
            raise ValueError("an archive ends within a record")
        yield headers, data[end + 4 : at]


def _read_batches(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
    for batch in batches:
        for raw in batch.column(0):
            rows: list[tuple] = []
            for head, block in parse_records(inflate(raw.as_py())):
                page = head.get("x-page-id")
                said = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                common = (head.get("warc-record-id"), head.get("warc-type"), int(page) if page else None, head.get("warc-target-uri"))
                if head.get("warc-type") == "revisit":
                    rows.append((*common, said, None, None, head.get("warc-refers-to"), None))
                    continue
                body = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                rows.append((*common, digest, len(body), said in (None, digest), None, body if with_payload else None))
            for i in range(0, len(rows), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 512]), types)], names=names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of all archives under ``path``; digests and lengths come from the payloads themselves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(lambda it: _read_batches(it, with_payload), RECORD_SCHEMA)


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Records with refers_to (page_id of the original) and the original's length on every revisit.

    Responses have no key to join on and so never meet in one task; a revisit without its original keeps nulls.
    """
    slim = records.select("record_id", "record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "digest_ok", "refers_to_record")
    responses = slim.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("original_bytes"))
    originals = scratch.table(originals, "originals")
    found = slim.filter("record_type = 'revisit'").join(originals, "refers_to_record", "left").withColumn("payload_bytes", F.col("original_bytes")).drop("original_bytes")
    return responses.unionByName(found)


def all_sound(records: DataFrame, written: int) -> DataFrame:
    """``records``, a written table, if it has as many as were written, their ids differ and their digests are right."""
    seen = records.agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids"), F.count_if(~F.col("digest_ok")).alias("bad")).first()
    if (seen["n"], seen["ids"], seen["bad"]) != (written, written, 0):
        raise ValueError(f"{written} records were written; read {seen['n']} with {seen['ids']} ids, {seen['bad']} of another digest")
    return records


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as deduplicated archives, reads them back and resolves the revisits: one row per page."""
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    written = write_deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, scratch)
    records = all_sound(scratch.table(read_archives(spark, path).drop("payload"), "records"), written)
    return resolve_revisits(records, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH h AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
