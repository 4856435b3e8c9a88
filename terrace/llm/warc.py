"""WARC archives with revisit resolution.

Headers (page id, digest, length) are shuffled by payload digest, without payloads; each digest gets its original response; records join it,
and archives are written with fresh headers: responses carry the payload, revisits only name it. Files are gzipped WARC/1.1 text written by
Spark's text writer, whose line separator is the record separator; they are read back with the binary reader and cut by Content-Length.
Payloads are shuffled once, into the partition of their archive.

Length and digest of a response are those of the payload bytes read back; a header that says otherwise raises.

Null html is an empty payload; a null url is an empty target. A null page id sorts below all others; a group of nulls only stays as responses. Rows that repeat the
largest page id of their payload all stay responses. Payloads shorter than `least` bytes are never revisits. Extra columns take no part.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import stored
from terrace.session import scratch_path

RECORD_END = "\r\n\r\n"
LEAST = 1000
FILE_BYTES = 16 << 20
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def resolved(pages: DataFrame, least: int = LEAST, partitions: int | None = None) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of every page, dealt by digest and page over `partitions`."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    # one row per digest that repeats; summed up before the shuffle, so a hot payload is one row per map task
    first = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and original is not null").select("payload_digest", "original")
    first = stored(first, "warc-originals")
    headers = own.select("page_id", "payload_digest").distinct().join(first, "payload_digest").where("page_id is null or page_id < original")
    # The join meets payload rows only with their own header. Its key has no null, so that it keeps the partitions of `dealt`.
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_key")
    headers = headers.select("payload_digest", page, "original")
    dealt = own.select("*", page).repartition(*[partitions] if partitions else [], "payload_digest", "page_key")
    joined = dealt.join(headers, ["payload_digest", "page_key"], "left")
    kind = F.when(F.col("original").isNotNull(), "revisit").otherwise("response")
    return joined.select(*own.columns, kind.alias("record_type"), F.col("original").alias("refers_to"))


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """One column `value`: header, blank line and payload of each record."""
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    target = F.regexp_replace("url", "[\\r\\n]", " ")
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")), F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")), F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))), F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), body).alias("value"))


def write_archives(rows: DataFrame, path: str) -> None:
    """One archive for each partition of `rows`, or several of at most FILE_RECORDS records."""
    records(rows).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).text(path, compression="gzip")


HEADER = re.compile(rb"([^:\r\n]+):[ ]?([^\r\n]*)\r\n")


def parsed(data: bytes):
    """(headers, payload) of each record of an archive; a damaged one raises."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(HEADER.findall(data, data.index(b"\r\n", at) + 2, end + 2))
        start, size = end + 4, int(head[b"Content-Length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield head, data[start : start + size]
        at = start + size + 4


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under `path`. Files are bounded by the writer, so a task holds one at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(head, key):
        return int(head[key]) if key in head else None

    def read(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, body in parsed(gzip.decompress(data.as_py())):
                    kind = head[b"WARC-Type"].decode()
                    size, digest = number(head, b"X-Payload-Length"), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if kind == "response":
                        told, (size, digest) = (size, digest), (len(body), hashlib.sha1(body).hexdigest())
                        if told != (size, digest):
                            raise ValueError(f"the payload of {head[b'WARC-Record-ID'].decode()} has {size} bytes and digest {digest}, its header says {told}")
                    rows.append((number(head, b"X-Page-Id"), head[b"WARC-Target-URI"].decode(), size, digest, kind, number(head, b"X-Refers-To-Page"), body if payload and kind == "response" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, PARSED)


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the deduplicated archives of `pages` to the shared folder and return what is read back from them."""
    path = scratch_path(pages.sparkSession, "warc")
    most = pages.agg(F.sum(F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)) + 600)).first()[0] or 0  # bytes, before revisits
    files = max(-(-int(most) // FILE_BYTES), pages.sparkSession.sparkContext.defaultParallelism)
    write_archives(resolved(pages, least, files), path)
    return read_archives(pages.sparkSession, path, payload=False).drop("payload")
