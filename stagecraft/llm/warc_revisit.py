"""WARC archives in which repeated payloads are revisit records.

Only narrow headers (id, digest, length) are grouped by digest, with partial aggregation,
so a payload that a third of all pages share is one row per map task. Digests found on
several pages are joined back to the headers by ``lookup_counted``: those of very many
pages are answered from a broadcast, so they do not meet in one task. Payloads cross the
network once, to be written next to their fresh headers. Archives are gzip files of at
most ``RECORDS`` records, read as streams, one record at a time; Spark's committer replaces
the files of a lost task.

Defined results: a null html is the empty payload. Of equal payloads of at least
``LEAST`` bytes the record with the largest page_id is the response (all of them, should
the id repeat; a null id counts as smallest); smaller payloads are all responses. Line
breaks in a url are percent-encoded in the header. No pages, no archive, no rows.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.llm.words import batched
from stagecraft.operators.skew import lookup_counted

LEAST, RECORDS = 1000, 20_000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolve(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """For each page whose payload stands on several rows: digest, length and the page that
    holds the payload (``holder``)."""
    heads = pages.select(
        F.col("page_id").cast("bigint"), "url",
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload")
             .cast("bigint").alias("bytes")).where(F.col("bytes") >= least)
    shared = heads.groupBy("digest", "bytes").agg(
        F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    return lookup_counted(heads, shared, ["digest", "bytes"]).distinct()


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    made = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        made, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """One text per page: a whole WARC record but for its closing line breaks."""
    wide = pages.select(F.col("page_id").cast("bigint"), "url",
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    wide = wide.withColumns({"digest": F.sha1("payload"),
                             "bytes": F.octet_length("payload").cast("bigint")})
    known = resolve(pages, least).select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"),
        F.col("bytes").alias("_bytes"), "holder")
    joined = wide.join(known, wide.page_id.eqNullSafe(known._id)
                       & (wide.digest == known._digest) & (wide.bytes == known._bytes), "left")
    again = F.coalesce(F.col("holder") != F.coalesce("page_id", F.col("holder") - 1), F.lit(False))
    block = F.concat(F.lit(_HTTP), F.when(again, "").otherwise(F.col("payload")))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _field("WARC-Target-URI", url),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Profile", F.when(again, (
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(again, _record_id(F.col("holder"), F.col("digest")))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block)),
        _field("X-Page-Id", F.col("page_id")),
        _field("X-Payload-Length", F.col("bytes")),
        _field("X-Refers-To-Page-Id", F.when(again, F.col("holder")))]
    return joined.select(F.concat(F.lit("WARC/1.1"), *lines, F.lit(_END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE,
                   records_per_file: int = RECORDS) -> None:
    records(pages, least, date).write.option("lineSep", _END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(stream):
    """Headers and block of each record, by Content-Length; holds one record at a time."""
    while stream.readline():  # the version
        fields = {}
        while (line := stream.readline().decode().rstrip("\r\n")):
            name, value = line.split(": ", 1)
            fields[name] = value
        yield fields, stream.read(int(fields["Content-Length"]))
        stream.read(4)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Length and digest of a response are taken from its payload."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
        ("record_id", pa.string())])

    def fill(batch):
        for content in batch["content"]:
            for fields, block in parse(gzip.open(pa.BufferReader(content.as_buffer()))):
                payload = block.partition(b"\r\n\r\n")[2]
                size = int(fields["X-Payload-Length"])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                number = [int(fields[k]) if k in fields else None
                          for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                yield (number[0], size, digest, fields["WARC-Type"], number[1],
                       fields.get("WARC-Target-URI"), fields["WARC-Record-ID"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(
        batched(schema, fill), "page_id bigint, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint, url string, record_id string")
