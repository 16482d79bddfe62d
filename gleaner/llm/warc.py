"""WARC archives without repeated payloads.

Of the pages with equal payloads, one is written as the response and the
others as revisit records that refer to it.  Which is which is decided on
headers alone, grouped by payload digest; only the digests that repeat are then
joined to the pages, so payloads move only where there are too many of these to
broadcast.  Every record gets fresh headers and the archives are written, one
gzip file a partition, through Spark's file committer.  Reading goes record by
record, by Content-Length, and joins revisit records to the responses whose
record ids they name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, new_path, sized_join, stage

#: Payloads with fewer bytes are always written whole.
LEAST_BYTES = 1000
#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to gzip files at path.

    The payload is the html in UTF-8 (null: empty).  Of payloads of at least
    `least` bytes that are equal, that with the greatest page_id is the
    response; rows with a null page_id are always responses, as nothing can
    refer to them, and so are all rows with the same greatest page_id.  A null
    url leaves its header out; control characters in a url are percent-encoded.
    Record ids are random, but those of responses that others refer to come from
    page_id and digest, so that a task that is run again writes what they name.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keep = p.filter((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows"))
    keep = stage(keep.filter("rows > 1").drop("rows"), "warc-repeated")
    p = sized_join(p, keep, "digest").select("page_id", "url", "html", "n", "digest", "keeper")
    revisit = F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(False))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20\\x7F]", "%20")
    known = F.regexp_replace(F.md5(F.concat_ws(" ", F.col("keeper").cast("string"), "digest")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-8$4-$5")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    p = p.withColumn("http", http)
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), F.when(F.col("page_id") == F.col("keeper"), known).otherwise(F.uuid()),
        F.lit(">\r\nWARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.coalesce(F.concat(F.lit("\r\nX-Page-ID: "), F.col("page_id").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:uuid:"), known, F.lit(">\r\nWARC-Profile: " + PROFILE))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit(END),
    )
    record = F.concat(head, F.col("http"), F.when(revisit, "").otherwise(F.col("html")))
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        k, _, v = line.partition(b":")
        out[k.strip().decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of files, cut before each version line, are put together to records again by Content-Length."""
    sep, ver = (END + VERSION).encode(), VERSION.encode()
    held, need, path, head = [], 0, None, {}

    def number(v: str | None) -> int | None:
        return int(v) if v and v.lstrip("-").isdigit() else None

    for b in batches:
        rows: list[tuple] = []
        for piece, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if at != path:
                if held:
                    raise ValueError(f"{path}: a record is cut short")
                path, piece = at, piece.removeprefix(ver)
            if held:
                held += [sep, piece]
            else:
                block, _, rest = piece.partition(END.encode())
                head = _headers(block)
                need, held = int(head["content-length"]), [rest]
            if sum(map(len, held)) < need:
                continue
            body, held = b"".join(held)[:need], []
            http, _, payload = body.partition(END.encode())
            kind = head.get("warc-type")
            rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), kind, head.get("warc-record-id"), head.get("warc-refers-to"), (head.get("warc-payload-digest") or "").removeprefix("sha1:"), payload if kind == "response" else None))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], ["page_id", "url", "record_type", "record_id", "refers_to", "digest", "payload"])
    if held:
        raise ValueError(f"{path}: a record is cut short")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, record_id, refers_to (a record id), digest (as the header has it), payload (null for revisits)."""
    text = spark.read.option("lineSep", END + VERSION).text(path)
    return arrow_map(text.select(F.col("value").cast("binary"), F.input_file_name().alias("file")), _parse, "page_id long, url string, record_type string, record_id string, refers_to string, digest string, payload binary")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: revisits have those of the response they refer to."""
    r = records.select("page_id", "url", "record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    known = r.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.struct("page_id", "n", "sha")).alias("of"))
    again = r.filter("record_type = 'revisit'").join(known, "refers_to", "left").select("page_id", "url", F.col("of.n").alias("payload_bytes"), F.col("of.sha").alias("payload_digest"), "record_type", F.col("of.page_id").alias("refers_to"))
    one = r.filter("record_type = 'response'").select("page_id", "url", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return one.unionByName(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives to the shared folder, read them back and resolve the revisits.  One row out for each row in."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return resolve_revisits(read_archives(spark, path))
