"""Content-addressed WARC archive.

Three tables replace the usual file: payload bytes once per strong digest, the exact header block of every record, and
nothing else. The original records come back by joining both, and every payload is checked against its address.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recontact.llm.common import ensure_checkpoint_dir, numbered, prepare, written

#: Payloads shorter than this are written as responses even when they repeat.
LEAST_SHARED = 1000
CRLF = "\r\n"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(CRLF))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, address (SHA-256), payload_digest (SHA-1).

    Null bodies are empty payloads; null keys and urls stay null.
    """
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b""))
    return (pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
            .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("address", F.unhex(F.sha2("payload", 256))).withColumn("payload_digest", F.sha1("payload")))


def record_uuid(archive_id: str, record: Column) -> Column:
    """A name-based UUID (version 5 layout) of a record of an archive: repeated and null page_ids have their own."""
    digest = F.sha1(F.concat(F.lit(f"{archive_id}/"), record.cast("string")).cast("binary"))
    part = lambda start, size: F.substring(digest, start, size)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)),
                                                    F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))


def _target(url: Column) -> Column:
    """The target lines: the URL with its line breaks escaped and, where that is not the URL itself, its exact form."""
    plain = F.coalesce(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), F.lit(""))
    exact = (F.when(url.isNull(), _line("X-Target-URI", "null"))
             .when(url.rlike(r"[\r\n]") | (F.trim(url) != url) | (url == ""), _line("X-Target-URI", F.concat(F.lit("hex:"), F.hex(F.encode(url, "UTF-8")))))
             .otherwise(F.lit("")))
    return F.concat(_line("WARC-Target-URI", F.when(F.trim(plain) == "", F.lit("about:blank")).otherwise(plain)), exact)


def store(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", date: datetime | None = None) -> None:
    """Write ``payloads`` and ``headers`` below the folder.

    A header block is the record's WARC header and, as its content begins with it, the HTTP head of the answer the payload came with.
    ``date``: the WARC-Date of all records, by default the time of the call (the tables hold none). URLs come back exactly, null ones too.

    Of rows with equal payloads (equal SHA-256 and length) of at least ``LEAST_SHARED`` bytes, the one with the
    largest page_id becomes the response and the others revisit it (a null page_id is smaller than all; of repeated rows with
    one page_id, one is the response). Shorter payloads are all responses.
    Only keys and digests are shuffled to find the holders, counted before the exchange; they are numbered in a written
    table, and the payloads are found by digest and page_id, so no number is worked out twice.
    """
    prepare(pages.sparkSession)
    rows = records(written(pages, "pages"), key, url, body)
    # Everything but the payloads is numbered and written once.
    light = numbered(rows.drop("payload"), "record", "records")
    # A digest that a third of the pages share is one partial maximum per task.
    best = light.groupBy("address", "payload_bytes").agg(F.max(F.struct("page_id", "record")).alias("holder"))
    heads = (light.join(best, ["address", "payload_bytes"])
             .withColumn("holds", F.col("record") == F.col("holder.record"))
             .withColumn("record_type", F.when(F.col("holds") | (F.col("payload_bytes") < LEAST_SHARED), "response").otherwise("revisit"))
             .withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("holder.page_id"))))
    address = F.lower(F.hex("address"))
    archive_id = uuid.uuid4().hex
    number = lambda page: F.coalesce(page.cast("string"), F.lit(""))
    moment = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", size), F.lit(CRLF))
    stored = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", record_uuid(archive_id, F.col("record"))),
        _line("WARC-Date", moment), _target(F.col("url")), _line("X-Page-ID", number(F.col("page_id"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(
            _line("WARC-Refers-To", record_uuid(archive_id, F.col("holder.record"))), _line("X-Refers-To-Page", number(F.col("refers_to"))),
            _line("WARC-Refers-To-Date", moment), _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("X-Payload-Address", F.concat(F.lit("sha256:"), address)), _line("X-Payload-Length", size),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", stored.cast("string")), F.lit(CRLF), http)
    heads.select("address", "record", header.cast("binary").alias("header")).write.parquet(f"{folder}/headers")
    # A row with the holder's payload and page_id writes the bytes, whatever its number: equal rows become one before the exchange.
    same = ["address", "payload_bytes", "page"]
    page = lambda page_id: F.coalesce(page_id.cast("string"), F.lit("")).alias("page")
    holders = best.select("address", "payload_bytes", page(F.col("holder.page_id")))
    bodies = rows.select("address", "payload_bytes", page(F.col("page_id")), "payload").dropDuplicates(same)
    bodies.join(holders, same, "left_semi").select("address", "payload").write.parquet(f"{folder}/payloads")


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """record (the original bytes of a WARC record), header, payload: one row per stored header.

    The content block of a revisit is the HTTP head alone, as it was written; ``payload`` is the full one either way. Raises if the
    bytes do not have the digest they are stored under, or if a header finds no payload.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    held = payloads.withColumn("payload", F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload"))
                               .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")))
    headers = spark.read.parquet(f"{folder}/headers")
    joined = headers.join(held, "address", "left")
    payload = F.when(F.col("payload").isNull(), F.raise_error(F.lit("a record's payload is not stored")).cast("binary")).otherwise(F.col("payload"))
    whole = joined.select("header", payload.alias("payload"))
    block = F.when(F.col("header").contains(b"WARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return whole.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def parse(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, as the archive's records say.

    The digest and length are taken again from the reconstructed payload and must agree with the header's.
    """
    head = F.col("header").cast("string")
    value = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    page = lambda name: F.nullif(F.regexp_extract(head, rf"\r\n{name}: (-?\d*)\r\n", 1), F.lit("")).cast("long")
    exact = value("X-Target-URI")
    url = (F.when(exact == "null", F.lit(None).cast("string")).when(exact.startswith("hex:"), F.decode(F.unhex(F.substring(exact, 5, 1 << 30)), "UTF-8"))
           .otherwise(value("WARC-Target-URI")))
    rows = found.select(
        page("X-Page-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), value("WARC-Type").alias("record_type"), page("X-Refers-To-Page").alias("refers_to"),
        url.alias("url"), value("WARC-Payload-Digest").alias("said"), value("X-Payload-Length").cast("long").alias("said_bytes"))
    agrees = (F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest"))) & (F.col("said_bytes") == F.col("payload_bytes"))
    return rows.withColumn("payload_digest", F.when(agrees, F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a record's header does not agree with its payload")).cast("string"))).drop("said", "said_bytes")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write the rows to a new archive in the shared folder, read it back and parse its records."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()}/archive-{uuid.uuid4().hex}"
    store(pages, folder, key, url, body)
    return parse(reconstruct(spark, folder))
