"""WARC archives: revisit records resolved to responses, deduplicated archives written and read.

Headers alone are shuffled by payload digest to find, for each payload that repeats, the response
that the others revisit; a hot digest meets only partial maxima and a salted join. Payloads are moved
once, by page, to the writer, into as many archives as their bytes need. Archives are written by Spark's
text writer with the record end as line separator, so they can lie in any store that Spark reaches and
its commit protocol holds for them; the writer names them ``part-*.txt.gz``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import scratch_path, ship, written

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Headers of one digest beyond which it is broadcast (at most HOT digests are), and bytes of payload meant for an archive, at most and at least.
COLD, HOT, ARCHIVE, LEAST_ARCHIVE = 2048, 50_000, 128_000_000, 1_000_000

RECORD = "page_id long, url string, record_type string, record_id string, payload_digest string, payload_bytes long, refers_to_id string"


def roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, digest, refers_to for the pages that become revisits of the page refers_to.

    Of pages with equal payloads of ``least`` bytes or more, that with the largest page_id is the
    response. Pages with a null page_id are never in it.
    """
    head = pages.select("page_id", "digest", "payload_bytes").where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    best = written(head.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    return met(head, best, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def met(rows: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """rows joined to best, which has a row and the number n of rows for each key; frequent keys are broadcast."""
    line = max(COLD, (best.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(best.where(F.col("n") > line))
    return rows.join(hot, key).unionByName(rows.join(best.where(F.col("n") <= line), key))


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Gzipped WARC 1.1 files of about ``ARCHIVE`` bytes: a response or a revisit record for each row of pages.

    Payload: html in UTF-8, null html the empty payload. Rows with a null page_id have no page header;
    a null url has no target header; line breaks in a url become spaces. Rows that repeat page_id and
    payload are each written, in the same role. No rows make an archive of no records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    size = rows.agg(F.sum("payload_bytes")).first()[0] or 0
    # Payloads are dealt to their archives here and meet their roles there; the join has nothing to move or sort again.
    archives = max(-(-size // ARCHIVE), min(rows.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_ARCHIVE)), 1)
    found = roles(rows, least).withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d").repartition(archives, "p", "d").hint("shuffle_hash")
    # A column made above the exchange keeps the join from raising its number of partitions.
    rows = rows.repartition(archives, "page_id", "digest").withColumn("url", F.regexp_replace("url", r"[\r\n]+", " "))
    rows = rows.join(found, (rows.page_id == found.p) & (rows.digest == found.d), "left").drop("p", "d")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_id(F.col("refers_to"), F.col("digest")))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(lines, F.lit(END), block).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 20000).text(path)


def parse(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an unpacked archive."""
    while line := raw.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := raw.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = raw.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for b in batches:
        for content in b.column(0).to_pylist():
            rows: list[tuple] = []
            for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                kind, page = head["warc-type"], head.get("x-page-id")
                payload = block.split(END.encode(), 1)[1] if kind == "response" else None
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
                rows.append((None if page is None else int(page), head.get("warc-target-uri"), kind, head["warc-record-id"], digest, None if payload is None else len(payload), head.get("warc-refers-to")))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, url, record_type, record_id, payload_digest, payload_bytes (null for revisits), refers_to_id.

    Each response's payload is checked against its digest; a damaged record raises ValueError.
    """
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content").mapInArrow(_records, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits joined to their responses."""
    revisits = records.where("record_type = 'revisit'")
    wanted = revisits.groupBy(F.col("refers_to_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    origin = records.where("record_type = 'response'").select(F.col("record_id").alias("id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes")).join(wanted, "id").dropDuplicates(["id"])
    own = revisits.withColumnRenamed("refers_to_id", "id")
    found = met(own, written(origin, "origins"), "id")
    lost = own.join(origin.select("id"), "id", "left_anti").withColumns({"refers_to": F.lit(None).cast("long"), "bytes": F.lit(None).cast("long"), "n": F.lit(0).cast("long")})
    found = found.unionByName(lost.select(found.columns))
    found = found.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    kept = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return kept.unionByName(found)


def digests(pages: DataFrame) -> DataFrame:
    """Archives of all pages are written to the shared folder, read back and resolved."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return resolve(written(read_archives(pages.sparkSession, path), "records"))
