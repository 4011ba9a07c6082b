"""WARC archives: written and read by Spark, with revisits of equal payloads resolved by digest.

An uncompressed WARC record ends with two line ends, so Spark's text writer, told to end rows so, makes WARC files
on whatever store the session writes to; gzip wraps each file. Reading goes by Content-Length through binaryFile.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import scratch_dir, stored

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are stored every time.
LEAST = 100
#: Pages up to so many bytes, and how many of them an archive holds: 64 MB at most, or one page.
SHELVES = ((1 << 15, 2000), (1 << 20, 64), (1 << 62, 1))


def resolved(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """headers(page_id, digest, payload_bytes, ...) with refers_to: null for responses, else the response's page_id.

    Of equal payloads of least bytes or more, the smallest page_id is the response (all rows that share it are).
    Only headers are shuffled, and per digest only a minimum is kept; copies may be a third of all rows.
    """
    firsts = headers.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = headers.join(firsts, "digest", "left")
    again = (F.col("payload_bytes") >= least) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x20\\x7F]", "_")


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record text a row of pages(page_id, url, html, digest, refers_to): header, block."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    html, again = F.coalesce(F.col("html"), F.lit("")), F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, html))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", _clean(F.col("url")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, *, least: int = LEAST, shelves: tuple = SHELVES) -> None:
    """Writes a record for each row of pages(page_id, url, html) under path; html null: empty.

    shelves: sizes of pages and records a file, so that a file is small enough to be read whole."""
    digest = F.sha2(F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8"), 256)
    pages = pages.select("page_id", "url", "html")
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    headers = stored(pages.select("page_id", digest.alias("digest"), size.alias("payload_bytes")), "headers")
    again = resolved(headers, least).where("refers_to is not null").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))
    again = stored(again, "revisits")
    largest, below = headers.agg(F.max("payload_bytes")).first()[0], -1
    for k, (upto, most) in enumerate(shelves):
        if k and (largest is None or largest <= below):
            break
        whole = _attached(pages.where((size > below) & (size <= upto)).withColumn("digest", digest), again)
        records(whole).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
        below = upto


def _attached(pages: DataFrame, again: DataFrame) -> DataFrame:
    """pages with refers_to, joined on page and digest, null pages too."""
    key = lambda c: F.coalesce(c, F.lit(-(1 << 62)))
    right = again.select(key(F.col("page_id")).alias("_page"), "digest", "refers_to")
    return pages.withColumn("_page", key(F.col("page_id"))).join(right, ["_page", "digest"], "left").drop("_page")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of an archive, gzip (one member or many) or plain."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data))
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


READ = "record_id string, record_type string, url string, refers_to_id string, header_digest string, digest string, payload_bytes long"


def _read_rows(payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64()] + ([pa.binary()] if payload else [])
        names = [x.split()[0] for x in READ.split(", ")] + (["payload"] if payload else [])
        for batch in batches:
            for data in batch.column(0):
                out = []
                for f, block in parse(data.as_py()):
                    body = block.partition(b"\r\n\r\n")[2] if "application/http" in f.get("content-type", "") else block
                    again = f["warc-type"] == "revisit"
                    row = (f.get("warc-record-id"), f["warc-type"], f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").partition(":")[2], None if again else hashlib.sha256(body).hexdigest(), None if again else len(body))
                    out.append((*row, body) if payload else row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return read


def read_archives(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """The records under path: headers, the digest and bytes of the payload as stored (null for revisits), and the
    payload if asked for. A file is read whole; write_archives keeps files small."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_rows(payload), READ + (", payload binary" if payload else ""))


def followed(found: DataFrame) -> DataFrame:
    """Records with the payload digest and size of revisits taken from the response that they refer to."""
    others, again = found.where("record_type <> 'revisit'"), found.where("record_type = 'revisit'")
    cited = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("digest").alias("_d"), F.col("payload_bytes").alias("_n"))
    wanted = again.select("refers_to_id").distinct()
    cited = cited.join(wanted, "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    # Records that refer to nothing stay where they are: they'd all share a null key.
    again = again.join(cited, "refers_to_id", "left").withColumn("digest", F.coalesce("digest", "_d")).withColumn("payload_bytes", F.coalesce("payload_bytes", "_n"))
    return others.unionByName(again.select(*found.columns))


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archives pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null and empty html: payloads of no bytes. Repeated rows are alike; a null page_id sorts after none and is never
    referred to; an empty table gives none; other columns aren't looked at. path: where the archives stay
    (by default a fresh folder under the shared one).
    """
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    found = followed(stored(read_archives(spark, path), "records"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to_id").alias("refers_to"))
