"""Content-addressed web archive.

Payload bytes are stored once, in a table keyed by their digest. The exact header of every record
is stored apart, with the digest it points to. Records are rebuilt by joining the two, and every
payload that comes back is digested again and compared with its key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brisa.session import shared_folder

#: Fixed values of the record format.
VERSION, BREAK = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of a SHA-1 digest given as 40 hexadecimal digits: ten digits are 40 bits
    and so eight letters."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def payload_digest(payload: Column) -> Column:
    return base32(F.upper(F.sha1(payload)))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; nothing if the value is null. Line breaks inside a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit(BREAK)), F.lit(""))


def header(kind: Column, page_id: Column, url: Column, refers_to: Column, digest: Column, size: Column, date: str) -> Column:
    """The header of a record, up to and with the empty line that ends it. A revisit has no block."""
    revisit = kind == "revisit"
    return F.concat(
        F.lit(VERSION + BREAK), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id(page_id)),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url),
        _line("WARC-Refers-To", F.when(revisit, record_id(refers_to))), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")), F.lit(BREAK))


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write `pages` as `folder`/payloads (digest, payload) and `folder`/headers (page_id, digest,
    header); return the folder (a new one in the shared folder unless given).

    Of pages with equal payloads of at least `min_bytes` bytes the one with the largest id is the
    response and the others are revisits of it; smaller ones are all responses. Null html is an
    empty payload. Rows that repeat the largest id are all responses; a null id counts as the
    smallest, and is the response where all ids are null. A null url has no target line. Other
    columns are left out. The payload of a digest travels once per task that has read it."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/archive-{uuid.uuid4().hex[:12]}"
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    raw = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("size"))
    raw.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")

    light = raw.select("page_id", "url", "digest", "sha1", "size")
    owner = raw.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("owner"))
    first = (F.col("size") < min_bytes) | F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(first, F.lit("response")).otherwise(F.lit("revisit"))
    headers = light.join(owner, "digest").select(
        "page_id", "digest", header(kind, F.col("page_id"), F.col("url"), F.col("owner"), base32(F.upper("sha1")), F.col("size"), date).alias("header"))
    headers.write.parquet(f"{folder}/headers")
    return folder


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records rebuilt from an archive: page_id, header, payload_bytes, payload_digest, verified,
    and payload and record (header, block, two line breaks; binary) if asked for. `payload_bytes`,
    `payload_digest` and `verified` (its strong digest is its key) are taken from the bytes read."""
    stored = spark.read.parquet(f"{folder}/payloads").select(
        "digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        payload_digest(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("digest")).alias("verified"))
    headers = spark.read.parquet(f"{folder}/headers")
    joined = headers.join(stored if with_payload else stored.drop("payload"), "digest", "left")
    found = joined.select("page_id", "header", "payload_bytes", "payload_digest", F.coalesce("verified", F.lit(False)).alias("verified"),
                          *(["payload"] if with_payload else []))
    if not with_payload:
        return found
    block = F.when(field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return found.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.lit((BREAK * 2).encode())))


def field(headers: Column, name: str) -> Column:
    """Value of a header line; null if the header has none."""
    value = F.regexp_extract(headers, f"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def page_of(record: Column) -> Column:
    return F.nullif(F.regexp_extract(record, "^<urn:page:(.*)>$", 1), F.lit("")).try_cast("long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, **names: str) -> DataFrame:
    """Write an archive of `pages`, read it back and return one row per record: page_id,
    payload_bytes, payload_digest, record_type and refers_to, as the archive has them, and
    verified: the bytes carry both digests they are filed under. An empty table gives no rows."""
    folder = write_archive(pages, min_bytes=min_bytes, **names)
    records, text = read_records(pages.sparkSession, folder, with_payload=False), F.col("header")
    return records.select(
        page_of(field(text, "WARC-Record-ID")).alias("page_id"), "payload_bytes", "payload_digest",
        field(text, "WARC-Type").alias("record_type"), page_of(field(text, "WARC-Refers-To")).alias("refers_to"),
        (F.col("verified") & (field(text, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest"))).alias("verified"))
