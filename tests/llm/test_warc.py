import base64
import hashlib

from pyspark.sql import functions as F

from brisa.llm import warc as op4

COLUMNS = "page_id long, url string, html string, digest string, payload string"
PAGES = [(1, "http://a", "same", "x", "y"), (9, "http://b", "same", "x", "y"), (5, "u\r\nX-Evil: 1", "same", None, None), (2, None, None, "", ""), (3, "", "", "", ""),
         (4, "http://é", "é漢🤗\r\n\r\nWARC/1.1\r\n", "", ""), (7, "u", "once", "", ""), (7, "u", "once", "", ""), (None, "n", "null id", "", ""), (None, "n", "same", "", ""),
         (6, "long", "z" * 300_000, "", "")]


def expected(pages, least):
    for i, _, html, *_ in pages:
        raw = (html or "").encode()
        owner = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        first = len(raw) < least or i == owner
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else owner, True


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, COLUMNS)
    for least in (0, 1, 5):
        assert sorted(map(tuple, op4.archive_round_trip(df, least).collect()), key=str) == sorted(expected(PAGES, least), key=str)
    assert op4.archive_round_trip(df.limit(0)).count() == 0


def test_records_and_payloads(spark):
    folder = op4.write_archive(spark.createDataFrame(PAGES, COLUMNS))
    assert spark.read.parquet(folder + "/payloads").count() == len({p[2] or "" for p in PAGES})
    rows = op4.read_records(spark, folder).collect()
    by_id = {}
    for r in rows:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and not any(x.startswith("X-Evil") for x in lines)
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert block[int(fields["Content-Length"]):] == b"\r\n\r\n"
        by_id[r.page_id] = (fields, block[:-4])
    assert by_id[4][1].decode() == PAGES[5][2] and len(by_id[6][1]) == 300_000 and by_id[9][1] == b"same" and by_id[1][1] == b""
    assert by_id[1][0]["WARC-Refers-To"] == "<urn:page:9>" and "WARC-Target-URI" not in by_id[2][0]


def test_a_damaged_payload_is_seen(spark):
    folder = op4.write_archive(spark.createDataFrame(PAGES, COLUMNS))
    spark.read.parquet(folder + "/payloads").withColumn("payload", F.when(F.length("payload") == 4, F.lit(b"XXXX")).otherwise(F.col("payload"))).write.parquet(folder + "/2/payloads")
    spark.read.parquet(folder + "/headers").write.parquet(folder + "/2/headers")
    bad = {r.page_id for r in op4.read_records(spark, folder + "/2").filter("not verified").collect()}
    assert bad == {1, 9, 5, 7, None}
