import gzip
import hashlib
import io
from pathlib import Path

from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameWriter

from pagemill.llm import warc

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.StringType())])


def pages(spark):
    big, bigger = "<p>é</p>" * 150, "<p>WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1</p>" * 4000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", bigger), (9, "u", bigger), (9, "u", bigger), (None, "u", big), (10, "u", "x" * 1000), (11, "u", "x" * 1000), (12, "u", "y" * 999), (13, "u", "y" * 999)]
    return spark.createDataFrame([(*r, "d", "n") for r in rows], PAGE).repartition(3)


def expected(rows):
    raw = [(r.page_id, (r.html or "").encode()) for r in rows]
    out = []
    for i, b in raw:
        best = max((j for j, c in raw if c == b and j is not None), default=None)
        revisit = len(b) >= 1000 and i is not None and i < best
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_odd_pages(spark):
    src = pages(spark)
    got = warc.digests(src)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(src.collect())
    assert warc.digests(spark.createDataFrame([], PAGE)).collect() == []


def test_table(spark, sf):
    src = spark.read.parquet(f"{sf}/pages.parquet")
    src = src.union(src.selectExpr("page_id + 1000", "url", "html"))
    assert sorted(map(tuple, warc.digests(src).collect()), key=str) == expected(src.collect())


def test_files_are_warc(spark, tmp_path):
    warc.write_archives(pages(spark), f"file://{tmp_path}/w")
    records = [r for f in Path(tmp_path, "w").glob("*.gz") for r in warc.parse(io.BytesIO(gzip.decompress(f.read_bytes())))]
    assert len(records) == 15
    ids = {h["warc-record-id"] for h, _ in records if h["warc-type"] == "response"}
    for head, block in records:
        assert int(head["content-length"]) == len(block) and block.startswith(b"HTTP/1.1 200 OK\r\n")
        if head["warc-type"] == "revisit":
            assert head["warc-refers-to"] in ids and head["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
        else:
            assert hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).hexdigest() == head["warc-payload-digest"].removeprefix("sha1:")


def test_payloads_are_moved_once(spark, sf, tmp_path, monkeypatch):
    plans, text = [], DataFrameWriter.text
    monkeypatch.setattr(DataFrameWriter, "text", lambda self, path: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or text(self, path))
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    monkeypatch.setattr(warc, "LEAST_ARCHIVE", 10_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = spark.read.parquet(f"{sf}/pages.parquet")
        warc.write_archives(src, f"file://{tmp_path}/w")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The last plan is the archives'; its first branch holds the payloads, and the join's other one none.
    payloads = plans[-1].split("HashAggregate")[0]
    assert "ShuffledHashJoin" in payloads and "SortMergeJoin" not in payloads and payloads.count("Exchange hashpartitioning") == 2
    size = sum(len((r.html or "").encode()) for r in src.collect())
    assert 1 < len(list(Path(tmp_path, "w").glob("*.gz"))) <= -(-size // 20_000)
