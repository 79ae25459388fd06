import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from ontospark.llm import warc
from ontospark.llm.common import written

DATA = "/root/testdata/sf0.001"
BIG = "<html>é" + "x" * 1200
PAGES = [
    (1, "http://a/\r\nb c", BIG), (2, None, BIG), (2, None, BIG), (3, "http://x", None), (4, "", ""), (5, "http://é", "small"),
    (6, "u", "small"), (None, "u", BIG), (None, "u", "lonely" * 300), (7, "u", "y" * (600 << 10)),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id bigint, url string, html string, payload string, digest int").repartition(2)


def test_round_trip_of_odd_pages(spark, pages):
    stored = written(warc.bundles(warc.with_reference(pages)), "warc", "none")
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read(stored).collect()), key=str)
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        keeper = max(same) if len(data) >= 1000 and sum((h or "").encode() == data for _, _, h in PAGES) > 1 and same else page_id
        revisit = keeper != page_id
        want.append((page_id, "revisit" if revisit else "response", keeper if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else data))
    assert got == sorted(want, key=str)
    referred = warc.with_reference(pages)
    assert "Exchange hashpartitioning(digest" not in referred._jdf.queryExecution().executedPlan().toString()
    joined = warc.with_reference(pages, most=0)
    assert sorted(joined.collect(), key=str) == sorted(referred.collect(), key=str)


def test_bundles_are_zstd_and_seekable(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    stored = written(warc.bundles(warc.with_reference(pages)), "warc", "none")
    for row in stored.collect():
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(row.content), read_across_frames=True).read()
        frames = [warc.read_frame(row.content, i) for i in range(len(warc.frame_ranges(row.content)))]
        assert whole == b"".join(frames)
        assert max(map(len, frames)) <= warc.FRAME
        for r in row.records:
            record = frames[r.frame][r.offset : r.offset + r.length]
            assert warc.parse_record(record)["record_id"] == r.record_id
    some = pages.where("page_id % 7 = 3")
    got = {r.record_id: r.payload for r in warc.fetch(stored, some.select(F.col("page_id").alias("record_id"))).collect() if r.payload is not None}
    assert got and all(got[r.page_id] == r.html.encode() for r in some.collect() if r.page_id in got)
    joined = warc.fetch(stored, some.select(F.col("page_id").alias("record_id")), few=0)
    assert {r.record_id: r.payload for r in joined.collect() if r.payload is not None} == got
    assert joined.count() == some.count()
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        warc.export(stored, folder)
        assert sorted(p.name for p in (tmp_path / folder[-1]).iterdir()) == sorted(r.path for r in stored.collect())


def test_records_at_given_places():
    b = warc._Bundle()
    for i in range(50):
        b.add(i, warc.record(i, "u", b"x" * 20_000, hashlib.sha1(b"x" * 20_000).hexdigest(), None, "2024-01-01T00:00:00Z"))
    content = b.content()
    assert len(warc.frame_ranges(content)) > 1
    got = [warc.parse_record(x)["record_id"] for x in warc.opened(content, [r for r in b.index if r["record_id"] in (0, 1, 2, 40)])]
    assert got == [0, 1, 2, 40]


def test_empty_and_broken(spark, pages):
    assert warc.read(warc.bundles(warc.with_reference(pages.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        warc.frame_ranges(b"0123456789")
    bad = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        warc.parse_record(bad)
