import base64
import gzip
import hashlib

import duckdb
import pyarrow.fs
from pyspark.sql import functions as F

from twinpane.llm import warc as w

SF = "/root/testdata/sf0.001"


def test_equals_sql_on_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = w.op7_warc(spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in con.execute(w.OP7_SQL).fetchall())


PAGES = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "u4", ""), (5, "u5", "x" * 3_000_000), (6, "u6", "solo"), (1, "u1", "<p>é</p>"), (3, "z", "<p>é</p>"), (None, "n", "<p>é</p>"), (None, "n", "other"), (7, "u7", "a\r\n\r\nb")]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)
    index = w.write_archives(pages, file_bytes=200)
    got = w.read_records(index).collect()
    assert len(got) == len(PAGES) and all(r.verified for r in got)
    first = {}
    for page, _, html in PAGES:
        first.setdefault(html or "", []).append(page)
    for page, url, html in PAGES:
        body = (html or "").encode()
        smallest = min((p for p in first[html or ""] if p is not None), default=None)
        kind = "revisit" if page is not None and smallest != page and len(first[html or ""]) > 1 else "response"
        mine = [r for r in got if (r.page_id, r.url, r.payload_digest) == (page, url, base64.b32encode(hashlib.sha1(body).digest()).decode())]
        assert mine
        for r in mine:
            assert (r.payload_bytes, r.record_type) == (len(body), kind)
            assert r.refers_to == (smallest if kind == "revisit" else None)
            assert bytes(r.payload) == (body if kind == "response" else b"")
    # The index points at gzip members of a valid archive: read whole, the file is the sum of its records.
    rows = index.collect()
    for name in {r.file for r in rows}:
        store, path = pyarrow.fs.FileSystem.from_uri(name)
        data = store.open_input_file(path).read()
        mine = sorted((r.offset, r.length) for r in rows if r.file == name)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) == len(data)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(mine)


def test_selection_threshold_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r.record_type for r in w.write_archives(pages, min_bytes=9).where("page_id = 2 or page_id = 4").collect()} == {"response"}
    index = w.write_archives(pages)
    some = w.read_records(index.where("page_id in (5, 6)"))
    assert sorted((r.page_id, len(r.payload)) for r in some.collect()) == [(5, 3_000_000), (6, 4)]
    assert w.read_records(w.write_archives(pages.limit(0))).count() == 0


def test_runs():
    assert w.runs([(0, 10), (10, 5), (40, 5), (46, 50)], 60, 10) == [(0, 2, 0, 15), (2, 4, 40, 56)]
    assert w.runs([(0, 100), (100, 100)], 60, 10) == [(0, 1, 0, 100), (1, 2, 100, 100)]
    assert w.runs([], 1, 1) == []
