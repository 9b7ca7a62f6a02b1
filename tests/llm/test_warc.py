import gzip
import random

import pytest

from quillstack.llm.queries import ORACLE_SQL, op5_warc
from quillstack.llm.warc import LoserTree, capture_histories, records, url_key


def test_loser_tree():
    r = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(20))) for _ in range(k)]
        got = [x[0] for x in LoserTree([((v, i) for v in run) for i, run in enumerate(runs)])]
        assert got == sorted(v for run in runs for v in run)


def test_records_members_and_faults():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 8\r\n\r\n\r\n\r\nabcd\r\n\r\n"
    for data in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        got = list(records(data))
        assert [x[0] for x in got] == [0, len(one), 2 * len(one)] and all(x[2] == b"\r\n\r\nabcd" for x in got)
    for bad in (one[:-3], b"junk\r\n\r\n", gzip.compress(one)[:-12]):
        with pytest.raises(ValueError):
            list(records(bad))


def test_url_key():
    assert url_key("HTTPS://www.Example.com:443/A?b=2&a=1#x") == "com,example)/a?a=1&b=2" == url_key("http://example.com/a?a=1&b=2")
    assert url_key("http://e.com:8080") == "com,e:8080)/"
    assert url_key("not a url") == "not a url"


def test_edges(spark):
    rows = [
        (1, "http://a.com/", None, 1), (2, None, "", 1), (3, "http://a.com/", "", 1), (4, "http://b.com/\r\nx", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", 1),
        (5, "http://b.com", "é" * 40000, 1), (6, "http://b.com", "é" * 40000, 1), (6, "http://b.com", "é" * 40000, 1), (None, "http://c.com", "q", 1), (None, "http://c.com", "q", 2),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    out = capture_histories(df)
    got = sorted(((r.page_id or 0), r.record_type, r.payload_bytes, r.refers_to) for r in out.collect())
    assert got == sorted([(1, "revisit", 0, 3), (2, "revisit", 0, 3), (3, "response", 0, None), (4, "response", 33, None), (5, "revisit", 80000, 6), (6, "response", 80000, None), (6, "response", 80000, None), (0, "response", 1, None), (0, "response", 1, None)], key=lambda x: (x[0], x[1], x[2], x[3] or 0))
    keys = [(r.urlkey, r.captured_at) for r in out.collect()]
    assert keys == sorted(keys)
    none = capture_histories(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0
    least = capture_histories(df.where("page_id <= 3"), min_bytes=1)
    assert {r.record_type for r in least.collect()} == {"response"}


def test_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = sorted(c.sql(ORACLE_SQL["op5_warc"]).fetchall())
    got = sorted(tuple(r) for r in op5_warc(spark, sf).collect())
    assert got == want


def test_many_ranges_and_archives(spark, monkeypatch, tmp_path):
    import quillstack.llm.warc as warc

    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    rows = [(i, f"http://{'hot' if i % 3 else i % 5}.com/{i % 4}", "x" * (i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = capture_histories(df, path=str(tmp_path / "w"), archive_bytes=20_000)
    got = out.collect()
    keys = [(r.urlkey, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.page_id for r in got}) == 200
    assert len({r.archive for r in got}) > 3
