"""Archives: what is written comes back, by single records and by ranges."""

import gzip
import hashlib

from weftline.llm import sql, warc
from weftline.llm.entries import _archived
from tests.compare import compare, connect

SCHEMA = "page_id long, url string, html string, archive string, offset string, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


LONG = "ä<p>" + "x" * 200
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (9, None, LONG), (3, "http://a/3", LONG), (3, "u\r\nv", "other" * 30),
    (None, "n", LONG), (1, "s", "short"), (2, "s", "short"), (7, "e", ""), (8, "e", None), (None, None, None), (20, "l", "yz" * 1_000_000),
    (30, "h", "a\r\n\r\nWARC/1.1\r\n\r\n" + "q" * 90), (31, "n", "t" * 100), (32, "n", "t" * 100), (33, "n", "u" * 99), (34, "n", "u" * 99),
]


def wanted(rows):
    smallest = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            smallest[html] = min(page, smallest.get(html, page))
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        refers = smallest.get(html) if len(payload) >= 100 and smallest.get(html) != page else None
        kind = "response" if refers is None else "revisit"
        url = url and url.replace("\r", "%0D").replace("\n", "%0A")
        out.append((page, url, kind, hashlib.sha256(payload).hexdigest(), len(payload), refers, payload if refers is None else None))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 900)
    monkeypatch.setattr(warc, "RANGE_BYTES", 300)
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    index, folder = warc.write_archives(pages(spark, ROWS))
    got = warc.read_records(index, folder).drop("archive", "offset").collect()
    assert sorted(((*r[:6], bytes(r[6]) if r[6] is not None else None) for r in got), key=repr) == wanted(ROWS)
    listed = index.collect()
    assert all(r.length > 0 for r in listed) and len({(r.archive, r.offset) for r in listed}) == len(ROWS)
    # a selection reads its own records alone
    some = index.where("record_type = 'revisit'")
    assert warc.read_records(some, folder).where("record_type != 'revisit'").count() == 0
    assert warc.read_records(some, folder).count() == some.count()
    # each archive is a plain sequence of gzip members
    path = folder.removeprefix("file://")
    for name in {r.archive for r in listed}:
        with gzip.open(f"{path}/{name}") as file:
            assert file.read().startswith(b"WARC/1.1\r\n")


def test_ranges_are_coalesced(spark):
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20, 5), ("a", 25 + warc.GAP_BYTES, 5), ("a", 31 + 2 * warc.GAP_BYTES, 4), ("b", 0, warc.RANGE_BYTES),
            ("b", warc.RANGE_BYTES, 7)]
    index = spark.createDataFrame(rows, "archive string, offset long, length long")
    got = sorted((r.archive, r.start, r.stop, len(r.records)) for r in warc.ranges(index).collect())
    gap, size = warc.GAP_BYTES, warc.RANGE_BYTES
    assert got == [("a", 0, 30 + gap, 4), ("a", 31 + 2 * gap, 35 + 2 * gap, 1), ("b", 0, size, 1), ("b", size, size + 7, 1)]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, "op3_warc", _archived, sql.WARC) is None


def test_schemes():
    same = ["s3://b/k", "hdfs://name:8020/k", "gs://b/k", "abfss://c@a.dfs.core.windows.net/k", "file:///k"]
    assert [warc.store_uri(u) for u in same] == same
    assert [warc.store_uri(u) for u in ("s3a://b/k", "S3N://b/k", "file:/k/l", "/k/l")] == ["s3://b/k", "s3://b/k", "file:///k/l", "file:///k/l"]
