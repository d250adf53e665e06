"""Operator 11: the WARC source against its SQL, byte by byte, and under failures."""

import gzip
import hashlib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from clickpath.llm import queries, sql, warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
LONG = "é" * 600 + "x"  # 1,201 bytes
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/\r\nWARC-Type: x", LONG), (9, "http://a/9", LONG), (None, None, LONG),
         (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://a/6", ""),
         (7, "http://a/7", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (8, "http://a/8", "y" * 999), (10, "http://a/10", "y" * 999),
         (11, "http://a/11", "z" * 3_000_000)]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, payload string, record_type string")


def plain():
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    last = {}
    for i, _, t in PAGES:
        if len((t or "").encode()) >= 1000:
            last[t] = max(last.get(t, i) if last.get(t, i) is not None else i, i) if i is not None else last.get(t)
    out = []
    for i, _, t in PAGES:
        to = last.get(t) if last.get(t) != i else None
        out.append((i, len((t or "").encode()), digest(t), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def written(pages, path, **options):
    warc.archive(pages, path, "page_id", F.col("url"), F.col("html"), **options)
    return path


def read_back(spark, path):
    return sorted((tuple(r) for r in warc.read_pages(spark, path, "page_id").select(*COLUMNS).collect()), key=str)


def test_op11_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.WARC})").fetchall()
    assert sorted(tuple(r) for r in queries.op11_warc(spark, sf).select(*COLUMNS).collect()) == sorted(want)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"fileBytes": "2000"}])
def test_round_trip_of_edge_rows(spark, pages, tmp_path, options):
    path = written(pages.repartition(3), str(tmp_path / "w"), **options)
    assert read_back(spark, path) == plain()
    back = warc.read_warc(spark, path).where("record_type = 'response'").select("record_id", "payload", "target_uri").collect()
    payloads = {(r.record_id, bytes(r.payload)) for r in back}
    assert payloads <= {(f"urn:page:{'' if i is None else i}", (t or "").encode()) for i, _, t in PAGES} and len(back) == 10
    assert any(r.target_uri == "http://a/%0D%0AWARC-Type: x" for r in back)


def test_the_files_are_warc(pages, tmp_path):
    """Read by a few plain lines: versions, lengths, digests, one gzip member a record."""
    import base64

    path, seen = written(pages.coalesce(1), str(tmp_path / "w")), []
    [name] = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    data = gzip.open(f"{path}/{name}").read()
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        block, data = data[:int(headers["Content-Length"])], data[int(headers["Content-Length"]):]
        assert version == "WARC/1.1" and data[:4] == b"\r\n\r\n"
        data = data[4:]
        seen.append(headers["WARC-Type"])
        if seen[-1] == "response":
            payload = block.split(b"\r\n\r\n", 1)[1]
            assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if seen[-1] == "revisit":
            assert block.endswith(b"\r\n\r\n") and headers["WARC-Refers-To"] == "<urn:page:9>" and "WARC-Profile" in headers
    assert seen[0] == "warcinfo" and seen.count("revisit") == 3 and seen.count("response") == 10
    raw = open(f"{path}/{name}", "rb").read()
    assert raw.count(b"\x1f\x8b\x08") >= 14


def test_filters_are_pushed_and_payloads_skipped(spark, pages, tmp_path):
    path = written(pages, str(tmp_path / "w"))
    df = warc.read_warc(spark, path)
    every = df.collect()
    for where, kept in [("record_type = 'revisit'", 3), ("record_type in ('revisit', 'warcinfo') and refers_to is not null", 3),
                        ("target_uri like 'http://a/1%'", 3), ("not (record_type = 'response')", None), ("record_id = 'urn:page:3'", 1),
                        ("refers_to <=> null and record_type <> 'warcinfo'", 10), ("content_length > 2000000", 1), ("payload_length = 5", 2)]:
        found = warc.read_records(spark, path, where).collect()
        assert kept is None or len(found) == kept, where
        assert sorted(found, key=str) == sorted(df.where(where).collect(), key=str) and all(r in every for r in found)
    # without the option a DataFrame may be filtered in several ways within one plan
    two = df.where("record_type = 'revisit'").alias("a").join(df.where("record_type = 'response'").alias("b"), F.expr("a.refers_to = b.record_id"))
    assert two.count() == 6 and df.where("record_type = 'revisit'").union(df.where("record_id = 'urn:page:3'")).count() == 4
    reader = warc.PushedWarcReader(df.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, Not

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_length",), 5), Not(EqualTo(("record_id",), "x"))]))
    assert [f.attribute for f in left] == [("payload_length",)] and len(reader.filters) == 2
    thin = warc.read_records(spark, path, "record_id = 'urn:page:11'", "record_id string, payload_length long")
    assert [tuple(r) for r in thin.collect()] == [("urn:page:11", 3_000_000)]


def test_unwanted_blocks_are_not_read(spark, pages, tmp_path):
    path = written(pages.coalesce(1), str(tmp_path / "w"), compression="none")
    [name] = [n for n in os.listdir(path) if n.endswith(".warc")]

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def readline(self, *a):
            out = self.f.readline(*a)
            self.n += len(out)
            return out

        def read(self, n):
            self.n += n
            return self.f.read(n)

        def seek(self, *a):
            return self.f.seek(*a)

    with open(f"{path}/{name}", "rb") as f:
        stream = Counted(f)
        assert len(list(warc.records(stream, name, lambda r: r["record_type"] == "revisit", True))) == 3
        assert stream.n < 20_000 < os.path.getsize(f"{path}/{name}")


def test_attempts_that_were_not_committed_are_not_read(spark, pages, tmp_path):
    path = written(pages, str(tmp_path / "w"))
    some = next(n for n in os.listdir(path) if n.endswith(".warc.gz"))
    with open(f"{path}/{some}", "rb") as f, open(f"{path}/part-lost-00000.warc.gz", "wb") as g:
        g.write(f.read()[:100])  # what a lost attempt has left
    assert read_back(spark, path) == plain()
    written(pages, path)  # append
    assert read_back(spark, path) == sorted(plain() * 2, key=str)
    written(pages, path, mode="overwrite")
    assert read_back(spark, path) == plain() and not os.path.exists(f"{path}/part-lost-00000.warc.gz")


def test_planning(spark, pages, tmp_path):
    path = written(pages.repartition(6), str(tmp_path / "w"))
    files = warc.archive_files(path)
    schema = warc.read_warc(spark, path).schema
    parts = warc.WarcReader(schema, {"path": path, "minpartitions": "3"}).partitions()
    assert sorted(n for p in parts for n in p.files) == [n for n, _ in files] and len(parts) > 1
    assert len(warc.WarcReader(schema, {"path": path}).partitions()) == 1
    names = sorted(json.loads(open(f"{path}/{m}").read()) for m in os.listdir(path) if m.startswith("_manifest"))
    assert len(names[0]) == len(files)


def test_empty_table_and_foreign_files(spark, pages, tmp_path):
    path = written(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, path).count() == 0 and read_back(spark, path) == []
    other = tmp_path / "foreign"
    other.mkdir()
    text = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Payload-Digest: sha1:" + "ab" * 20
            + "\r\nX-Note: folded\r\n  line\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    (other / "a.warc").write_bytes(text.encode() * 2)
    [one, two] = warc.read_warc(spark, str(other)).orderBy("number").collect()
    assert (bytes(one.payload), one.payload_length, one.payload_sha1, one.headers["x-note"], two.number) == (b"hello", 5, "ab" * 20, "folded line", 1)
    (other / "a.warc").write_bytes(text.encode()[:-7])
    with pytest.raises(Exception, match="a.warc: record 0 is cut"):
        warc.read_warc(spark, str(other)).collect()
