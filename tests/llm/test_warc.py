"""Archives: writing, normalising and reading by place."""

import gzip
import hashlib
import io
import json

from pyspark.sql import functions as F

from foliant.llm import files, warc


def rows(spark):
    big = "x" * 300_000
    data = [(3, "http://a", big), (1, "http://b", big), (2, None, None), (4, "http://c\r\nX: y", "small"), (5, "u", "small"), (6, "é", "é" * 70), (7, "v", "é" * 70), (None, "w", "é" * 70), (8, "z", "WARC/1.0\r\n\r\n" * 20)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def written(spark, df):
    marked = warc.dedup(df, "page_id", "html")
    return marked, warc.write_monolithic(
        marked.select(warc.record_id(F.col("page_id")).alias("record_id"), "record_type", F.col("url").alias("target_uri"), "payload_digest", F.when(F.col("refers_to").isNotNull(), warc.record_id(F.col("refers_to"))).alias("refers_to"), F.encode("html", "UTF-8").alias("payload"))
    )


def test_round_trip(spark):
    df = rows(spark)
    marked, archives = written(spark, df)
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in marked.collect()}
    assert kinds == {1: ("response", None, 300_000), 2: ("response", None, 0), 3: ("revisit", 1, 300_000), 4: ("response", None, 5), 5: ("response", None, 5), 6: ("response", None, 140), 7: ("revisit", 6, 140), None: ("revisit", 6, 140), 8: ("response", None, 240)}
    assert archives.agg(F.sum("records")).first()[0] == 9
    index = warc.normalise(archives)
    found = {r.record_id: r for r in warc.read(index).collect()}
    assert len(found) == 9
    assert bytes(found["urn:record:6"].payload) == ("é" * 70).encode()
    assert (found["urn:record:3"].record_type, found["urn:record:3"].refers_to, bytes(found["urn:record:3"].payload)) == ("revisit", "urn:record:1", b"")
    assert found["urn:record:8"].payload_digest == hashlib.sha256(b"WARC/1.0\r\n\r\n" * 20).hexdigest()


def test_each_record_is_a_member_of_its_own(spark):
    _, archives = written(spark, rows(spark).coalesce(1))
    (source,) = [r.archive for r in archives.collect() if r.records]
    index = warc.normalise(archives).orderBy("offset").collect()
    with files.open_stream(source) as f:
        whole = gzip.decompress(f.read())
    with files.open_stream(index[0].archive) as f:
        members = f.read()
    assert gzip.decompress(members) == whole
    assert [r.offset for r in index] == [0, *(r.offset + r.length for r in index[:-1])]
    assert index[-1].offset + index[-1].length == len(members)
    assert all(gzip.decompress(members[r.offset : r.offset + r.length]).startswith(b"WARC/1.0\r\n") for r in index)
    with files.open_stream(index[0].archive + ".index") as f:
        assert [json.loads(x)["offset"] for x in f.read().decode().splitlines()] == [r.offset for r in index]


def test_archives_that_others_wrote():
    """Several members, and a record across two of them."""
    one = warc.record("a", "response", "u", "d", None, b"0123456789" * 5)
    two = warc.record("b", "response", "v", "d", None, b"")
    data = gzip.compress(one[:60]) + gzip.compress(one[60:] + two)
    found = [(own["warc-record-id"], payload) for own, _, payload in warc.records(io.BytesIO(data))]
    assert found == [("<a>", b"0123456789" * 5), ("<b>", b"")]


def test_empty(spark):
    _, archives = written(spark, rows(spark).limit(0))
    assert warc.read(warc.normalise(archives)).count() == 0


def test_added_names_are_replaced_and_common_payloads_met(spark):
    page = "x" * 200
    rows = [(i, page, "clash", -1) for i in range(50)] + [(50, "short", "clash", -1), (51, None, None, None)]
    out = warc.dedup(spark.createDataFrame(rows, "page_id long, html string, record_type string, payload_bytes long"), "page_id", "html").collect()
    assert len(out) == 52
    assert {r.page_id: (r.record_type, r.refers_to) for r in out} == {0: ("response", None)} | {i: ("revisit", 0) for i in range(1, 50)} | {50: ("response", None), 51: ("response", None)}
    assert {r.page_id: r.payload_bytes for r in out}[51] == 0


def test_archives_of_revisits_close(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(f"urn:record:{i}", "revisit", f"http://a/{i}", "0" * 64, "urn:record:0", b"") for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary").coalesce(1)
    archives = warc.write_monolithic(df)
    assert archives.count() > 5 and archives.agg({"records": "sum"}).first()[0] == 40
