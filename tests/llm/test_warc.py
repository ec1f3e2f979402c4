import gzip
import hashlib
import io

import duckdb
import pytest

from wheelgraph.llm import warc
from wheelgraph.llm._common import open_fs, shared_folder


def test_versions_and_declared_lengths():
    for version in (1, 2):
        body = b"two\nlines \r\n\r\n <html>" * 9
        raw = warc.arc_start("a.arc", version) + warc.arc_record(version, "a.arc", 9, 5, "http://x.org/a b\n", body) + warc.arc_record(version, "a.arc", 9, None, None, b"")
        first, one, two = warc.read_arc(io.BytesIO(raw))
        assert first["url"] == "filedesc://a.arc" and one["url"] == "http://x.org/a%20b%0A" and two["url"] == "about:blank"
        assert warc.split_http(one["body"])[2] == body and warc.split_http(two["body"])[2] == b""
        record = warc.convert_record("a.arc", 1, one)
        ((fields, block),) = warc.read_warc_stream(io.BytesIO(record))
        assert fields["warc-date"] == "2000-01-01T00:00:00Z" and fields["warc-type"] == "response" and block == one["body"]
        assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        with pytest.raises(ValueError, match="ends within"):
            list(warc.read_arc(io.BytesIO(raw[:-60])))
    dns = {"url": "dns:x.org", "ip": "0.0.0.0", "date": "20010203040506", "type": "text/dns", "body": b"x"}
    assert b"WARC-Type: resource" in warc.convert_record("a", 1, dns)


def test_query_equals_sql(spark, sf):
    got = warc.op5_warc(spark, sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()  # noqa: F841
    want = duckdb.sql(warc.ORACLE).df()
    key = lambda df: sorted(map(str, df[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].astype(object).where(df.notna(), None).values.tolist()))
    clean = lambda rows: [r.replace(".0", "") for r in rows]
    assert clean(key(got)) == clean(key(want))


def test_nulls_ties_repeats_files_and_empty(spark):
    big = "é" * 60
    rows = [(3, "u", big), (3, "u", big), (None, None, big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (9, "u", big)]
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, name int").coalesce(1)
    arcs, warcs = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    made = warc.convert(warc.write_arc(df, arcs, shard_bytes=400), arcs, warcs)
    got = warc.read_warc(made, warcs).collect()
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in got)
    assert kinds == [(-1, "revisit", 3, 120), (2, "response", -1, 5), (3, "response", -1, 120), (3, "revisit", 3, 120), (4, "response", -1, 5), (5, "response", -1, 0), (9, "revisit", 3, 120)]
    filesystem, root = open_fs(warcs)
    ids, refers = set(), set()
    for r in made.collect():
        with filesystem.open_input_file(f"{root}/{r.name}") as raw, gzip.GzipFile(fileobj=raw) as f:
            for fields, _ in warc.read_warc_stream(f):
                ids.add(fields["warc-record-id"])
                refers |= {fields["warc-refers-to"]} if "warc-refers-to" in fields else set()
    assert len(refers) == 1 and refers < ids
    assert warc.read_warc(warc.convert(warc.write_arc(df.limit(0), arcs + "0"), arcs + "0", warcs), warcs).count() == 0


def test_a_page_may_have_the_url_of_a_version_record(spark, tmp_path):
    rows = [(1, "filedesc://x.arc", "p" * 150), (2, "filedesc://", "p" * 150), (3, "http://a b/", ""), (4, "warc://x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {1: ("response", 150, None), 2: ("revisit", 150, 1), 3: ("response", 0, None), 4: ("response", 0, None)}
