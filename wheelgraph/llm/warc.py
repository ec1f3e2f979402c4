"""Legacy archives: ARC files in, WARC files out.

`write_arc` lays pages down as ARC, version 1 and 2 in turn: a version record
(filedesc://), then per page one header line that declares the length and the
HTTP response in that length. `scan_arc` parses the header lines by the version
that the file states. `convert` writes one WARC per ARC: warcinfo from the
version record, then a response per record, or a revisit if an equal payload of
at least `REVISIT_BYTES` came from a smaller page id (of rows that share the id,
the earlier in the archives). Record ids derive from the archive's name and the
record's number, dates from ARC's 14 digits, types from the URL's scheme, and
digests are SHA-256. `read_warc` reads the result back.

A record is one gzip member and is written as it comes, so a shard of `SHARD_BYTES`
needs the memory of one record. Payloads never take part in a shuffle: only (digest,
id, place) rows of payloads long enough to be revisited do, and each archive then
meets its own decisions. Later steps run a task a file. Files appear by a rename, so
repeated tasks are safe.

Defined results: null html is empty; a null url becomes about:blank and is kept
percent-encoded otherwise, whatever its scheme; a null page id is last among equal
payloads; other columns are not read; an empty table gives no files and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Publishing, arrow_limits, open_fs, publish, shared_folder, small_rows, table, written

SHARD_BYTES = 1 << 30
SHARD_RECORDS = 200_000
REVISIT_BYTES = 100
DATE = "20000101000000"  # pages carry no fetch time
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def arc_start(name: str, version: int) -> bytes:
    body = f"{version} 0 wheelgraph\n{NAMES[version]}\n\n".encode()
    rest = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    url = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "about:blank"
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
    rest = f" 200 {hashlib.md5(payload).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {DATE} text/html{rest} {len(body)}\n".encode() + body + b"\n"


def read_arc(f):
    """Records of an ARC stream (file-like, uncompressed): dicts of the header's fields and `body`; the version record is first."""
    version, first = 1, True
    while line := f.readline():
        if line == b"\n":
            continue
        values = line[:-1].decode("ascii", "replace").split(" ")
        # pages may have such a URL, too; the version record is the first of a file
        is_version, first = first and values[0].startswith("filedesc://"), False
        if is_version:  # its own line has the fields of the version that its body states
            body = f.read(int(values[-1]))
            version = int(body.split(b" ", 1)[0])
        else:
            body = None
        if len(values) != len(FIELDS[version]):
            raise ValueError(f"a header line of version {version} has {len(FIELDS[version])} fields, not {len(values)}")
        record = dict(zip(FIELDS[version], values, strict=True))
        record["body"] = f.read(int(record["length"])) if body is None else body
        if len(record["body"]) != int(record["length"]):
            raise ValueError("the archive ends within a record")
        f.read(1)
        yield record


def split_http(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head with its empty line, header fields, payload) of an HTTP response."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + mark, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def record_id(name: str, index: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{name}#{index}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc_stream(f):
    """(fields in lower case, block) of every record."""
    while line := f.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, f.read(int(fields["content-length"]))


def convert_record(name: str, index: int, record: dict, kind: str | None = None, refers: tuple[str, int, int | None] | None = None) -> bytes:
    """The WARC record of an ARC record; refers: (archive, index, page id) of the response that a revisit repeats."""
    d = record["date"].ljust(14, "0")
    fields = [("WARC-Record-ID", record_id(name, index)), ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z")]
    if index == 0 and record["url"].startswith("filedesc://"):
        return warc_record("warcinfo", [*fields, ("WARC-Filename", name), ("Content-Type", "text/plain")], record["body"])
    fields += [("WARC-Target-URI", record["url"]), ("WARC-IP-Address", record["ip"])]
    if not record["body"].startswith(b"HTTP/"):
        return warc_record("resource", [*fields, ("Content-Type", record["type"])], record["body"])
    head, _, payload = split_http(record["body"])
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}")]
    if kind != "revisit":
        return warc_record("response", fields, record["body"])
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers[:2])), ("X-Refers-To-Page-Id", "" if refers[2] is None else str(refers[2]))]
    return warc_record("revisit", fields, head)


def write_arc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """ARC files under `folder` from pages (page_id, url, html); one manifest row (name) a file."""
    arrow_limits(pages.sparkSession)

    def write(batches):
        part, nth, out = TaskContext.get().partitionId(), 0, None
        filesystem, root = open_fs(folder)
        filesystem.create_dir(root, recursive=True)
        try:
            for b in batches:
                for page_id, url, html in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
                    if out is None:
                        name, version, size, records = f"pages-{part:06d}-{nth:05d}.arc.gz", 1 + (part + nth) % 2, 0, 0
                        out = Publishing(filesystem, f"{root}/{name}")
                        offset = out.write(_member(arc_start(name, version)))
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    offset += out.write(_member(arc_record(version, name, offset, page_id, url, payload)))
                    size, records = size + len(payload) + 200, records + 1
                    if size >= shard_bytes or records >= SHARD_RECORDS:
                        out.publish()
                        out, nth = None, nth + 1
                        yield pa.RecordBatch.from_pydict({"name": [name]})
            if out is not None:
                out.publish()
                out = None
                yield pa.RecordBatch.from_pydict({"name": [name]})
        finally:
            if out is not None:
                out.discard()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(rows.mapInArrow(write, "name string"), "arc-manifest")


def scan_arc(manifest: DataFrame, folder: str) -> DataFrame:
    """What conversion has to know of each ARC record: name, idx, page_id, bytes, digest."""
    schema = pa.schema([("name", pa.string()), ("idx", pa.int64()), ("page_id", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())])

    def scan(batches):
        filesystem, root = open_fs(folder)
        for b in batches:
            for name in b["name"].to_pylist():
                rows = []
                with filesystem.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as f:
                    for i, r in enumerate(read_arc(f)):
                        if r["body"].startswith(b"HTTP/"):
                            _, fields, payload = split_http(r["body"])
                            own = fields.get("x-page-id")
                            rows.append({"name": name, "idx": i, "page_id": int(own) if own else None, "bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return small_rows(manifest, "name").mapInArrow(scan, "name string, idx long, page_id long, bytes long, digest string")


def decide(scanned: DataFrame) -> DataFrame:
    """The records of `scanned` that are revisits, with ref: the first record (place) of an equal payload."""
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "name", "idx")
    long_ = scanned.where(F.col("bytes") >= REVISIT_BYTES)
    # digests that occur once have no revisits, so the join meets copies only
    firsts = long_.groupBy("digest").agg(F.min(place).alias("ref"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long_.join(firsts, "digest").where((F.col("ref.name") != F.col("name")) | (F.col("ref.idx") != F.col("idx")))


def convert(manifest: DataFrame, folder: str, out: str) -> DataFrame:
    """Convert every ARC of the manifest to a WARC under `out`; one manifest row (name) a file."""
    decided = decide(written(scan_arc(manifest, folder), "arc-scan"))
    decided = decided.select("name", F.struct("idx", F.col("ref.name").alias("of"), F.col("ref.idx").alias("at"), F.col("ref.page_id").alias("page")).alias("d"))
    decided = manifest.join(decided.groupBy("name").agg(F.collect_list("d").alias("revisits")), "name", "left")  # at most SHARD_RECORDS a name

    def turn(batches):
        filesystem, root = open_fs(folder)
        _, target = open_fs(out)
        filesystem.create_dir(target, recursive=True)
        for b in batches:
            for name, revisits in zip(b["name"].to_pylist(), b["revisits"].to_pylist(), strict=True):
                known = {x["idx"]: (x["of"], x["at"], x["page"]) for x in revisits or ()}

                def fill(o, name=name, known=known):
                    with filesystem.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as f:
                        for i, r in enumerate(read_arc(f)):
                            o.write(_member(convert_record(name, i, r, "revisit" if i in known else None, known.get(i))))

                made = name.removesuffix(".arc.gz") + ".warc.gz"
                publish(filesystem, f"{target}/{made}", fill)
                yield pa.RecordBatch.from_pydict({"name": [made]})

    return written(small_rows(decided, "name").mapInArrow(turn, "name string"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        filesystem, root = open_fs(folder)
        for b in batches:
            for name in b["name"].to_pylist():
                rows = []
                with filesystem.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as f:
                    for fields, block in read_warc_stream(f):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        _, http, payload = split_http(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload doesn't have its digest")
                        page, refers = http.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append({"page_id": int(page) if page else None, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return small_rows(manifest, "name").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, warcs = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_warc(convert(write_arc(pages, arcs), arcs, warcs), warcs)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""
