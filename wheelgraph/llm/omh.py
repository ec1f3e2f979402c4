"""Document fingerprints: Order MinHash.

K-mers of code points are numbered by occurrence, so repeats count. For each of
`SLOTS` orders, the `ELL` numbered k-mers with the smallest values are put back
into text order and hashed as a tuple to 16 bits. Two fingerprints' likeness is
the share of equal slots; as the tuples keep order, it falls with edit distance.

`neighbours` walks the documents by descending id: one range shuffle of the
texts and a streaming pass per partition. A partition's last document needs the
next partition's first: these two rows a partition meet in a join by partition
number, each pair in a task's stream of its own, so no task gathers texts.

Defined results: null counts as empty; an empty text has all slots zero and any
other text none; a text shorter than K is a single k-mer; rows that share an id
follow the hash of their texts; equal rows are dealt over partitions like others;
null ids come last; a single row is its own next; an empty table gives no rows;
`fingerprint` keeps a column called like its result under another name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_limits, beside, small_rows, table, written

K, ELL, SLOTS = 8, 2, 64
_rng = np.random.Generator(np.random.PCG64(3))
_A = _rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)


def sketch(text: str | None) -> np.ndarray:
    """The SLOTS 16-bit tuple hashes of a whole text."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(SLOTS, np.uint16)
    k = min(K, len(cp))
    n = len(cp) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[j : j + n]
    key = np.sort((_mixed(h) << np.uint64(32)) | np.arange(n, dtype=np.uint64))  # by k-mer, then position
    mer, pos = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
    index = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = mer[1:] != mer[:-1]
    occurrence = index - np.maximum.accumulate(np.where(first, index, 0))
    numbered = _mixed(mer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + occurrence.astype(np.uint64)).astype(np.uint32)
    out = np.empty(SLOTS, np.uint16)
    y = np.empty(n, np.uint32)
    top = np.uint32(0xFFFFFFFF)
    for s in range(SLOTS):
        np.multiply(numbered, _A[s], out=y)
        y += _B[s]
        picked = []
        for _ in range(min(ELL, n)):
            i = int(y.argmin())
            picked.append((int(pos[i]), int(mer[i])))
            y[i] = top
        v = s + 1
        for _, m in sorted(picked):
            v = (v * 0x100000001B3 ^ m) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            v ^= v >> 31
        out[s] = (v >> 40 & 0xFFFF) or 1
    return out


def to_hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as much of the start of the following text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FULL = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "pid int, role int, text string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("pid", pa.int32()), ("role", pa.int32()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(pid: int, doc_id, text: str, own: np.ndarray, following: str, its: np.ndarray) -> dict:
    change = edited(text, following)
    print_ = sketch(change)
    return {
        "pid": pid, "role": 0, "text": None, "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": to_hex(own), "edited_fingerprint": to_hex(print_), "near_edited": likeness(own, print_), "near_next": likeness(own, its),
    }


def _edge(pid: int, role: int, doc_id, text: str) -> dict:
    return dict.fromkeys(_ARROW.names) | {"pid": pid, "role": role, "doc_id": doc_id, "text": text}


def _walk(batches):
    """Rows for all documents of a partition but the last; the first and the last as edges (roles 1 and 2)."""
    pid, before = TaskContext.get().partitionId(), None
    for b in batches:
        out = []
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            now = (doc_id, text, sketch(text))
            out.append(_edge(pid, 1, doc_id, text) if before is None else _row(pid, *before, *now[1:]))
            before = now
        yield pa.RecordBatch.from_pylist(out, _ARROW)
    if before is not None:
        yield pa.RecordBatch.from_pylist([_edge(pid, 2, *before[:2])], _ARROW)


def _close(batches):
    """The last document of each partition with the first one after it."""
    for b in batches:
        rows = [_row(0, i, t, sketch(t), n, sketch(n)) for i, t, n in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["following"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "omh") -> DataFrame:
    """`docs` with the fingerprint of every text as hex."""
    arrow_limits(docs.sparkSession)

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([to_hex(sketch(x)) for x in texts.to_pylist()], pa.string())

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return beside(docs, F.arrow_udf(prints, "string").asNondeterministic()(docs[text].cast("string")), out)


def neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next document's."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    # the number divides equal rows, whose order doesn't matter
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("nth")]
    walked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order[:2]).select("doc_id", "text").mapInArrow(_walk, _SCHEMA), "omh")
    edges = walked.where("role > 0").select("pid", "role", "doc_id", "text")
    # a row a partition: the one after it, in a ring
    ring = edges.where("role = 1").select("pid").withColumn("next", F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy())))
    firsts = edges.where("role = 1").select(F.col("pid").alias("next"), F.col("text").alias("following"))
    met = edges.where("role = 2").join(ring, "pid").join(firsts, "next").select("pid", "doc_id", "text", "following")
    closed = small_rows(met, "pid").mapInArrow(_close, _SCHEMA)
    return walked.where("role = 0").select(_FULL).unionByName(closed.select(_FULL))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
