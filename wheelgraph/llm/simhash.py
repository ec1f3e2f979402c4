"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero vector of R+1 bits; table v (of
2^(R+1)-1) keeps the positions whose vector has an odd product with v. For any
two fingerprints that differ in at most R bits some v is orthogonal to all the
differing positions' vectors, so the pair meets in table v: no pair is missed.

Copies collapse first: tables hold distinct fingerprints, each with its smallest
id. In a bucket, members are compared exactly and a star of links per component
leaves the task, never all pairs. Buckets are counted by an aggregation that begins
before the shuffle; one above `BLOCK` members is dealt by hash into blocks before its
members meet, and each pair of blocks is a group of its own, of about 2 x BLOCK
fingerprints, whatever the bucket's size. Partitions hold groups one after the other.
Links meet in the components of `operators.graph`.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows that share an id are one document; rows without an id get the class
of their fingerprint but carry no links, and no class if no such row has an id; an
empty table gives no rows; other columns are not read, but `fingerprints` keeps one
called like its result under another name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import roots as components
from ._common import arrow_limits, beside, table, unused, written

RADIUS = 3
BLOCK = 2048
SEED = 42


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bit masks of all tables. Vectors are dealt in turn, so that all masks have about half of the bits."""
    n = (1 << (radius + 1)) - 1
    vector = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def simhash(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and exactly space and \x09-\x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(line[i:j], SEED) for i, j in zip(a[at : at + (1 << 16)], b[at : at + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of every text as a signed long."""
    arrow_limits(docs.sparkSession)

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(x) for x in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return beside(docs, F.arrow_udf(prints, "long").asNondeterministic()(docs[text].cast("string")), out)


def stars(ids: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids, smallest id of their component) of all members that aren't the smallest themselves."""
    order = ids.argsort(kind="stable")
    ids, fps, a, b = ids[order], fps[order], [], []
    while len(ids) > 1:
        root, front = ids[0], fps[:1]
        ids, fps = ids[1:], fps[1:]
        while len(front) and len(ids):
            hit = np.zeros(len(ids), bool)
            for at in range(0, len(front), 256):
                left = np.flatnonzero(~hit)
                hit[left[(np.bitwise_count(front[at : at + 256, None] ^ fps[None, left]) <= radius).any(0)]] = True
            a.append(ids[hit]), b.append(np.full(hit.sum(), root))
            front, ids, fps = fps[hit], ids[~hit], fps[~hit]
    return a, b


def _link(batches):
    """Star links of each bucket; rows arrive sorted by bucket, and a bucket may span batches."""
    names = ["v", "key", "i", "j"]
    kept: list[np.ndarray] = []

    def out(rows: np.ndarray):
        edge = np.concatenate([[0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1, [len(rows)]])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(np.diff(edge) > 1):
            group = rows[edge[k] : edge[k + 1]]
            x, y = stars(group[:, 4], group[:, 5].view(np.uint64))
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])

    for batch in batches:
        rows = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in [*names, "id", "fp"]], 1)
        if not len(rows):
            continue
        last = (rows[:, :4] != rows[-1, :4]).any(1)
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield out(np.concatenate([*kept, rows[:cut]]))
            kept = []
        kept.append(rows[cut:])
        if sum(map(len, kept)) and (kept[0][0, :4] != rows[-1, :4]).any():
            yield out(np.concatenate(kept[:-1]))
            kept = kept[-1:]
    if kept:
        yield out(np.concatenate(kept))


def links(unique: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span every component of distinct fingerprints (id, fp) within `radius` bits in some bucket."""
    arrow_limits(unique.sparkSession)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keys = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for v, m in enumerate(signed)])
    met = unique.select("id", "fp", F.explode(keys).alias("k")).select("id", "fp", "k.*")
    # only buckets above a block are joined back; those of one member go in the tasks
    large = written(met.groupBy("v", "key").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp", "v"), blocks).cast("int")
    dealt = met.join(large, ["v", "key"], "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "fp")
    return dealt.repartition("v", "key", "i", "j").sortWithinPartitions("v", "key", "i", "j").mapInArrow(_link, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of `prints` (doc_id, fp) that has an id."""
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL"), "unique")
    # rows that share an id are one document
    shared = prints.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("doc_id IS NOT NULL AND x != y").select("doc_id")
    same = prints.join(shared, "doc_id", "left_semi").join(unique, "fp").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    roots = components(links(unique, radius).unionByName(same), "a", "b")
    return unique.join(roots, unique["id"] == roots["u"], "left").select("fp", F.coalesce("v", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, fp (signed long) and component_id, the smallest id reachable."""
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash")
    return prints.join(classes(prints), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` whose id is its class's smallest, one each (of rows that share it, the smallest text hash); rows without an id stay.
    found: the classes (doc_id, component_id), if not those of `near_duplicates`."""
    found = near_duplicates(docs, text) if found is None else found
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    joined = docs.join(kept, docs["doc_id"].cast("long") == kept["kept_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text)))
    columns, nth = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "__nth")
    chosen = joined.withColumn(nth, first).where(F.col(nth) == 1).select(*columns)
    return chosen.unionByName(docs.where("doc_id IS NULL").select(*columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
