"""Exact likeness behind the SimHash operator, for the pipeline's near-duplicate stage.

Two texts link if their sets of `WIDTH`-word shingles have a Jaccard likeness of
`LEAST` or more; a class is a component of links. Candidates come from the covering
tables of `simhash`, here over five-word shingles. At 0.8 about 10 of 64 SimHash
bits differ, which covering tables can't reach (radius 10 takes 2,047 tables of few
bits), so MinHash bands add the rest: `BANDS` bands of `ROWS` minima, at likeness s a
pair misses all with probability (1 - s^ROWS)^BANDS, 1.3e-7 at 0.8. All candidates
are then compared exactly.

Copies collapse first. A bucket gives a star of links, never all pairs, and the
components of these are the candidate groups. Only texts of such groups are
shuffled; a group above `BLOCK` members is dealt by hash into blocks, and each
pair of blocks is a task's work, so its texts are sent once per block.

Defined results: letter case A-Z and white space don't count; a text of fewer
words is one shingle; null and empty texts are copies of each other; rows that
share an id are one document; rows without an id get the class of their words
but carry no links, and no class if no such row has an id; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..operators.graph import roots as components
from . import simhash
from ._common import arrow_limits, written

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
BLOCK = 512
SEED = 42
_rng = np.random.Generator(np.random.PCG64(4))
_A = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * _P
        h ^= h >> np.uint64(29)
    return h


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; none without words."""
    own = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter((own[w] for w in words), np.uint64, len(words))
    width = min(width, len(words))
    return np.unique(_folded([h[j : len(h) - width + 1 + j] for j in range(width)])) if width else h


def bands(s: np.ndarray) -> np.ndarray:
    """One key a band."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(least, (h[None, at : at + 2048] * _A + _B).min(1), out=least)
    return _folded(list(least.reshape(BANDS, ROWS).T.astype(np.uint64)))


def stars(members: list[tuple[int, np.ndarray]], least: float = LEAST) -> list[tuple[int, int]]:
    """(id, smallest id) for all members of every component of exact likeness that aren't its first."""
    members = sorted(members, key=lambda m: m[0])
    size = np.array([len(s) for _, s in members], np.int64)
    of = np.repeat(np.arange(len(members)), size)
    distinct, code = np.unique(np.concatenate([s for _, s in members]), return_inverse=True)
    own = np.split(code, size.cumsum()[:-1])
    left, out = np.ones(len(members), bool), []
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front and left.any():
            x = front.pop()
            asked = np.zeros(len(distinct), bool)
            asked[own[x]] = True
            both = np.bincount(of[asked[code]], minlength=len(members))
            hit = np.flatnonzero(left & (both >= least * (size + size[x] - both) - 1e-9) & (both > 0))
            if len(hit):
                out += [(members[i][0], members[root][0]) for i in hit.tolist()]
                front += hit.tolist()
                left[hit] = False
                keep = left[of]
                code, of = code[keep], of[keep]
    return out


def _verify(batches):
    """Star links of each pair of blocks; rows arrive sorted by group, and a group may span batches."""
    now, members = None, []

    def out():
        found = stars(members)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for *group, id_, text in zip(*(batch[c].to_pylist() for c in ("c", "i", "j", "id", "text")), strict=True):
            if group != now:
                if len(members) > 1:
                    yield out()
                now, members = group, []
            s = shingles(_words(text))
            if not members or members[-1][0] != id_ or not np.array_equal(members[-1][1], s):
                members.append((id_, s))
    if len(members) > 1:
        yield out()


def candidates(unique: DataFrame) -> DataFrame:
    """(id, c): members of every candidate group of distinct texts (id, fp, bands), with the group's smallest id."""
    met = unique.select("id", F.posexplode("bands").alias("v", "key"))
    # buckets of one member go before the join, whose sides are plain, so that a hot bucket can be split
    heads = written(met.groupBy("v", "key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    near = met.join(heads, ["v", "key"]).where("id != least").select("id", "least").distinct()
    found = components(near.unionByName(simhash.links(unique.select("id", "fp")).select(F.col("a").alias("id"), F.col("b").alias("least"))), "id", "least")
    return found.select(F.col("u").alias("id"), F.col("v").alias("c")).unionByName(found.select(F.col("v").alias("id"), F.col("v").alias("c")).distinct())


def links(texts: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span every component of exact likeness in the candidate groups. texts: id, text."""
    arrow_limits(texts.sparkSession)
    sizes = groups.groupBy("c").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = groups.join(sizes, "c").withColumn("own", F.pmod(F.xxhash64("id", "c"), blocks).cast("int"))
    # the same join at any size, so that disk grows in proportion to the texts
    dealt = texts.join(dealt.hint("merge"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "text")
    return dealt.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "id").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: doc_id and component_id, the smallest id reachable."""
    arrow_limits(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def prints(texts: pa.Array) -> pa.Array:
        whole = texts.to_pylist()
        words = [_words(x) for x in whole]
        fps = np.array([simhash.simhash(x, WIDTH) for x in whole], np.uint64).view(np.int64)
        same = pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words], pa.binary())
        return pa.StructArray.from_arrays([same, pa.array(fps), pa.array([bands(shingles(w)).view(np.int64) for w in words], pa.list_(pa.int64()))], ["same", "fp", "bands"])

    prints.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(prints, "struct<same:binary,fp:long,bands:array<long>>").asNondeterministic()("text")
    rows = written(texts.select(F.col("id").alias("doc_id"), made.alias("p")).select("doc_id", "p.*"), "bands")
    unique = written(rows.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).where("id IS NOT NULL"), "unique")
    # rows that share an id are one document
    shared = rows.groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("doc_id IS NOT NULL AND x != y").select("doc_id")
    one = rows.select("doc_id", "same").join(shared, "doc_id", "left_semi").join(unique.select("same", "id"), "same").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    near = written(links(texts, written(candidates(unique), "groups"), block), "links")
    roots = components(near.unionByName(one), "a", "b")
    classes = unique.join(roots, unique["id"] == roots["u"], "left").select("same", F.coalesce("v", "id").alias("component_id"))
    return rows.select("doc_id", "same").join(classes, "same", "left").select("doc_id", "component_id")
