import itertools
import random
import re

import numpy as np
import xxhash

from wheelgraph.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows):
    """doc id -> smallest id reachable, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in itertools.combinations(rows, 2):
        if (x ^ y).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_masks_cover_every_pair_within_the_radius():
    own = simhash.masks()
    assert len(own) == 15
    for bits in itertools.chain.from_iterable(itertools.combinations(range(64), k) for k in (1, 2, 3)):
        change = sum(1 << b for b in bits)
        assert any(change & m == 0 for m in own)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute(r.text)) for r in docs]
    want = classes(prints)
    got = {r.doc_id: r for r in simhash.op4_simhash(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, p in prints:
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", want[i])


def test_large_buckets_in_blocks(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    rows = [(i, f) for i, f in enumerate(sorted(fps, key=lambda x: x * 7919 % 101))]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "id long, fp long")
    for block in (16, 10_000):
        roots = {x.u: x.v for x in simhash.components(simhash.links(df, block=block), "a", "b").collect()}
        assert {i: roots.get(i, i) for i, _ in rows} == classes(rows)


def test_stars_need_no_pairs():
    ids, fps = np.arange(1000), np.zeros(1000, np.uint64)
    a, b = simhash.stars(ids, fps)
    assert sum(map(len, a)) == 999 and set(np.concatenate(b)) == {0}


def test_nulls_repeats_and_keep_one(spark):
    rows = [(5, None, 1), (4, "", 2), (None, "one two three four", 3), (7, "one two three four", 4), (7, "one two three four", 5), (9, "something else entirely now", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(5, 4), (4, 4), (None, 7), (7, 7), (9, 9)}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 7, 9]
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_a_stage_of_its_own_for_large_buckets(spark):
    """A bucket is divided before its members meet: with blocks of 16 no group has more than some dozens."""
    fps = [(i, i) for i in range(400)]  # all within one bucket of the tables that leave the low bits out
    df = spark.createDataFrame(fps, "id long, fp long")
    got = {r.u: r.v for r in simhash.components(simhash.links(df, block=16), "a", "b").collect()}
    assert got == dict.fromkeys(range(1, 400), 0)
    named = spark.createDataFrame([(1, "a b c d", "x")], "doc_id long, text string, fp string")
    assert simhash.fingerprints(named).columns == ["doc_id", "text", "fp_before", "fp"]
