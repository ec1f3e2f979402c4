import hashlib

import numpy as np

from wheelgraph.llm import omh


def test_neighbours_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    docs.sort(key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in omh.op3_order_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    better = []
    for a, b in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(a.text) // 2
        change = a.text[: len(a.text) - half] + b.text[:half]
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(a.text), hashlib.sha256(change.encode()).hexdigest())
        assert r.fingerprint == omh.to_hex(omh.sketch(a.text)) and r.edited_fingerprint == omh.to_hex(omh.sketch(change))
        assert r.near_next == omh.likeness(omh.sketch(a.text), omh.sketch(b.text))
        better.append(r.near_edited >= r.near_next)
    assert np.mean(better) > 0.9


def test_order_and_repeats_count():
    a, b = "abcdefgh ijklmnop qrstuvwx " * 3, "qrstuvwx ijklmnop abcdefgh " * 3
    assert omh.likeness(omh.sketch(a), omh.sketch(a)) == 1
    assert omh.likeness(omh.sketch(a), omh.sketch(b)) < 1
    assert omh.likeness(omh.sketch("ab" * 50), omh.sketch("ab" * 400)) < 0.6
    long = "".join(chr(97 + i * 7919 % 26) for i in range(4000))
    near, far = long[:2000] + "#" + long[2001:], long[::-1]
    assert omh.likeness(omh.sketch(long), omh.sketch(near)) > omh.likeness(omh.sketch(long), omh.sketch(far))


def test_nulls_ties_single_and_empty(spark):
    rows = [(3, "abc"), (3, "abc"), (2, None), (1, ""), (None, "some text here, long enough"), (5, "x" * 300_000)]
    got = omh.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {r.doc_id for r in got} == {1, 2, 3, 5, None}
    assert next(r for r in got if r.doc_id == 2).near_next == 1  # both empty
    one = omh.neighbours(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert omh.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_rows_over_many_partitions(spark):
    rows = [(7, "the same text of some length")] * 300 + [(i, f"other {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id, r.near_next, r.edited_sha256) for r in omh.neighbours(docs).collect())
    text = "the same text of some length"
    half = len(text) // 2
    same, last = (hashlib.sha256((text[: len(text) - half] + t[:half]).encode()).hexdigest() for t in (text, "other 4"))
    sevens = [(n, d) for i, n, d in got if i == 7]
    assert len(got) == 305 and sevens.count((1.0, same)) == 299 and sum(d == last for _, d in sevens) == 1
    extra = docs.withColumn("omh", docs["doc_id"])
    assert omh.fingerprint(extra).columns == ["doc_id", "text", "omh_before", "omh"]
