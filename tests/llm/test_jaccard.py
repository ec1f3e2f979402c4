import itertools
import random

import corpus_pipeline as p
import numpy as np

from wheelgraph.llm import jaccard


def brute(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def classes(rows):
    """doc id -> smallest id reachable, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, brute(t)) for i, t in rows]
    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x == y or 10 * len(x & y) >= 8 * len(x | y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def near_copies(seed=3):
    """Texts of 100 to 300 words with copies in which 1 or 2 of 100 words are replaced, and chains of such copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    out = []
    for _ in range(25):
        words = [word() for _ in range(r.choice([100, 200, 300]))]
        out.append(" ".join(words))
        for _ in range(3):
            for at in r.sample(range(len(words)), r.randint(1, 2) * len(words) // 100):
                words[at] = word()
            out.append(" ".join(words))
    r.shuffle(out)
    return list(enumerate(out))


def test_stage_keeps_one_of_near_copies(spark):
    rows = near_copies()
    want = set(classes(rows).values())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in p.simhash_dedup(spark, docs, "").collect()} == want and len(want) < 60


def test_classes_equal_all_pairs_with_and_without_blocks(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in near_copies(4)] + [(10**7 + i, f"{t} Tail") for i, t in near_copies(4)]
    want, docs = classes(rows), spark.createDataFrame(rows, "doc_id long, text string")
    for block in (3, 512):
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, block=block).collect()} == want


def test_nulls_and_shared_ids(spark):
    rows = [(5, None), (4, ""), (None, "one two three four"), (7, "One two  three four"), (7, "another text"), (9, "another text"), (10, "something else entirely now"), (None, "nowhere else")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 7), (4, 4), (5, 4), (7, 7), (7, 7), (9, 7), (10, 10)]


def test_likeness_at_the_limit():
    a = np.arange(9, dtype=np.uint64)
    assert jaccard.stars([(2, a[:8]), (1, a[1:])]) == [] and jaccard.stars([(2, a), (1, a[:8])]) == [(2, 1)] and jaccard.stars([(3, a[:5]), (4, a[:4])]) == [(4, 3)]
