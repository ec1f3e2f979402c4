import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wheelgraph.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else ()
        for p in range(len(w) - k + 1 if k else 0):
            if tuple(w[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_words_of_odd_bytes():
    for t in ["Ab-c9_d éÜ x\x85y z \x1fq", "", None, "...", "日本 語"]:
        assert [w.decode() for w in d.words_of(t)] == words(t)


def scanned(text, items):
    """What the operator does with one document, in one process: filters, candidate windows, exact look-up, united runs."""
    cols = [b.to_pydict() for b in d._items([pa.RecordBatch.from_pydict({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})])]
    rows = [r for c in cols for r in zip(c["item"], c["w"], c["k"], c["h"])]

    def filter_(h):
        at = np.array(h, np.int64).view(np.uint64) >> np.uint64(64 - 12)
        words = np.zeros(64, np.uint64)
        for x in at.tolist():
            words[x >> 6] |= np.uint64(1 << (x & 63))
        return d.Filter(12, np.arange(64), words)

    own = {}
    for item, w, _, _ in rows:
        if w is not None:
            own.setdefault(w, set()).add(item)
    short = sorted({k for _, w, k, _ in rows if w is not None and k < d.WINDOW})
    words_ = d.words_of(text)
    found = {w: s for w, s in d.windows(words_, filter_([h for *_, h in [r for r in rows if r[1] is None]]), filter_([r[3] for r in rows if r[1] is not None]), short).items() if w in own}
    runs = d.united([(s, s + len(w.split(" "))) for w, at in found.items() for s in at])
    return len(words_), sum(t - s for s, t in runs), sorted(set().union(*(own[w] for w in found)) if found else set())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_scan_equals_brute_force(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(r.choice([1, 2, 4, 12]))]
    some = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i % 7, some(r.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(r.randint(0, 6))]
    text = " ".join(r.choice([some(r.randint(0, 12)), r.choice(items)[1] if items else "", "other", ""]) for _ in range(12))
    assert scanned(text, items) == brute(text, items)


def test_query_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in d.op9_decontaminate(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and any(r.contaminated for r in got.values())
    for r in docs:
        n, hit, found = brute(r.text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert tuple(got[r.doc_id]) == (r.doc_id, n, hit, len(found), digest, hit > 0)


def test_nulls_repeats_names_and_empty(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice("abcdefg") for _ in range(14))) for i in range(30)] + [(40, "zz"), (41, None), (None, "q r s"), (42, ""), (43, items_text := " ".join(f"v{i}" for i in range(30))), (44, items_text)]
    texts = [items[3][1] + " x " + items[7][1], None, "", items[3][1] + " x " + items[7][1], "q r s", "zz zz", items_text]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None]
    got = d.mark(docs, bench).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == brute(r.text, known) and r.hits_before == 1
    assert {r.doc_id: r["items"] for r in d.mark(docs, bench).select("doc_id", "hits.items").collect()}[6] == [43, 44]
    assert d.mark(docs.limit(0), bench).count() == 0 and d.mark(docs, bench.limit(0)).where("hits.n_hit > 0").count() == 0
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == [1, 2] and d.clean(docs, bench).columns == docs.columns
    assert d.clean(docs, bench.limit(0)).count() == len(texts)


def test_repeated_words_are_linear():
    """Equal words share all their windows, which meet once."""
    start = time.time()
    n, hit, found = scanned("a " * 40_000, [(1, "a " * 40_000), (2, "a " * 9)])
    assert (n, hit, found) == (40_000, 40_000, [1, 2]) and time.time() - start < 5


def test_a_filter_of_few_bits_only_costs_rows(spark, sf, monkeypatch):
    """Full filters let everything pass; results stay."""
    want = sorted(map(tuple, d.op9_decontaminate(spark, sf).collect()))
    monkeypatch.setattr(d, "FILTER_BITS", 6)
    assert sorted(map(tuple, d.op9_decontaminate(spark, sf).collect())) == want
