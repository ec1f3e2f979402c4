"""Operators without SQL against plain versions written apart from them."""

import math
import random
import re
from collections import Counter

import numpy as np

from wheelgraph.llm import _gbt, langid, omh, quality


def letters_and_gaps(text):
    return re.sub(r"[^\W\d_]+|[\W\d_]+", lambda m: m[0] if m[0][0].isalpha() else " ", f" {text.lower()} ")


def test_trigrams_equal_a_plain_count_whatever_the_slices(monkeypatch):
    def bucket(t):
        a, b, c = (0 if x == " " else ord(x) for x in t)
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        return (h ^ h >> 15) % langid.BUCKETS

    r = random.Random(2)
    for n in (0, 1, 2, 5, 40, 300):
        text = "".join(r.choice("abÄß é.,1\n日") for _ in range(n))
        s = re.sub(" +", " ", letters_and_gaps(text))
        want = Counter(bucket(s[i - 1 : i + 2]) for i in range(1, len(s) - 1) if s[i] != " ")
        for size in (1, 2, 3, 7, 1 << 20):
            monkeypatch.setattr(langid, "SLICE", size)
            got = langid.trigrams(text)
            assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want, (text, size)


def test_a_text_longer_than_a_slice_counts_like_a_whole(monkeypatch):
    text = "river und haus " * ((1 << 20) // 15) + "rivers of the wide land " * 5
    assert len(text) > (1 << 20) + 100
    got = langid.trigrams(text)
    monkeypatch.setattr(langid, "SLICE", 1 << 30)
    assert (got == langid.trigrams(text)).all()


def test_shares_equal_plain_expectation_maximisation():
    """Three languages over few buckets: the same steps in plain Python, document by document."""
    r = np.random.default_rng(7)
    model = r.random((3, langid.BUCKETS)) ** 6 + 1e-4
    model /= model.sum(1, keepdims=True)
    counts = []
    for mix in ([1, 0, 0], [0, 1, 0], [0.6, 0.4, 0], [0.4, 0.3, 0.3], [0, 0.5, 0.5]):
        counts.append(r.multinomial(600, np.array(mix) @ model))

    def fitted(c, allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for _ in range(langid.STEPS):
            new = dict.fromkeys(allowed, 0.0)
            for b in np.flatnonzero(c):
                whole = sum(share[k] * model[k, b] for k in allowed)
                for k in allowed:
                    new[k] += c[b] * share[k] * model[k, b] / whole
            share = {k: v / c.sum() for k, v in new.items()}
        return share, sum(c[b] * math.log(sum(share[k] * model[k, b] for k in allowed)) for b in np.flatnonzero(c))

    for c, (best, score, chosen) in zip(counts, langid.mixtures(counts, model), strict=True):
        single = [float((c * np.log(model[k])).sum()) for k in range(3)]
        first = int(np.argmax(single))
        full, _ = fitted(c, range(3))
        order = sorted(range(3), key=lambda k: (k != first, -full[k]))
        keep, last, want = [first], single[first], {first: 1.0}
        for k in (2, 3):
            if full[order[k - 1]] < langid.LEAST_SHARE / 2:
                break
            share, ll = fitted(c, order[:k])
            if ll - last <= langid.PENALTY * math.log(c.sum() + 1) or min(share.values()) < langid.LEAST_SHARE:
                break
            keep, last, want = order[:k], ll, share
        assert {k: round(v, 6) for k, v in chosen} == {k: round(v, 6) for k, v in want.items()}
        assert best == max(sorted(want), key=want.get) and 0 <= score <= 1
    assert [len(m[2]) for m in langid.mixtures(counts, model)] == [1, 1, 2, 3, 2]


def test_equally_likely_languages_go_by_name(spark):
    docs = spark.createDataFrame([(i, "la mer et la", x) for i, x in enumerate(["zz", "aa", "zz", "aa"])], "doc_id long, text string, lang string")
    got = langid.identify(spark.createDataFrame([("la mer", 1), ("la mer", 1)], "text string, lid int"), langid.fit(docs)).collect()
    assert [r.lid.lang_pred for r in got] == ["aa", "aa"] and [r.lid_before for r in got] == [1, 1]


def order_minhash(text):
    """Numbered k-mers by a dictionary, sorting in place of minima, integers in place of arrays."""
    if not text:
        return "0000" * omh.SLOTS
    wide, low = (1 << 64) - 1, (1 << 32) - 1

    def mixed(h):
        h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & wide
        return ((h ^ h >> 29) * 0xC4CEB9FE1A85EC53 & wide) >> 32

    k = min(omh.K, len(text))
    seen, mers = Counter(), []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) & wide
        m = mixed(h)
        mers.append((i, m, mixed((m * 0x9E3779B97F4A7C15 + seen[m]) & wide) & low))
        seen[m] += 1
    out = ""
    for s in range(omh.SLOTS):
        ranked = sorted(((n * int(omh._A[s]) + int(omh._B[s])) & low, m, i) for i, m, n in mers)
        v = s + 1
        for _, m in sorted((i, m) for _, m, i in ranked[: omh.ELL]):
            v = (v * 0x100000001B3 ^ m) * 0x9E3779B97F4A7C15 & wide
            v ^= v >> 31
        out += f"{(v >> 40 & 0xFFFF) or 1:04x}"
    return out


def test_order_minhash_equals_a_plain_version():
    r = random.Random(9)
    for text in ["", "a", "abc", "abcdefgh", "ab" * 40, "😀é " * 9, *("".join(r.choice("abcd ") for _ in range(n)) for n in (9, 30, 200, 900))]:
        assert omh.to_hex(omh.sketch(text)) == order_minhash(text), text


def test_likeness_follows_edits_and_order():
    r = random.Random(1)
    base = "".join(r.choice("abcdefghij ") for _ in range(3000))

    def changed(n):
        t = list(base)
        for i in r.sample(range(len(t)), n):
            t[i] = "#"
        return omh.likeness(omh.sketch(base), omh.sketch("".join(t)))

    few, some, many = (np.mean([changed(n) for _ in range(4)]) for n in (3, 30, 300))
    assert few > some > many and few > 0.85
    blocks = [base[i : i + 300] for i in range(0, 3000, 300)]
    assert omh.likeness(omh.sketch(base), omh.sketch("".join(reversed(blocks)))) < 0.75  # the same k-mers but for the seams


def test_boosted_trees_equal_a_plain_walk(spark):
    r = np.random.default_rng(3)
    texts = [" ".join("".join(r.choice(list("abcXYZ!.,09 "), r.integers(1, 9))) for _ in range(r.integers(1, 40))) for _ in range(300)]
    x = np.array([quality.statistics(t) for t in texts])
    y = (x[:, quality.FEATURES.index("digits")] > np.median(x[:, quality.FEATURES.index("digits")])).astype(float)
    forest = _gbt.fit(x, y, trees=15, depth=3)

    def walked(row):
        margin = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose(forest.probability(x), [walked(v) for v in x])
    rows = [(i % 150, texts[i % 150], "s") for i in range(200)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), forest).collect()
    assert all(math.isclose(g.score, walked(x[g.doc_id])) and g.score_before == "s" for g in got) and len(got) == 200


def test_first_split_equals_an_exhaustive_search():
    r = np.random.default_rng(5)
    x = r.integers(0, 6, (80, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (r.random(80) < 0.1)).astype(float)
    forest = _gbt.fit(x, y, trees=1, depth=1, rate=1.0, l2=1.0, least=1.0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h = p - y, np.full(80, p * (1 - p))

    def gain(f, c):
        left = x[:, f] <= c
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return -1
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left))

    f, c = max(((f, c) for f in range(3) for c in range(6)), key=lambda s: gain(*s))
    assert (forest.feature[0, 0], math.floor(forest.cut[0, 0])) == (f, c)
    left = x[:, f] <= c
    assert np.allclose(forest.leaf[0], [-g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
