import random

import numpy as np

from wheelgraph.llm import langid


def test_every_language_is_learned(spark):
    r = random.Random(5)
    word = lambda own: "".join(r.choice(own) for _ in range(r.randint(3, 7)))
    rows, texts = [], {}
    for n in range(90):
        own = r.sample("abcdefghijklmnopqrstuvwxyz", 8)
        texts[f"l{n:02}"] = " ".join(word(own) for _ in range(60))
        rows += [(len(rows) + i, " ".join(word(own) for _ in range(200)), f"l{n:02}") for i in range(3 if n < 70 else 1)]
    names, model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == sorted(texts) and len(model) == 90
    asked = spark.createDataFrame([(t, x) for x, t in texts.items()], "text string, want string")
    got = langid.identify(asked, (names, model)).collect()
    assert len(got) == 90 and all(r.lid.lang_pred == r.want for r in got)


def test_runs_give_the_same_mixtures():
    r = np.random.default_rng(2)
    model = r.random((7, langid.BUCKETS)) + 0.01
    model /= model.sum(1, keepdims=True)
    counts = [r.multinomial(n, model[i % 7]) for i, n in enumerate([1, 50, 400, 3, 90, 2000, 30])]
    parts = list(langid._runs(counts, 7, most=700))
    assert len(parts) > 2 and [id(c) for p in parts for c in p] == [id(c) for c in counts]
    apart = [x for p in parts for x in langid.mixtures(p, model)]
    for (a, b, c), (x, y, z) in zip(apart, langid.mixtures(counts, model), strict=True):
        assert a == x and np.isclose(b, y) and [k for k, _ in c] == [k for k, _ in z]
