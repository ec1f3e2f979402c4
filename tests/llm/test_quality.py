import numpy as np

from wheelgraph.llm import _gbt, quality


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_trees_walk_and_sql_agree(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = _gbt.fit(x, y, trees=60, depth=3)
    p = forest.probability(x)
    assert auc(y, p) > 0.97 and forest.feature.shape == (60, 7)
    df = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double, d double")
    assert np.allclose([v[0] for v in df.selectExpr(forest.sql(list("abcd"))).collect()], p[:50])
    assert _gbt.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((3, 2))).tolist() == [0.5] * 3


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality.op7_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    y = dict(labels.collect())
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert auc(np.array([y[r.doc_id] for r in held]), np.array([r.score for r in held])) > 0.9


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 500_000, 0.5), (3, "😀 !", 0.5)], "doc_id long, text string, labelled double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 4 and len(quality.statistics("a b")) == len(quality.FEATURES)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
