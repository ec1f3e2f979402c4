import numpy as np

from wheelgraph.llm import langid


def test_held_out_accuracy_and_und(spark, sf):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.op2_language(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_shares_and_odd_texts(spark):
    base = [(i, ("the river and the house with that thing " if i % 2 else "der fluss und das haus mit dem ding nicht ") * 8, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, base[0][1] * 6 + base[1][1] * 4), (5, "the"), (6, base[1][1] * 9000)], "lid long, text string")
    got = {r.lid: r for r in langid.identify(odd, model, out="found").collect()}
    assert [got[i].found.lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].found.score == 0
    assert got[4].found.lang_pred == "de" and "en:" in got[4].found.languages and 0.5 < got[4].found.score < 0.75
    assert got[5].found.lang_pred == got[6].found.lang_pred == "en" and got[6].found.languages == "en:1.000"


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs)).first().lid.lang_pred == "und"
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
