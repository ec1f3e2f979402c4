import corpus_pipeline as p


def test_short_clean_documents_stay(spark):
    texts = {"en": "the river and the house with that thing no", "de": "der fluss und das haus mit dem ding no"}
    for k in range(8):  # languages that share a word, so that no posterior of it reaches a half
        texts[f"x{k}"] = f"no {'qwzjkvbf'[k] * 4}a {'qwzjkvbf'[k] * 3}o"
    rows = [(100 * n + i, " ".join([t] * 8), x) for n, (x, t) in enumerate(texts.items()) for i in range(5)]
    docs = spark.createDataFrame([*rows, (9001, "no", None), (9002, "No.", None), (9003, "12 34", None), (9004, None, None)], "doc_id long, text string, lang string")
    scores = {r.doc_id: r.lid for r in p.langid.identify(docs.where("doc_id > 9000"), p.langid.fit(docs)).collect()}
    assert scores[9001].score < p.LEAST_SHARE and scores[9001].share == 1
    assert {r.doc_id for r in p.language_id(spark, docs, "").collect()} == {r[0] for r in rows} | {9001, 9002}
