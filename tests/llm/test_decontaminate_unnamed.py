import hashlib

import corpus_pipeline as p

from wheelgraph.llm import decontaminate as d


def test_items_without_an_id_hit_but_are_not_listed(spark, tmp_path):
    long, short = " ".join(f"w{i}" for i in range(14)), "q r s"
    docs = [(1, f"so {long} then"), (2, f"x {short} y"), (3, "z z"), (4, f"{long} a b"), (5, "k l m n")]
    items = [(None, long), (None, short), (7, "z z"), (8, None), (9, " ".join(f"w{i}" for i in range(10))), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[2:] for r in d.op9_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {1: (14, 1, digest("9"), True), 2: (3, 0, digest(""), True), 3: (2, 1, digest("7"), True), 4: (14, 1, digest("9"), True), 5: (0, 0, digest(""), False)}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in p.remove_benchmark(spark, table, str(tmp_path)).collect()] == [5]
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    hits = {r.doc_id: r.hits.n_hit for r in d.mark(table, bench, unnamed=True).collect()}
    assert hits == {1: 14, 2: 3, 3: 2, 4: 14, 5: 0}
