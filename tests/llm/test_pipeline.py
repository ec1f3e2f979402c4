import corpus_pipeline as p

from tests.llm.test_decontaminate import brute as shared
from tests.llm.test_jaccard import classes
from tests.llm.test_pii import base
from wheelgraph.llm._common import written


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {}
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, sf), "test")
        assert name == "packing" or docs.columns == names
        rows[name] = docs.collect()
    before = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = {r.doc_id for r in rows["language_id"]}
    assert all(r.doc_id in kept for r in before if any(c.isalpha() for c in r.text or "") and len(r.text) > 200)
    own = classes([(r.doc_id, r.text) for r in rows["language_id"]])
    assert {r.doc_id for r in rows["simhash_dedup"]} == set(own.values()) and len(rows["simhash_dedup"]) == len(set(own.values()))
    clean = {r.doc_id for r in rows["simhash_dedup"] if not shared(r.text, items)[1]}
    assert {r.doc_id for r in rows["decontaminate"]} == clean
    assert {r.doc_id for r in rows["pii"]} == clean and not any(base(r.text) for r in rows["pii"])
    assert all(r.n_chars == len(r.text) for r in rows["pii"])
    pieces = rows["packing"]
    assert {r.doc_id for r in pieces} == clean and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = written(stage(spark, docs, sf), "empty")
        assert docs.count() == 0


def test_odd_rows_go_through_every_stage(spark, sf, tmp_path):
    """Nulls in every column, repeated rows, names that the stages use themselves, and a long text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL").limit(40)
    names = docs.columns
    nulls = spark.createDataFrame([tuple(None for _ in names)] * 2, docs.schema)
    long = docs.limit(1).selectExpr("CAST(7000001 AS bigint) AS doc_id", "repeat(concat(text, ' '), 400) AS text", *[c for c in names if c not in ("doc_id", "text")]).select(*names)
    whole = docs.unionByName(docs.limit(5)).unionByName(nulls).unionByName(long)
    own = ["__lid", "hits", "pii", "row", "t", "fp", "nth", "__nth", "score", "start", "length", "rank", "found"]
    for c in own:
        whole = whole.withColumn(c, whole["doc_id"].cast("string"))
    for name, stage in p.STAGES:
        whole = written(stage(spark, whole, sf), "odd")
        if name != "packing":
            assert whole.columns == [*names, *own] and whole.count() > 20, name
            assert whole.where("NOT row <=> CAST(doc_id AS string)").count() == 0
    assert whole.count() > 20
