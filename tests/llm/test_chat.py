import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from wheelgraph.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_sql(spark, sf):
    rows = chat.op10_chat(spark, sf)
    conversations = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()  # noqa: F841
    want = duckdb.sql(chat.ORACLE)
    names = want.columns
    assert set(rows.columns) == set(names)
    assert sorted(tuple(r[n] for n in names) for r in rows.collect()) == sorted(want.fetchall())


TEXTS = ["", "</s>[INST] ok [/INST]", "\\", "\\\\n <\\s> [\\INST]", "[[INST]]</s></s><s", "é\n😀\\</s", "<", "/s>", "$1 \\$2", None]


def test_escapes_are_reversible_and_leave_no_mark(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", chat.escaped(F.col("t")).alias("e")).withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == (r.t or "") and not any(m in r.e for m in chat.MARKS)


def test_round_trip_with_odd_rows(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate((r, x) for r in ("user", "assistant", "</s>", None) for x in TEXTS)] + [(None, 5, "assistant", "a"), (None, None, "user", "b"), (2, 1, "assistant", "x"), (2, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    rows_ = chat.read_back(chat.formatted(chat.canonical(df))).collect()
    got = {r.conv_id: r for r in rows_}
    own = [(r or "", x or "") for c, _, r, x in rows if c == 1]
    assert [(t.role, t.text) for t in got[1].turns] == own
    assert got[1].loss == "".join(x for r, x in own if r == "assistant")
    assert sorted([t.text for t in r.turns] for r in rows_ if r.conv_id is None) == [["a"], ["b"]] and got[2].loss == "xx"
    assert chat.formatted(chat.canonical(df.limit(0))).count() == 0


RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "instruction": {"instruction": "q", "input": "", "output": "a"},
    "instruction_only": {"instruction": "q", "output": "a"},
    "prompt_response": {"prompt": "q", "response": "a"},
    "prompt_completion": {"prompt": "q", "completion": "a"},
    "question": {"question": "q", "answer": "a", "other": {"x": [1]}},
}


def test_every_layout_by_schema_and_by_record(spark):
    want = [("user", "q"), ("assistant", "a")]
    for name, record in RECORDS.items():
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"conv_id": 7, **record})]))
        assert chat.layout_of(df.schema) is chat.LAYOUTS[name]
        assert [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical(df).orderBy("turn").collect()] == [(7, i, *t) for i, t in enumerate(want)]
    rows = [(i, json.dumps(r)) for i, r in enumerate(RECORDS.values())] + [(90, "no json"), (91, None), (92, '{"x": 1}')]
    turns, rejects = chat.canonical_json(spark.createDataFrame(rows, "id long, record string"), "record", "id")
    got = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == dict.fromkeys(range(len(RECORDS)), want) and sorted(r.conv_id for r in rejects.collect()) == [90, 91, 92]
    with pytest.raises(ValueError, match="no known layout"):
        chat.layout_of(spark.createDataFrame([], "a int").schema)
