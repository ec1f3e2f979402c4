from pyspark.sql import functions as F

from wheelgraph.llm import pii

TEXTS = {
    "email": ["a@b.c"], "ip": ["1.2.3.4"], "card": ["4-7-8-5-3-8-0-5-9-2-3-9", "478538059239"], "phone": ["+1 2"],
    "secret": ["key=abcdefgh", "Token : 'abcdefgh"], "token": ["abcdefghijklmnopqrs1", "ghp_abcdefghijklmnopqrstuvwx", "ABCDEFGHIJKLMNOPQRSTUVWX"],
    "phone_local": ["555-(123)-4567", "(555) 123-4567", "555 123.4567", "(555).(123) 4567"], "ssn": ["123-45-6789"], "iban": ["DE12ABCD12341234"],
    "email_spelled": ["a.b (AT) c [dot] de", "x[at]y.com"],
}


def test_a_span_is_proposed_whatever_else_the_text_holds(spark):
    assert set(TEXTS) == set(pii.KINDS)
    for kind, (pattern, guard) in (pii.BASE | pii.EXTRA).items():
        df = spark.createDataFrame([(t,) for t in TEXTS[kind]], "t string")
        spans = lambda g: F.expr(f"transform({pii._found(kind, 0, pattern, g)}, x -> x.value)")  # noqa: B023, E731
        for r in df.select("t", spans(guard).alias("own"), spans("true").alias("all")).collect():
            assert r.all and r.own == r.all, (kind, r.t)


def test_a_secret_does_not_depend_on_unrelated_text(spark):
    key, other = "qWzXcVbNmKjHgFdSpQrTyUwZk7Lm2Np4R", "0123456789"
    df = spark.createDataFrame([(1, f"so {key} then"), (2, f"so {key} then {other}")], "doc_id long, text string")
    a, b = (r.pii.added for r in pii.detect(df).orderBy("doc_id").collect())
    assert [(s.kind, s.value) for s in a] == [(s.kind, s.value) for s in b] == [("token", key)]
