"""Document quality: histogram gradient-boosted trees over text statistics.

`statistics` reads a whole text once into `FEATURES` numbers. About `TRAIN_ROWS`
labelled rows, drawn by a hash of the id, fit the trees on the driver; the forest
is a few flat arrays, and every batch of texts is scored by numpy walking all its
rows down all trees. Scoring runs in an Arrow function beside the other columns:
no shuffle. Only the drawn ids (a bounded number) are broadcast for training.

Defined results: null counts as an empty text and is scored like any other; with
no labels, or one class only, all scores are the smoothed share of label 1;
of repeated labels of an id the largest counts; labels without quality don't;
repeated rows get equal scores and count as often as they occur in fitting; an empty table gives no rows; a column called
like the result is kept under another name (see `beside`).
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _gbt
from ._common import arrow_limits, beside, crc_mod, table

TRAIN_ROWS = 10_000
THRESHOLD = 0.3
FEATURES = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "letters", "upper", "digits", "space", "high", "marks", "bars", "bangs", "signs", "dots", "top_byte", "entropy",
    "distinct", "top_word", "repeats", "pairs", "long_words", "short_words", "all_upper", "marked", "line_bytes", "line_repeats", "ended_lines",
]
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\n", 4), (bytes(range(128, 256)), 5), (b"|<>{}[]", 6), (b"!?", 7), (b"#$%&*@^~_=+\\/", 8), (b".,;:", 9)):
    _CLASS[list(_chars)] = _k


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 10)
    n = max(1, len(raw))
    p = counts[counts > 0] / n
    words, lines = raw.split(), raw.splitlines()
    w, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    by_word, by_line = Counter(words), Counter(lines)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lengths.sum() / w,
        (kinds[1] + kinds[2] + kinds[5]) / n, kinds[2] / max(1, kinds[1] + kinds[2]), kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[0] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[9] / n,
        counts.max() / n, -float((p * np.log2(p)).sum()),
        len(by_word) / w, max(by_word.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w,
        (lengths > 14).sum() / w, (lengths <= 3).sum() / w, sum(map(bytes.isupper, words)) / w, sum(not x[-1:].isalpha() and x[-1] < 128 for x in words) / w,
        len(raw) / k, 1 - len(by_line) / k, sum(x.endswith((b".", b"!", b"?")) for x in lines) / k,
    ]


def _features(column):
    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x) for x in texts.to_pylist()], pa.list_(pa.float64()))

    numbers.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(numbers, "array<double>").asNondeterministic()(column)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> _gbt.Forest:
    """Trees from about `rows` labelled documents (docs: doc_id, text; labels: doc_id, `label`)."""
    arrow_limits(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(label).alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("labelled"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("own_text"))
    got = own.join(F.broadcast(drawn), own["id"] == drawn["labelled"]).select("id", "y", _features(F.col("own_text")).alias("x")).collect()  # about `rows` rows
    got.sort(key=lambda r: (r["id"], r["x"]))
    return _gbt.fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([float(r["y"] > 0) for r in got]))


def score(docs: DataFrame, forest: _gbt.Forest, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability of label 1 of every text."""
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def predict(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
        return pa.array(sent.value.probability(x), pa.float64())

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return beside(docs, F.arrow_udf(predict, "double").asNondeterministic()(docs[text].cast("string")), out)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = crc_mod(F.col("doc_id"), 5) == 0
    forest = fit(docs, labels.where(~held))
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), forest, out="score")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
