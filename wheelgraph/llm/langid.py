"""Language identification: each document as a mixture of the learned languages.

Every learned language is a smoothed distribution over hashed letter trigrams
(lower-cased; a run of other characters is one word boundary). A document's
language shares are fitted by expectation-maximisation on its trigram counts.
Starting from the best single language, further ones join while the log
likelihood grows by more than `PENALTY` * ln(trigrams) each and every share
stays at `LEAST_SHARE` or above. The prediction is the largest share.

The languages are all non-null values of lang, about `TRAIN_DOCS` documents each,
drawn by a hash of the id. Only `languages x BUCKETS` counts reach the driver. At
most `TEXTS` texts are counted and `CELLS` probabilities, or a text's, taken from
the model at once, however many languages. Texts are scored whole in an Arrow
function beside the other columns, so there is no shuffle.

Defined results: null, empty and letterless texts are `und` with score 0, as is
every text when nothing can be learned; a very long text is counted in slices that carry over, so with the same result;
of equally likely languages the first by name is taken; repeated rows get equal results and count as often as they occur
in learning; an empty table gives no rows; a column called like the result is kept under another name (see `beside`).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_limits, beside, crc_mod, table

BUCKETS = 1 << 15
TRAIN_DOCS = 3000
CELLS = 1 << 20
TEXTS = 64
PENALTY = 3.0
LEAST_SHARE = 0.05
STEPS = 12
SLICE = 1 << 20
RESULT = "struct<lang_pred:string,score:double,languages:string,share:double>"

_letters: np.ndarray | None = None


def trigrams(text: str | None) -> np.ndarray:
    """Counts by bucket over the whole text; all zero without letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    total, low = np.zeros(BUCKETS, np.int64), (text or "").lower()
    tail, before = np.zeros(1, np.uint32), False  # the last two of what was counted; whether the last character was a letter
    for part in itertools.chain((low[at : at + SLICE] for at in range(0, len(low), SLICE)), (" ",)):
        cp = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters[cp]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of a run of other characters, the first stands for all
        keep[0] |= before
        before = bool(letter[-1])
        c = np.concatenate([tail, np.where(letter, cp, 0).astype(np.uint32)[keep]])
        mid = np.flatnonzero(c[1:-1])
        if len(mid):
            h = (c[mid] * np.uint32(0x9E3779B1)) ^ (c[mid + 1] * np.uint32(0x85EBCA77)) ^ (c[mid + 2] * np.uint32(0xC2B2AE3D))
            total += np.bincount((h ^ (h >> 15)) % BUCKETS, minlength=BUCKETS)
        tail = c[-2:]
    return total


def _em(e: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages, 0 where not allowed) and log likelihoods of all documents at once."""
    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(n, starts)
    for _ in range(STEPS):
        r = e * share[doc]
        s = r.sum(1)
        share = np.add.reduceat(r * (n / s)[:, None], starts) / total[:, None]
    return share, np.add.reduceat(n * np.log((e * share[doc]).sum(1)), starts)


def mixtures(counts: list[np.ndarray], model: np.ndarray) -> list[tuple[int, float, list[tuple[int, float]]]]:
    """(language, score, chosen languages with shares) of each trigram count vector that isn't all zero."""
    cells = [np.flatnonzero(c) for c in counts]
    size = np.array([len(c) for c in cells])
    starts = np.concatenate([[0], size.cumsum()[:-1]])
    doc = np.repeat(np.arange(len(cells)), size)
    n = np.concatenate([c[k] for c, k in zip(counts, cells, strict=True)]).astype(np.float64)
    e = model[:, np.concatenate(cells)].T
    single = np.add.reduceat(n[:, None] * np.log(e), starts)
    best = single.argmax(1)
    p = np.exp(single - single.max(1, keepdims=True))
    score = 1 / p.sum(1)
    langs = model.shape[0]
    chosen = [[(int(b), 1.0)] for b in best]
    if langs > 1:
        full, _ = _em(e, n, doc, starts, np.ones((len(cells), langs)))
        full[np.arange(len(cells)), best] = 2  # the best single language stays first
        order = (-full).argsort(1, kind="stable")
        last, left = single.max(1), np.arange(len(cells))
        for k in range(2, langs + 1):
            left = left[full[left, order[left, k - 1]] >= LEAST_SHARE / 2]
            if not len(left):
                break
            rows = np.concatenate([np.arange(starts[i], starts[i] + size[i]) for i in left])
            allowed = np.zeros((len(left), langs))
            np.put_along_axis(allowed, order[left, :k], 1, 1)
            firsts = np.concatenate([[0], size[left].cumsum()[:-1]])
            share, ll = _em(e[rows], n[rows], np.repeat(np.arange(len(left)), size[left]), firsts, allowed)
            need = PENALTY * np.log(np.add.reduceat(n[rows], firsts) + 1)
            ok = (ll - last[left] > need) & (np.where(allowed > 0, share, 1).min(1) >= LEAST_SHARE)
            for i, s in zip(left[ok], share[ok], strict=True):
                top = sorted(((int(j), float(s[j])) for j in order[i, :k]), key=lambda x: (-x[1], x[0]))
                chosen[i], best[i], score[i] = top, top[0][0], top[0][1]
            last[left[ok]] = ll[ok]
            left = left[ok]
    return [(int(b), float(min(max(s, 0), 1)), c) for b, s, c in zip(best, score, chosen, strict=True)]


def _runs(counts, langs: int, most: int = CELLS, texts: int = TEXTS):
    """`counts`, taken as needed, in runs of at most `most` probabilities and `texts` texts, at least one text each."""
    run, cells = [], 0
    for c in counts:
        own = int(np.count_nonzero(c)) * langs
        if run and (cells + own > most or len(run) == texts):
            yield run
            run, cells = [], 0
        run.append(c)
        cells += own
    if run:
        yield run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, languages x BUCKETS probabilities) from rows whose lang and text aren't null."""
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = known.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    names = sorted(r["lang"] for r in sizes)
    shares = {r["lang"]: min(1.0, train_docs / r["count"]) for r in sizes}
    share = F.element_at(F.create_map(*[F.lit(v) for kv in shares.items() for v in kv]), F.col("lang"))
    drawn = known.where(F.col("lang").isin(names) & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share * 1_000_003))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang_, text_ in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                c = trigrams(text_)
                sums[lang_] = sums[lang_] + c if lang_ in sums else c
        for lang_, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    sums = drawn.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table_ = np.zeros((len(names), BUCKETS))
    got = sums.toArrow()  # at most languages x BUCKETS rows
    place = {x: i for i, x in enumerate(names)}
    table_[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return names, (table_ + 0.1) / (table_ + 0.1).sum(1, keepdims=True)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", out: str = "lid") -> DataFrame:
    """`docs` with `out`: struct<lang_pred, score, languages, share>; languages lists the chosen set as lang:share, share is its largest."""
    spark = docs.sparkSession
    arrow_limits(spark)
    names = model[0]
    sent = spark.sparkContext.broadcast(model[1])

    def predict(texts: pa.Array) -> pa.Array:
        found: list[tuple[str, float, str, float]] = [("und", 0.0, "", 0.0)] * len(texts)
        places: list[int] = []

        def counted():
            for i, x in enumerate(texts.to_pylist() if names else ()):
                c = trigrams(x)
                if c.any():
                    places.append(i)
                    yield c

        made = [m for run in _runs(counted(), len(names)) for m in mixtures(run, sent.value)]
        for i, (best, score, chosen) in zip(places, made, strict=True):
            found[i] = (names[best], score, ",".join(f"{names[j]}:{s:.3f}" for j, s in chosen), chosen[0][1])
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.string()), pa.array([x[3] for x in found], pa.float64())], ["lang_pred", "score", "languages", "share"])

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return beside(docs, F.arrow_udf(predict, RESULT).asNondeterministic()(docs[text].cast("string")), out)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    docs = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lid.lang_pred", "lid.score", "lid.languages")
