"""Benchmark decontamination by winnowing.

Of every `WINNOW` successive k-grams (k = `GRAM` words) of a text the one with the
smallest hash is kept, the rightmost of equals, in items and documents alike. Any
shared run of `WINDOW` = GRAM + WINNOW - 1 words therefore shares a kept k-gram.
A document's kept k-grams that the benchmark may have are extended to the windows
of WINDOW words around them, and these meet the benchmark's in a join on their
words, so results are exact. Items of fewer words are one window of their own.

A frequent k-gram meets no list of its places: each window of a document is one
row, with all the places where it stands there, and meets one row of the benchmark.
Items that share a window are a set with a name of its own; a document meets each
of its sets once, however many windows led to it.

What the benchmark may have is told by two bit filters, of kept k-grams and of
windows, of `FILTER_BITS` bits each at most whatever the benchmark's size; a filter
only saves rows, the join decides. Documents are read once; texts are shuffled only
where a document shows a candidate.

Defined results: null and empty texts have no words, no hits; rows that share an
id and a text give equal results; items without an id hit in the queries (`unnamed`)
but are not listed or counted; equal ids of several items count once; empty tables
give no rows, or rows without hits; a column called like the result is kept under
another name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_limits, remove, table, unused, written

WINDOW, GRAM = 10, 5
WINNOW = WINDOW - GRAM + 1
#: The most bits of a filter, as a power of two: 8 MB. Small benchmarks have 512 an entry, so that few documents
#: show a false candidate; very large ones fewer than one, so that more rows reach the join.
FILTER_BITS = 26
RESULT = "struct<n_words:long,n_hit:long,items:array<long>,runs:array<struct<s:long,e:long>>>"
#: One byte for each: word bytes stay (A-Z lower-cased), all others become spaces. UTF-8 beyond ASCII is word bytes only.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def _numbers(words: list[bytes]) -> np.ndarray:
    """Hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _grams(n: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of k words, or of those that start `at` some, by the words' hashes."""
    size = max(0, len(n) - k + 1)
    h = np.full(size if at is None else len(at), k, np.uint64)
    for j in range(k):
        h ^= n[j : j + size] if at is None else n[at + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def winnowed(h: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the kept hashes: of each `window` successive ones the smallest, the rightmost of equals."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    best = place = np.arange(window - 1, len(h))
    least = h[window - 1 :]
    for back in range(1, window):
        other = h[window - 1 - back : len(h) - back]
        less = other < least
        least, best = np.where(less, other, least), np.where(less, place - back, best)
    # places never go back from one window to the next
    return best[np.concatenate([[True], best[1:] != best[:-1]])]


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, t in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([s, t])
    return [(s, t) for s, t in out]


class Filter:
    """Which hashes may be in a set, by the leading bits of each."""

    def __init__(self, bits: int, slots: np.ndarray, masks: np.ndarray):
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(1 << bits - 6, np.uint64)
        self.words[slots] = masks

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def windows(words: list[bytes], grams: Filter, whole: Filter, short: list[int]) -> dict[str, list[int]]:
    """The windows of a document that may be the benchmark's, each with its places in order."""
    found: dict[str, list[int]] = {}
    n = _numbers(words)

    def add(starts: np.ndarray, k: int) -> None:
        for s in starts.tolist():
            found.setdefault(b" ".join(words[s : s + k]).decode("utf-8", "surrogatepass"), []).append(s)

    if len(n) >= WINDOW:
        h = _grams(n, GRAM)
        kept = winnowed(h)
        if len(kept := kept[grams(h[kept])]):
            starts = np.unique(kept[:, None] - np.arange(WINNOW))
            starts = starts[(starts >= 0) & (starts <= len(n) - WINDOW)]
            add(starts[whole(_grams(n, WINDOW, starts))], WINDOW)
    for k in short:
        if len(n) >= k:
            add(np.flatnonzero(whole(_grams(n, k))), k)
    return found


def _items(batches):
    """Of each item its windows (w) and, without w, its kept k-grams."""
    for b in batches:
        item, words, k, h = [], [], [], []
        for item_id, text in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            own = words_of(text)
            if not own:
                continue
            n, size = _numbers(own), min(WINDOW, len(own))
            grams = _grams(n, size)
            item += [item_id] * len(grams)
            words += [b" ".join(own[s : s + size]).decode("utf-8", "surrogatepass") for s in range(len(grams))]
            k += [size] * len(grams)
            h.append(grams)
            if size == WINDOW:
                g = _grams(n, GRAM)
                kept = g[winnowed(g)]
                item += [None] * len(kept)
                words += [None] * len(kept)
                k += [GRAM] * len(kept)
                h.append(kept)
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(words, pa.string()), pa.array(k, pa.int32()), pa.array(np.concatenate(h).view(np.int64))], ["item", "w", "k", "h"])


def _filter(rows: DataFrame, n: int) -> Filter:
    """The filter of `rows` (h), of which there are `n`; its bits are put together before they reach the driver."""
    bits = min(FILTER_BITS, max(12, math.ceil(math.log2(n + 1)) + 9))
    slot = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")
    got = rows.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(bit).alias("mask")).toArrow()  # at most 2^(bits - 6) rows
    return Filter(bits, got["slot"].to_numpy(), got["mask"].to_numpy().view(np.uint64))


class Benchmark:
    """The benchmark's windows (w, set), its sets of items (set, items), filters, and lengths of the items shorter than a window."""

    def __init__(self, benchmark: DataFrame, unnamed: bool = False):
        arrow_limits(benchmark.sparkSession)
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        items = items.where("text IS NOT NULL" if unnamed else "text IS NOT NULL AND item_id IS NOT NULL")
        whole = F.col("w").isNotNull()
        rows = written(items.mapInArrow(_items, "item long, w string, k int, h long"), "benchmark", whole=F.count_if(whole), grams=F.count_if(~whole))
        self.grams, self.whole = _filter(rows.where(~whole), rows.measured["grams"]), _filter(rows.where(whole), rows.measured["whole"])
        self.short = sorted(r[0] for r in rows.where(whole & (F.col("k") < WINDOW)).select("k").distinct().collect())  # below WINDOW
        owned = rows.where(whole).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
        owned = written(owned.withColumn("set", F.md5(F.array_join("items", ",").cast("binary"))), "windows")
        self.windows, self.sets = owned.select("w", "set"), owned.groupBy("set").agg(F.first("items").alias("items"))
        remove(rows)


def _runs(at: pa.Array) -> pa.Array:
    """Disjoint sorted runs of hit words from windows with their places."""
    run = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    return pa.array([[{"s": s, "e": e} for s, e in united([(s, s + x["k"]) for x in found for s in x["starts"]])] for found in at.to_pylist()], pa.list_(run))


def _seen(docs: DataFrame, known: Benchmark, text: str, keep_text: bool) -> DataFrame:
    """A written row per row of `docs`: its columns as `row`, a number, n_words and the candidate windows."""
    sent = docs.sparkSession.sparkContext.broadcast((known.grams, known.whole, known.short))
    found = pa.struct([("w", pa.string()), ("starts", pa.list_(pa.int32()))])

    def look(texts: pa.Array) -> pa.Array:
        words = [words_of(x) for x in texts.to_pylist()]
        cases = [[{"w": w, "starts": s} for w, s in windows(x, *sent.value).items()] for x in words]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in words], pa.int64()), pa.array(cases, pa.list_(found))], ["n_words", "found"])

    look.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(look, "struct<n_words:long,found:array<struct<w:string,starts:array<int>>>>").asNondeterministic()
    columns = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]
    rows = docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("nth"), made(docs[f"`{text}`"].cast("string")).alias("m"))
    return written(rows.select("row", "nth", "m.n_words", "m.found"), "seen")


def _hits(seen: DataFrame, known: Benchmark) -> DataFrame:
    """(nth, starts, k, set): the candidates that are the benchmark's."""
    each = seen.where(F.size("found") > 0).select("nth", F.explode("found").alias("f")).select("nth", "f.w", "f.starts")
    return each.join(known.windows, "w").select("nth", "starts", F.size(F.split("w", " ")).alias("k"), "set")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", unnamed: bool = False, keep_text: bool = True) -> DataFrame:
    """`docs` with `out`: struct<n_words, n_hit, items, runs>. benchmark: item_id, text.
    unnamed: items without an id hit too; they are never among `items`. Without `keep_text` the text's column goes."""
    known = Benchmark(benchmark, unnamed)
    seen = _seen(docs, known, text, keep_text)
    hits = written(_hits(seen, known), "hits")

    def runs(at: pa.Array) -> pa.Array:
        return _runs(at)

    runs.__annotations__ = {"at": pa.Array, "return": pa.Array}
    made = F.arrow_udf(runs, "array<struct<s:long,e:long>>").asNondeterministic()
    places = hits.groupBy("nth").agg(F.collect_list(F.struct("k", "starts")).alias("at")).select("nth", made("at").alias("runs"))
    items = hits.select("nth", "set").distinct().join(known.sets, "set").select("nth", F.explode("items").alias("item")).groupBy("nth").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = seen.where(F.size("found") > 0).drop("found").join(places, "nth", "left").join(items, "nth", "left")
    none = seen.where(F.size("found") == 0).drop("found").withColumns({"runs": F.lit(None).cast("array<struct<s:long,e:long>>"), "items": F.lit(None).cast("array<long>")})
    every = told.unionByName(none).withColumns({"runs": F.coalesce("runs", F.array().cast("array<struct<s:long,e:long>>")), "items": F.coalesce("items", F.array().cast("array<long>"))})
    names = [f.name for f in seen.schema["row"].dataType.fields]
    kept = [F.col(f"row.`{c}`").alias(unused(docs, f"{c}_before") if c.lower() == out.lower() else c) for c in names]
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return every.select(*kept, F.struct("n_words", n_hit.alias("n_hit"), "items", "runs").cast(RESULT).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` without a hit, of items with or without an id."""
    known = Benchmark(benchmark, unnamed=True)
    seen = _seen(docs, known, text, True)
    hit = written(_hits(seen, known).select("nth").distinct(), "hits")
    kept = seen.where(F.size("found") == 0).unionByName(seen.where(F.size("found") > 0).join(hit, "nth", "left_anti").select(*seen.columns))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"), unnamed=True, keep_text=False)
    ids = F.expr("array_join(array_sort(transform(hits.items, x -> string(x))), ',')")
    return marked.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))
