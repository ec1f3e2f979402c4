"""Sequence packing by non-negative least squares over length patterns.

Every document is encoded once; its ids are cut into whole windows and one
remainder. The histogram of piece lengths (at most `WINDOW` numbers) goes to the
driver. Combinations of two to `DEPTH` lengths that fill a window exactly are the columns
of A in  min |A x - h|, x >= 0.  Repeat counts x are rounded in order of size, the
error of each carried to the next, and what a round leaves is solved again, so
that counts below one find their places, too. The rest is packed greedily, always
the longest piece that still fits; pieces whose sequence would pad more than
`MOST_PADDING` of a window (one length may be a third of all) are cut into powers
of two and a short end first, which fill windows.

The result is a bounded plan of rows (length, rank interval, first sequence,
offset): the r-th piece of a length finds its place from r alone. Ranks come from
counts by partition, so no window or task gathers the pieces of one length.

Defined results: null and empty texts hold the end id alone; rows that share an
id are packed separately; a null id stays null; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import arrow_limits, table, written
from ._tokens import encoder

WINDOW = 2048
END_ID = 1
TRIPLES = 6  # triples tried for a length of average count; more in proportion for a commoner one
DEPTH, DEEPEST, SPREAD = 8, 32, 6000
#: Roots of primes spread the choices of one pattern's pieces apart from each other.
_ROOTS = np.sqrt([p for p in range(2, 132) if all(p % q for q in range(2, p))])
SWEEPS = 100
ROUNDS = 12
MOST_PADDING = 0.002  # of a window; pieces outside the solution whose sequence would pad more are cut


def patterns(counts: dict[int, int], window: int = WINDOW, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Combinations of present lengths that fill the window exactly: every pair; of the triples with a length `triples` each
    as its shortest and as its longest but one, more in proportion for commoner lengths; of four to `DEPTH` pieces, and of
    about as many as a window has on average, those among `SPREAD` evenly spread over the lengths' distribution whose last
    piece is there."""
    own = np.array(sorted(x for x in counts if x < window and counts[x] > 0), np.int64)
    if not len(own):
        return []
    have = np.zeros(window + 1, bool)
    have[own] = True
    low = own[(2 * own <= window) & have[window - own]]
    out, mean = {(int(window - a), int(a)) for a in low}, sum(counts[int(x)] for x in own) / len(own)
    for a in own.tolist():
        tries = triples * math.ceil(counts[a] / mean)
        for b in (own[own >= a], own[own <= a]):
            third = window - a - b
            fits = b[(third >= np.maximum(a, b)) & have[np.maximum(third, 0)]]
            for x in fits[a % max(1, len(fits) // tries) :: max(1, len(fits) // tries)].tolist():
                out.add(tuple(sorted((a, x, window - a - x), reverse=True)))
    weight = np.cumsum([counts[x] for x in own.tolist()]) / sum(counts[x] for x in own.tolist())
    at = np.arange(1, SPREAD + 1)[:, None] * _ROOTS[None, : DEEPEST - 1] % 1.0
    drawn = own[np.minimum(np.searchsorted(weight, at), len(own) - 1)]
    usual = int(window / (sum(k * counts[k] for k in own.tolist()) / sum(counts[k] for k in own.tolist())))
    for depth in sorted({*range(4, DEPTH + 1), *range(max(4, usual - 2), min(DEEPEST, usual + 4) + 1)}):
        some = drawn[:, : depth - 1]
        last = window - some.sum(1)
        fits = np.flatnonzero((last > 0) & have[np.maximum(last, 0)])
        out |= {tuple(sorted((*some[i].tolist(), int(last[i])), reverse=True)) for i in fits.tolist()}
    return sorted(out, reverse=True)


def nnls(columns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that come nearest to the histogram, by multiplicative steps, each of which
    lowers |A x - h| and keeps x positive."""
    size, most = max(max(c) for c in columns) + 1, max(map(len, columns))
    at = np.array([(*c, *[0] * (most - len(c))) for c in columns])  # no piece has length 0
    h = np.zeros(size)
    for k, n in counts.items():
        if 0 < k < size:
            h[k] = n
    back = lambda r: r[at].sum(1)
    x, target = np.ones(len(columns)), back(h)
    for _ in range(sweeps):
        ax = np.bincount(at.ravel(), np.repeat(x, most), size)
        ax[0] = 0
        x = x * (target / np.maximum(back(ax), 1e-12))
    return x


def solved(left: dict[int, int], window: int = WINDOW, rounds: int = ROUNDS):
    """(pattern, times) of the solution, taken from `left`: solve, round with the error carried on, and solve what is left."""
    for _ in range(rounds):
        columns = patterns(left, window)
        if not columns:
            return
        x, error, placed = nnls(columns, left), 0.0, 0
        for j in np.argsort(-x, kind="stable").tolist():
            pattern, want = columns[j], float(x[j]) + error
            times = max(0, min([int(want + 0.5), *(left[k] // pattern.count(k) for k in set(pattern))]))
            # an error beyond one comes of lengths that are used up, and isn't owed by others
            error = min(1.0, max(-1.0, want - times))
            if times:
                yield pattern, times
                placed += times
                for k in pattern:
                    left[k] -= times
        if not placed:
            return


def parts(length: int, window: int = WINDOW) -> list[int]:
    """The binary cut of a remainder: its powers of two from window / 2 down to window / 8, then what is left."""
    out = [p for p in (window // 2, window // 4, window // 8) if length & p]
    return out + [length % (window // 8)] * (length % (window // 8) > 0)


def _greedy(left: dict[int, int], window: int):
    """(pattern, times) until nothing is left: the longest piece first, then always the longest that still fits."""
    own = sorted((k for k, v in left.items() if v > 0), reverse=True)
    while own:
        pattern, room = [], window
        for k in own:
            n = min(room // k, left[k])
            pattern += [k] * n
            room -= n * k
            if not room:
                break
        times = min(left[k] // pattern.count(k) for k in set(pattern))
        yield pattern, times
        for k in pattern:
            left[k] -= times
        own = [k for k in own if left[k] > 0]


@dataclass
class Plan:
    """rows: (length, first rank, ranks, first sequence, offset). Pieces of `length` from rank cut[length] on are cut
    by `parts`; part p of the r-th has the rank base[p, length] + r - cut[length] among the parts' own rows."""

    rows: list[tuple[int, int, int, int, int]]
    cut: dict[int, int]
    base: dict[tuple[int, int], int]
    part_rows: list[tuple[int, int, int, int, int]]
    solution: float  # the share of the remainders that the least squares placed


def plan(counts: dict[int, int], window: int = WINDOW, most_padding: float = MOST_PADDING) -> Plan:
    """Place every counted piece exactly once."""
    left, sequence = dict(counts), 0

    def place(rows, used, pattern, times):
        nonlocal sequence
        offset = 0
        for k in pattern:
            rows.append((k, used[k], times, sequence, offset))
            used[k] += times
            offset += k
        sequence += times

    rows, used = [], dict.fromkeys(counts, 0)
    if left.get(window):
        place(rows, used, (window,), left.pop(window))
    remainders, solution = sum(left.values()), 0
    for pattern, times in solved(left, window):
        place(rows, used, pattern, times)
        solution += times * len(pattern)
    rest = list(_greedy(dict(left), window))
    one = sum(k * v for k, v in left.items()) <= window  # what fits one sequence is not worth a cut
    for pattern, times in rest:
        if one or window - sum(pattern) <= most_padding * window:
            place(rows, used, pattern, times)
            for k in pattern:
                left[k] -= times
    cut, base, pieces_ = dict(used) if any(left.values()) else {}, {}, Counter()
    for k in sorted(x for x, v in left.items() if v > 0):
        for p in parts(k, window):
            base[p, k] = pieces_[p]
            pieces_[p] += left[k]
    part_rows, part_used = [], dict.fromkeys(pieces_, 0)
    for pattern, times in _greedy(dict(pieces_), window):
        place(part_rows, part_used, pattern, times)
    return Plan(rows, cut, base, part_rows, solution / remainders if remainders else 1.0)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens; (part, nth) that number equal lengths;
    cuts, the crc32 of each of a remainder's `parts`. No ids leave the task."""
    arrow_limits(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
    how = [parts(k, window) for k in range(window)]

    def cut(batches):
        coder, part, seen = encoder(tokenizer, words=True), TaskContext.get().partitionId(), [0] * (window + 1)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, cuts = [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, part, seen[length]))
                    seen[length] += 1
                    at, own = start, []
                    for p in how[length] if length < window else ():
                        own.append(zlib.crc32(ids[4 * at : 4 * (at + p)]))
                        at += p
                    cuts.append(own)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(cuts, pa.list_(pa.int64()))], [*names, "cuts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names) + ", cuts array<long>")


class _Lookup:
    """(first sequence + rank in the interval, offset) of (length, rank)."""

    def __init__(self, rows):
        self.rows = np.array(sorted(rows) or [(0, 0, 0, 0, 0)], np.int64)
        self.key = self.rows[:, 0] << 48 | self.rows[:, 1]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        return self.rows[at, 3] + rank - self.rows[at, 1], self.rows[at, 4]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, window, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    made = plan(counts, window)
    whole, part = _Lookup(made.rows), _Lookup(made.part_rows)
    limit = np.array([made.cut.get(k, 1 << 62) for k in range(window + 1)], np.int64)
    how = [parts(k, window) for k in range(window)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches):
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            late = rank >= limit[length]
            sequence, offset = whole(length, rank)
            same = pa.RecordBatch.from_arrays([*(b[c] for c in names[:5]), pa.array(sequence), pa.array(offset)], names)
            yield same.filter(pa.array(~late))
            rows = []
            for r, k in zip(b.filter(pa.array(late)).to_pylist(), length[late].tolist(), strict=True):
                at = r["start"]
                for p, crc in zip(how[k], r["cuts"], strict=True):
                    rows.append((r["doc_id"], at, p, crc, r["doc_tokens"], made.base[p, k] + r["rank"] - made.cut[k]))
                    at += p
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                sequence, offset = part(cols[2].to_numpy(), cols[5].to_numpy())
                yield pa.RecordBatch.from_arrays([*cols[:5], pa.array(sequence), pa.array(offset)], names)

    return ranked.select(*names[:5], "cuts", "rank").mapInArrow(place, ", ".join(f"`{n}` long" for n in names))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
