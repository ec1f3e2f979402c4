import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers

from wheelgraph.llm import packing
from wheelgraph.llm._tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(counts):
    """Room used by sequence, after checks that every rank has one place, gapless in its sequence."""
    p, room, seen = packing.plan(counts), defaultdict(int), Counter()
    for rows, want in ((p.rows, None), (p.part_rows, None)):
        seen = Counter()
        for length, first, times, sequence, offset in rows:
            assert first == seen[length]
            seen[length] += times
            for s in range(sequence, sequence + times):
                assert room[s] == offset
                room[s] += length
        if rows is p.rows:
            late = {k: counts[k] - seen[k] for k in counts}
            assert all(late[k] == (counts[k] - p.cut[k] if p.cut else 0) for k in counts)
        else:
            want = Counter()
            for k, n in late.items():
                want.update({x: n for x in packing.parts(k)} if k < 2048 else {})
            assert seen == +want
    assert max(room.values(), default=0) <= 2048 and set(room) == set(range(len(room)))
    assert sum(room.values()) == sum(k * v for k, v in counts.items())
    return room


def test_plan_places_every_piece_once_with_little_padding():
    r = random.Random(4)
    spread = Counter(min(2048, 1 + int(r.expovariate(1 / 500))) for _ in range(20_000))
    for counts in (spread, spread + Counter({700: 9000, 2048: 50}), Counter({900: 15_000}) + spread, Counter({768: 1001}), Counter({1: 5000}), Counter({1500: 3, 2048: 1})):
        room = placed(counts)
        assert sum(2048 - x for x in room.values()) < 0.005 * 2048 * len(room) + 2 * 2048, counts.most_common(2)
    assert placed({}) == {} and packing.parts(1999) == [1024, 512, 256, 207] and packing.parts(512) == [512]


def test_nnls_recovers_an_exact_mixture():
    columns = [(1448, 600), (1024, 1024), (1000, 648, 400)]
    x = packing.nnls(columns, {1448: 7, 600: 7, 1024: 10, 1000: 3, 648: 3, 400: 3})
    assert [round(v, 3) for v in x] == [7, 5, 3]


def test_the_least_squares_place_most_remainders_at_every_size():
    r = random.Random(8)
    for docs, least in ((300, 0.6), (1_000, 0.8), (10_000, 0.85), (200_000, 0.9)):
        counts = Counter(1 + min(2047, int(r.lognormvariate(5.5, 1.0))) for _ in range(docs))
        assert packing.plan(dict(counts)).solution > least, docs
    spread = Counter(r.randrange(1, 2048) for _ in range(10_000))
    assert packing.plan(dict(spread)).solution > 0.9
    left, want = dict(spread), Counter()
    for pattern, times in packing.solved(left):
        assert sum(pattern) == 2048 and times > 0
        want.update({k: times * pattern.count(k) for k in set(pattern)})
    assert all(left[k] >= 0 and left[k] + want[k] == spread[k] for k in spread)


def test_query_equals_brute_force(spark, sf):
    coder = Encoder(PATH, True)
    got = packing.op6_packing(spark, sf).collect()
    docs = {r.doc_id: coder.whole(r.text or "") + b"\1\0\0\0" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at, sequences = Counter(), defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = docs[r.doc_id]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids) // 4
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
        at[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(at[i] == len(x) // 4 for i, x in docs.items())
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "a b", 0), (2, "word " * 5000, 0)], "doc_id long, text string, start int")
    got = packing.pack(df, PATH).collect()
    assert sum(r.length for r in got) == 1 + 1 + 3 + 5001 and len({(r.sequence_id, r.offset) for r in got}) == len(got) == 6
    assert packing.pack(df.limit(0), PATH).count() == 0
