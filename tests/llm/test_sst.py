import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from wheelgraph.llm import sst
from wheelgraph.llm._common import open_fs, shared_folder
from wheelgraph.llm._tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_lookup_and_damage():
    r = random.Random(2)
    ids = sorted(r.sample(range(-(10**6), 10**12), 3000))
    rows = [(None, np.array([7], "<u4"))] + [(i, np.array([r.randrange(50_000) for _ in range(r.randrange(200))], "<u4")) for i in ids]
    rows.insert(50, rows[49])
    out = io.BytesIO()
    w = sst.Writer(out)
    for i, v in rows:
        w.add(sst.key_of(i), v)
    w.finish()
    reader = sst.Reader(io.BytesIO(out.getvalue()))
    assert len(reader.blocks) > 5 and [sst.id_of(k) for k, _ in reader] == [i for i, _ in rows]
    for i, v in rows[::37]:
        assert all((x == v).all() for x in reader.get(i)) and reader.get(i)
    assert len(reader.get(rows[49][0])) == 2
    absent = [i for i in range(500) if i not in set(ids)]
    assert not any(reader.get(i) for i in absent)
    bad = bytearray(out.getvalue())
    bad[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sst.Reader(io.BytesIO(bytes(bad))))


def test_query_equals_brute_force(spark, sf):
    coder, start = Encoder(PATH, False), 0
    got = {r.doc_id: r for r in sst.op8_sst(spark, sf).collect()}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = coder.whole(r.text or "") + b"\0\0\0\0"
        assert tuple(got.pop(r.doc_id)) == (r.doc_id, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert not got


def test_nulls_repeats_and_empty(spark):
    rows = [(2, "b c"), (None, "x"), (1, None), (2, "b c"), (3, "")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, start string")
    folder = shared_folder(spark, "sst")
    manifest = sst.write_shards(df, folder, PATH, shard_bytes=8)
    got = sorted(sst.read_shards(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3] and [r.n_tokens for r in got] == [2, 1, 3, 3, 1] and got[-1].start == 9
    filesystem, _ = open_fs(folder)
    with filesystem.open_input_file(manifest.first().path) as f:
        assert sst.Reader(f).entries >= 1
    assert sst.read_shards(sst.write_shards(df.limit(0), folder, PATH), folder).count() == 0
