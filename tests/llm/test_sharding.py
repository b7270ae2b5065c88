import zlib

from cropseries.llm.sharding import jump, shard_documents
import numpy as np


def jump_one(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = [0, 1, 2, 10863919174838991, 2016238256797177309, (1 << 64) - 1, *range(1000, 1200)]
    for n in (1, 2, 8, 9, 1000):
        assert jump(np.array(keys, dtype=np.uint64), n).tolist() == [jump_one(k, n) for k in keys]


def test_laws(documents):
    data = [(i * 13 - 50, "t" * (i % 40)) for i in range(3000)] + [(None, "x"), (1, "again"), (1, "again"), (2, None), (3, "é" * 30_000)]
    got = shard_documents(documents(data).repartition(5)).toPandas()
    assert len(got) == len(data) and set(got.law) == {"key"} and set(got["shard"]) == set(range(8))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) == {8} and 0.05 < len(moved) / len(got) < 0.18
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data if i is not None}
    assert {(int(r.doc_id), r.size, r.text_crc32) for r in got.dropna(subset=["doc_id"]).itertuples()} == sizes
    assert got.groupby("doc_id")["shard"].nunique().max() == 1
    again = shard_documents(documents(data)).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_empty_table(documents):
    assert shard_documents(documents([])).count() == 0
