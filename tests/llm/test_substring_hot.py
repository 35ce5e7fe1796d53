import random

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import substring_dedup as sd

from test_llm import brute_removed, docs


def test_ranges_of_very_many_documents_stay_apart():
    n = (1 << 23) + 3
    got = sd._ranges(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 7))
    assert got.num_rows == n and set(np.unique(got.column(3).to_numpy())) == {7}
    joined = sd._ranges(np.array([1, 1, 1, 2]), np.zeros(4, np.int64), np.array([0, 2, 30, 3]), np.array([20, 5, 40, 4]))
    assert list(zip(*(joined.column(k).to_pylist() for k in (0, 2, 3)))) == [(1, 0, 20), (1, 30, 40), (2, 3, 4)]


def test_a_common_anchor_is_not_gathered():
    n, size = 5000, 100
    table = pa.table({"_a": pa.array([5] * n), "_c": pa.array(np.arange(n) // 2 * 2), "_id": pa.array(np.arange(n)), "_start": pa.array([0] * n), "_n": pa.array([3] * n, pa.int32()), "_lead": pa.array([1] * n, pa.int32()), "_fp": pa.array([0] * n, pa.int32())})
    out = list(sd._judged(iter(table.to_batches(max_chunksize=77)), 100, 4096, size))
    assert max(x.num_rows for x in out) < 3 * size
    rows = pa.Table.from_batches(out).to_pylist()
    assert sorted(r["_id"] for r in rows if r["_a"] is not None) == list(range(0, n, 2)) and all(r["_wide"] for r in rows if r["_a"] is not None)
    assert sorted(r["_id"] for r in rows if r["_a"] is None) == list(range(1, n, 2))


@pytest.mark.parametrize("hot", [0, 40])
def test_hot_anchors_against_brute_force(spark, hot):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    phrase, long = word(60), word(130)
    texts = {i: word(rng.randint(0, 90)) + rng.choice([phrase, long, phrase + "xy" + long]) + word(rng.randint(0, 90)) for i in range(120)}
    texts |= {200 + i: texts[i] for i in range(20)}
    got = {r.doc_id: bytes(r.kept) for r in sd.dedup_substrings(docs(spark, texts.items()), hot=hot, shard_bytes=4096).collect()}
    assert got == brute_removed(texts, 100)
