import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import nearest as module
from quirelake.llm.nearest import nearest, quantised, tile, tiles


def parts(x, ids):
    return (ids, *quantised(x))


@pytest.mark.parametrize("size", [1.0, 1e-30, 1e30])
def test_tiles_of_a_task_keep_every_neighbour(size):
    rng = np.random.default_rng(int(abs(np.log10(size))))
    x = rng.normal(size=(3000, 24)).astype(np.float32).astype(np.float64) * rng.choice([0.01, 1, 30], size=(3000, 1)) * size
    x[500:700] = x[0] + rng.normal(size=(200, 24)) * size * 1e-4  # near copies
    x[900:930] = x[1]
    ids = rng.permutation(3000)
    got = tiles(parts(x[:300], ids[:300]), parts(x, ids), 20, strip=64, width=700)
    assert [g[0] for g in got] == ids[:300].tolist()
    exact, kept = x[:300] @ x.T, 0
    for i, (query, found, low, high) in enumerate(got):
        place = {v: n for n, v in enumerate(ids.tolist())}
        at = np.array([place[v] for v in found.tolist()])
        others = np.delete(np.arange(3000), i)
        best = others[np.lexsort((ids[others], -exact[i, others]))[:20]]
        assert set(ids[best]) <= set(found.tolist()) and query not in found and len(set(found.tolist())) == len(found)
        slack = 1e-12 * np.abs(exact[i, at]) + 1e-300
        assert (low <= exact[i, at] + slack).all() and (exact[i, at] - slack <= high).all()
        kept += len(found)
    assert kept < 1.3 * sum(len(f[1]) for f in tile(parts(x[:300], ids[:300]), parts(x, ids), 20))
    few = tiles(parts(x[:3], ids[:3]), parts(x[:5], ids[:5]), 20)
    assert [sorted(f[1].tolist()) for f in few] == [sorted(set(ids[:5].tolist()) - {q}) for q in ids[:3].tolist()]


def test_blocks_meet_in_few_tasks(spark, monkeypatch):
    """Each query has one list for 8 candidate blocks, not one for each; vectors are not shuffled once a pair of blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    rows, lists = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), []
    kind = type(spark.createDataFrame([(1,)], "a long").groupBy("a").cogroup(spark.createDataFrame([(1,)], "a long").groupBy("a")))
    real = kind.applyInArrow
    monkeypatch.setattr(kind, "applyInArrow", lambda *a: lists.append(real(*a)) or lists[-1])
    got = nearest(rows, F.col("vec_id") % 20 == 0, k=5, query_block=10, candidate_block=30).collect()
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    for q in range(0, 900, 20):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.lexsort((np.arange(900), -exact[q]))[:5].tolist()
    assert lists[0].count() == 45 * -(-30 // module.TASK_CANDIDATES)
