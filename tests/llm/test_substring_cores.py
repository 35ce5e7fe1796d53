import random

import numpy as np
import pyarrow as pa
import pytest

from quirelake.llm import substring_dedup as sd

from test_llm import brute_removed


def through(texts, wide, monkeypatch):
    """Every step of the removal in one process; the ranges to remove, the bytes requested and the texts that met in suffix arrays."""
    ids, length, met = list(texts), 100, []
    base = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids), pa.int32()), pa.array([texts[i].encode() for i in ids])], ["_id", "_fp", "_text"])
    rows = pa.Table.from_batches(sd._unpacked(sd._packed(b for k in range(len(ids)) for b in sd._occurrences(iter([base.slice(k, 1)]), length, np.zeros(0, np.uint64)))))
    judged = pa.Table.from_batches(sd._judged(iter(rows.sort_by([(k, "ascending") for k in ("_a", "_c", "_id", "_fp", "_start")]).combine_chunks().to_batches()), length, wide)).to_pylist()
    asked = {i: [r for r in judged if r["_a"] is not None and r["_id"] == i] for i in ids}
    batch = pa.RecordBatch.from_arrays([*base.columns, pa.array([asked[i] for i in ids], pa.list_(pa.struct([("_a", pa.int64()), ("_from", pa.int64()), ("_to", pa.int64()), ("_wide", pa.bool_())])))], ["_id", "_fp", "_text", "_asked"])
    contexts = pa.Table.from_batches(sd._contexts(iter([batch]), length)).sort_by([(k, "ascending") for k in ("_a", "_id", "_fp", "_from")])
    kept = sd.repeated_windows
    monkeypatch.setattr(sd, "repeated_windows", lambda texts, *rest: met.extend(texts) or kept(texts, *rest))
    gone = [r for r in judged if r["_a"] is None] + pa.Table.from_batches([pa.RecordBatch.from_pylist([], pa.schema([("_id", pa.int64()), ("_fp", pa.int32()), ("_from", pa.int64()), ("_to", pa.int64())])), *sd._sorted_shards(iter(contexts.combine_chunks().to_batches()), length, 1 << 20)]).to_pylist()
    left = {i: sd._cut_out(texts[i].encode(), [(r["_from"], r["_to"]) for r in gone if r["_id"] == i])[0] for i in ids}
    return left, contexts.num_rows, met


@pytest.mark.parametrize("wide", [1, 4096])
def test_blocks_with_one_anchor_and_other_surroundings(wide, monkeypatch):
    """A string of 30 bytes that many texts hold makes no windows of 100 bytes equal, so no text is asked for."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = {i: word(150) + "the same thirty bytes all over" + word(150) for i in range(60)}
    left, rows, met = through(texts, wide, monkeypatch)
    assert left == {i: t.encode() for i, t in texts.items()}
    assert not rows and not met


def test_windows_of_wide_groups_need_no_suffix_array(monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    phrases = [word(90), word(140)]
    texts = {i: word(rng.randint(20, 90)) + rng.choice(phrases) + word(rng.randint(20, 90)) for i in range(60)}
    left, rows, met = through(texts, 1, monkeypatch)
    assert left == brute_removed(texts, 100) and rows
    assert not [t for t in met if len(t) == 100]
    assert through(texts, 4096, monkeypatch)[0] == left


def test_packed_rows_are_the_same():
    rng = np.random.default_rng(3)
    kinds = {"_a": (-(1 << 62), 1 << 62, np.int64), "_c": (-(1 << 62), 1 << 62, np.int64), "_id": (-(1 << 62), 1 << 62, np.int64), "_start": (0, 1 << 31, np.int64), "_n": (0, 129, np.int32), "_lead": (-128, 128, np.int32), "_fp": (0, 1 << 30, np.int32), "_cores": (0, 1 << 48, np.int64)}
    batch = pa.RecordBatch.from_arrays([pa.array(rng.integers(low, high, 5000).astype(kind)) for low, high, kind in kinds.values()], list(kinds))
    assert next(sd._unpacked(sd._packed(iter([batch])))).equals(batch)
