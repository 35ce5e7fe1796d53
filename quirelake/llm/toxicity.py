"""Toxicity by compression distance: windows of a text under two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on the stretches of toxic
text that toxic text shortens more than ordinary text does. A window that the
second one shortens more than the first speaks for toxicity. A document's gains
become a probability through a logistic calibration on labelled documents that
took no part in the training of the dictionaries.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Leads every window and ends both dictionaries: a window always has one match,
#: so the fixed cost of having any does not hide what a single word saves.
_MARK = bytes(range(1, 9)) + bytes(range(14, 22))
#: Follows a stretch, whose last eight bytes would not be searched for matches.
_TAIL = b"\x1b\x1c\x1d\x1e\x1f\x7f\x1b\x1a"
#: Below 64 bytes literals are stored as they are, so a length says what matched.
WINDOW, OVERLAP = 48, 8
_TOP = 4


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered and every run of white space as one blank."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split())


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)


def _trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on ``samples``; b"" where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[-size:]


def _against(content: bytes) -> Callable[[bytes], int]:
    """Compressed length of a short stretch of text next to ``content``, by optimal matches of five bytes or more."""
    parameters = zstandard.ZstdCompressionParameters(
        window_log=21, hash_log=18, chain_log=18, search_log=6, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    shared = zstandard.ZstdCompressionDict(content + _MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(compression_params=parameters)
    compress = zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters).compress
    return lambda piece: len(compress(_MARK + piece + _TAIL))


def _shards(texts: list[bytes], k: int, limit: int) -> list[bytes]:
    """Different texts dealt into ``k`` shards by their bytes, ``limit`` bytes of each."""
    dealt: list[list[bytes]] = [[] for _ in range(k)]
    for text in dict.fromkeys(texts):
        dealt[zlib.crc32(text) % k].append(text)
    return [b" ".join(x)[:limit] for x in dealt]


def _evidence(mine: list[bytes], other: list[bytes], min_contexts: int, most: int) -> tuple[list[bytes], np.ndarray]:
    """Words of ``mine`` with the sum of their gains over all shards, each held within ``most``; -1 where that falls behind."""
    around: set[tuple[bytes, ...]] = set()
    for text in mine:
        w = [b"", *text.split(b" "), b""]
        around.update(zip(w, w[1:], w[2:], strict=False))
    counts = Counter(b" " + word + b" " for _, word, _ in around if len(word) >= 3)
    pieces = sorted(p for p, n in counts.items() if n >= min_contexts)
    total, left = np.zeros(len(pieces), int), np.arange(len(pieces))
    for shard, (a, b) in enumerate(zip(mine, other, strict=True)):
        near, far = _against(a), _against(b)
        total[left] += np.clip([far(pieces[i]) - near(pieces[i]) for i in left], -most, most).astype(int)
        left = left[total[left] >= shard - 1]
    evidence = np.full(len(pieces), -1)
    evidence[left] = total[left]
    return pieces, evidence


def peculiar_stretches(toxic: list[bytes], ordinary: list[bytes], *, shard_bytes: int = 1 << 21, shards: int = 8, min_contexts: int = 5, most: int = 5, odds: float = 4.0) -> list[bytes]:
    """The stretches of ``toxic`` that toxic text shortens and ordinary text doesn't, one entry a text.

    Both classes are dealt into shards of equal length. A word's gain in a shard
    is by how much the toxic one shortens it more than the ordinary one, at most
    ``most``; the gains of all shards add up, so chance and copied texts, which
    stand in few shards, give little, and words in fewer than ``min_contexts``
    surroundings are not measured. The threshold is calibrated by the same
    measure with the classes exchanged: the least sum that ``odds`` times as
    many words of toxic text reach as words of ordinary text. Of a shard at most
    ``shard_bytes`` are read, more than the passages that ``fit_toxicity`` takes
    can have.
    """
    k = max(2, min(shards, sum(map(len, toxic)) // (1 << 13)))
    dealt = zip(_shards(toxic, k, shard_bytes), _shards(ordinary, k, shard_bytes), strict=True)
    sides = [list(side) for side in zip(*((a[: len(b)], b[: len(a)]) for a, b in dealt), strict=True)]
    (pieces, ours), (_, theirs) = _evidence(*sides, min_contexts, most), _evidence(*sides[::-1], min_contexts, most)
    threshold = next((t for t in range(1, k * most + 1) if (ours >= t).sum() >= odds * (theirs >= t).sum()), k * most + 1)
    kept = {p.strip(b" ") for p, e in zip(pieces, ours, strict=True) if e >= threshold}
    stretches = (b" ".join(w for w in text.split(b" ") if w in kept) for text in toxic)
    return [x for x in stretches if len(x) >= 8]


@dataclass
class ToxicityModel:
    """Two dictionaries and the calibration; a few ten kilobytes."""

    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        plain, toxic = _compressor(self.ordinary).compress, _compressor(self.ordinary + self.toxic).compress
        out = np.zeros((len(texts), _TOP + 3))
        for i, text in enumerate(texts):
            b = normalised(text)
            gains = []
            for start in range(0, max(1, len(b)), WINDOW):
                window = _MARK + b[max(0, start - OVERLAP) : start + WINDOW]
                gains.append(len(plain(window)) - len(toxic(window)))
            g = np.array(gains, float)
            best = np.sort(g)[::-1][:_TOP]
            out[i, : len(best)] = best
            out[i, _TOP:] = g.mean(), np.maximum(g, 0).sum() / np.sqrt(len(g)), np.log(len(g))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), self.prior)
        z = np.c_[(self.features(texts) - self.centre) / self.scale, np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * weight.sum() / 100
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * w)
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    usable: Column | None = None,
    max_toxic: int = 3000,
    max_ordinary: int = 6000,
    max_passages: int = 1200,
    passage_chars: int = 2000,
    ordinary_bytes: int = 8192,
    toxic_bytes: int = 16384,
) -> ToxicityModel:
    """Train on a bounded sample of labelled rows (those for which ``usable`` holds).

    The sample is chosen by the hash of the id among the labels: at most
    ``max_toxic`` and ``max_ordinary`` documents. Two thirds of them train the
    dictionaries, the rest calibrates over whole texts. Texts of the first kind
    are cut into passages of ``passage_chars`` characters, of which
    ``max_passages`` of each class, chosen by hash over whole texts, go to the
    driver: 2.4 million characters a class at most, whatever the input. Of the
    calibrating documents only the seven features come back. Null labels and
    labels without a document are left out; if one class is empty, or nothing
    tells toxic text from ordinary text, the score is the toxic rate.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    total = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = total.get(1, 0) / max(1, sum(total.values()))
    parts = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, max_toxic), (0, max_ordinary))]
    chosen = parts[0].unionByName(parts[1]).withColumn("_fold", F.crc32(F.concat(F.lit("deal:"), F.col("_id").cast("string"))) % 3)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")  # bounded by the two limits
    cut_up = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{passage_chars}}}"), F.lit(0))
    passages = rows.filter("_fold > 0").select("_y", "_id", F.posexplode(cut_up).alias("_at", "_passage"))
    order = (F.xxhash64("_id", "_at"), F.xxhash64("_passage"), F.col("_passage"))
    toxic, ordinary = ([normalised(r["_passage"]) for r in passages.filter(F.col("_y") == y).orderBy(*order).limit(max_passages).select("_passage").collect()] for y in (1, 0))
    model = ToxicityModel(b"", b"", np.zeros(_TOP + 3), np.ones(_TOP + 3), np.zeros(_TOP + 4), prior)
    peculiar = peculiar_stretches(toxic, ordinary) if toxic and ordinary else []
    if not peculiar:
        return model
    model.ordinary = _trained([t[i : i + 256] for t in ordinary for i in range(0, len(t), 256)], ordinary_bytes)
    model.toxic = _trained(peculiar * 3, toxic_bytes)
    held = rows.filter("_fold = 0").select("_id", "_y", _feature_udf(model)("_text").alias("_x")).orderBy("_id", F.xxhash64("_x")).collect()
    if len({r["_y"] for r in held}) < 2:
        held = rows.select("_id", "_y", _feature_udf(model)("_text").alias("_x")).orderBy("_id", F.xxhash64("_x")).collect()
    x, y = np.array([r["_x"] for r in held]), np.array([r["_y"] for r in held])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    model.weights = _logistic((x - model.centre) / model.scale, y, weight)
    return model


def _feature_udf(model: ToxicityModel) -> Callable[..., Column]:
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(model.features(texts.tolist())))

    return features


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of ``text_col`` in ``score_col`` (a column of that name is replaced).

    Edge cases: a null or empty text has one empty window and gets the score
    that the calibration gives to no gain; repeated rows score alike; a very
    long text is scored over all of its windows; an empty table gives an empty
    table; other columns pass through, null ids too.

    At scale: one pass over the texts without a shuffle, and only the texts go
    to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some ten kilobytes, whatever the input

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))
