"""Document quality from weak labels: heuristic labellers, EM over their votes, a hashed linear scorer.

Overlapping heuristics vote on each document. Expectation-maximisation over the
counts of vote patterns estimates how accurate each labeller is, which gives
each pattern a posterior. Documents with a clear posterior train a logistic
scorer on hashed character trigrams, which then scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    b"a and as at for in is of on or that the to with das dem der die ein eine ist und von zu au de des en et la le les un une con el las los para que se su y".split()
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|<>{}[]~^=_\\@+")] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "stutter", "variety", "length", "lines", "digits", "sentences", "function_words")
SLOTS = 1 << 16


def _vote(value: float, good_to: float, bad_from: float) -> int:
    return GOOD if value <= good_to else BAD if value >= bad_from else NONE


def votes(text: str | None) -> list[int]:
    """One vote of each labeller: 1 good, 0 bad, 2 abstains. An empty text is bad by length; the others abstain."""
    b = (text or "").encode("utf-8", "replace").translate(_LOWER)
    words = b.split()
    n = len(words)
    if not n:
        return [NONE, NONE, NONE, BAD, NONE, NONE, NONE, NONE]
    a = np.frombuffer(b, np.uint8)
    stutter = sum(x == y for x, y in zip(words, words[1:], strict=False)) / n
    lines = [x for x in (x.strip() for x in b.split(b"\n")) if x]
    ends = sum(w[-1:] in b".?!" for w in words)
    return [
        _vote(float(_SYMBOLS[a].mean()), 0.005, 0.03),
        _vote(stutter, 0.03, 0.15),
        _vote(-len(set(words)) / n, -0.4, -0.2) if n >= 50 else NONE,
        BAD if n < 4 else GOOD if n >= 25 else NONE,
        _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 3 else NONE,
        _vote(float(_DIGITS[a].mean()), 0.05, 0.25),
        (_vote(n / ends, 30, 120) if ends else BAD) if n >= 25 else NONE,
        _vote(-sum(w in FUNCTION_WORDS for w in words) / n, -0.1, -0.02) if n >= 25 else NONE,
    ]


def pattern(found: list[int]) -> int:
    """The votes as one number, base 3, first labeller last."""
    return sum(v * 3**i for i, v in enumerate(found))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """``rates[j, y, v]``: how often labeller ``j``, if it votes, votes ``v`` on documents of class ``y``.

    Whether a labeller abstains (most do on short texts) says nothing about the class.
    """

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of class 1 (good) for each vote pattern."""
        v = unpack(patterns)
        rates = np.concatenate([self.rates, np.ones((len(LABELLERS), 2, 1))], axis=2)
        logs = np.log([[1 - self.prior], [self.prior]]) + np.stack([np.log(rates[np.arange(len(LABELLERS)), y, v]).sum(1) for y in (0, 1)])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Share of right votes among a labeller's votes, for both classes alike."""
        right, wrong = (self.rates[:, 1, 1] + self.rates[:, 0, 0]) / 2, (self.rates[:, 1, 0] + self.rates[:, 0, 1]) / 2
        return dict(zip(LABELLERS, (right / (right + wrong)).tolist(), strict=True))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """EM for two classes and labellers that are independent given the class.

    Starts from the mean of each pattern's votes, so class 1 is the one that
    the labellers call good.
    """
    v = unpack(patterns)
    cast = np.maximum((v != NONE).sum(1), 1)
    p = np.clip(((v == GOOD).sum(1) + 0.5 * (cast == 0)) / cast, 0.02, 0.98)
    p = np.where((v == BAD).any(1), np.minimum(p, 0.6), p)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2, 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        model.prior = float(np.clip(weight[1].sum() / max(counts.sum(), 1e-9), 1e-3, 1 - 1e-3))
        for j in range(len(LABELLERS)):
            for y in (0, 1):
                seen = np.bincount(v[:, j], weight[y], 3)[:2] + 1.0
                model.rates[j, y] = seen / seen.sum()
        before, p = p, model.posterior(patterns)
        if np.abs(before - p).max(initial=0) < 1e-6:
            break
    return model


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the text's byte trigrams (A-Z lowered; blanks around it, so no text is without one)."""
    a = np.frombuffer(b" " + (text or "").encode("utf-8", "replace").translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(1, np.uint16)
    code = a[:-2] | a[1:-1] << 8 | a[2:] << 16
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[trigrams(t)].mean() for t in texts]) + self.bias if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_scorer(texts: list[str], target: np.ndarray, steps: int = 150, rate: float = 0.5, ridge: float = 1e-7) -> tuple[np.ndarray, float]:
    """Logistic regression on the shares of trigram slots, by Adam steps over the whole sample."""
    slots = [trigrams(t) for t in texts]
    size = np.array([len(s) for s in slots])
    flat, starts = np.concatenate(slots), np.cumsum(size) - size
    w, bias = np.zeros(SLOTS), 0.0
    m, s = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    balance = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean()))
    for k in range(1, steps + 1):
        z = np.add.reduceat(w[flat], starts) / size + bias
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        g = np.append(np.bincount(flat, np.repeat(slope / size, size), SLOTS) + ridge * w, slope.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", clear: float = 0.9, max_train_rows: int = 6000, max_passages: int = 5, passage_chars: int = 2000) -> QualityModel:
    """The label model from the votes on all documents, the scorer from a bounded sample.

    At most 3**8 vote patterns with their counts reach the driver. The scorer
    learns from at most ``max_train_rows`` documents (half of each kind, the
    smallest by the hash of the id) whose posterior is at least ``clear`` either
    way, and from ``max_passages`` passages of ``passage_chars`` characters of
    each, chosen by hash over the whole text; if one kind has none, every
    document gets the prior.
    """

    @F.pandas_udf("int")
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pattern(votes(t)) for t in texts], dtype="int32")

    cast = cut(docs.select(F.col(id_col).alias("_id"), voted(F.col(text_col).cast("string")).alias("_pattern")))
    counts = cast.groupBy("_pattern").count().orderBy("_pattern").toPandas()
    patterns, n = counts["_pattern"].to_numpy(np.int64), counts["count"].to_numpy(float)
    labels = fit_label_model(patterns, n)
    p = labels.posterior(patterns)
    parts = []
    for kind in (patterns[p >= clear], patterns[p <= 1 - clear]):
        chosen = cast.filter(F.col("_id").isNotNull() & F.col("_pattern").isin(kind.tolist())).dropDuplicates(["_id"])
        parts.append(chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows // 2))
    sample = parts[0].unionByName(parts[1])  # its size is bounded by max_train_rows
    passages = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"(?s).{{1,{passage_chars}}}"), F.lit(0))
    some = F.slice(F.array_sort(F.transform(passages, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, max_passages)
    texts = docs.select(F.col(id_col).alias("_id"), F.array_join(some["x"], " ").alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id").toPandas().sort_values("_id", kind="stable").drop_duplicates("_id")
    target = labels.posterior(rows["_pattern"].to_numpy(np.int64)) if len(rows) else np.zeros(0)
    if not ((target > 0.5).any() and (target <= 0.5).any()):
        return QualityModel(labels, np.zeros(SLOTS), float(np.log(labels.prior / (1 - labels.prior))))
    return QualityModel(labels, *_fit_scorer(rows["_text"].tolist(), target))


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality", weak_col: str = "weak_label") -> DataFrame:
    """``docs`` with the scorer's probability and the posterior of the votes (columns of those names are replaced).

    Edge cases: a null text counts as empty, and an empty text scores as its one
    blank trigram; repeated rows score alike; very long texts are scored whole;
    an empty table gives an empty table; other columns pass through.

    At scale: one pass without a shuffle; the model broadcast has a fixed size.
    """
    known = np.arange(3 ** len(LABELLERS))
    shared = docs.sparkSession.sparkContext.broadcast((model, model.labels.posterior(known)))

    @F.pandas_udf(f"{score_col} double, {weak_col} double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, posterior = shared.value
        for texts in batches:
            found = texts.tolist()
            yield pd.DataFrame({score_col: scorer.scores(found), weak_col: posterior[[pattern(votes(t)) for t in found]]})

    held = "_quality"
    while held in docs.columns:
        held += "_"
    both = docs.withColumn(held, score(F.col(text_col).cast("string")))
    return both.withColumns({score_col: F.col(held)[score_col], weak_col: F.col(held)[weak_col]}).drop(held)
