"""Quality classification with supervised subword embeddings.

Words and character n-grams are hashed into one table of learned vectors; the
mean vector of a document goes through a softmax layer. The table and the layer
are trained by stochastic gradient descent in numpy on a bounded labelled
sample. Scoring uses that a linear layer of a mean is a mean: each bucket's
vector is multiplied with the layer once, and documents average the products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import prepare, text_slices, unit_hash

#: Lengths in bytes of the character n-grams, within and across words.
NGRAMS = (3, 4)
SLICE_CHARS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.uint8(32)
_FOLD = bytes(32 if b < 33 else b for b in range(256))


def _mixed(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Hash 64-bit keys of one kind of feature to ``bits`` bits."""
    x = (x ^ np.uint64(kind * 0x51ED270B)) * _ODD
    return (x >> np.uint64(64 - bits)).astype(np.int32)


def features(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets in text order, and where each text's begin (one more at the end).

    A blank stands before and after each text, so that every text, even an empty one,
    has a feature of some kind; those of one text never reach into another.
    """
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(_FOLD) + b"     " for t in texts]
    x = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    wide = x.astype(np.uint64)
    key = wide.copy()
    for n in range(2, max(NGRAMS) + 1):
        key = key[:-1] << np.uint64(8) | wide[n - 1 :]
        if n in NGRAMS:
            # The blanks at a text's end are its own: a gram from its last letters stays inside.
            inside = np.ones(len(key), bool)
            for back in range(1, n):
                ends = starts[1:] - back
                inside[ends[(ends < len(inside)) & (ends >= 0)]] = False
            counts = np.concatenate([[0], np.cumsum(np.maximum(np.diff(starts) - n + 1, 0))])
            yield _mixed(key[inside], n, bits), counts
    blank = x == _BLANK
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    # A word's hash: the sum of its bytes times powers, shifted back to the word's start.
    power = np.full(len(x), _ODD)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    back = np.full(len(x), np.uint64(pow(int(_ODD), -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * power)])
    words = (sums[last] - sums[first]) * back[first]
    begins = np.searchsorted(first, starts)
    yield _mixed(words, 1, bits), begins
    # Word trigrams up to naming: which of the last three words of a text are equal.
    place = np.arange(len(words)) - np.repeat(begins[:-1], np.diff(begins))
    one = np.zeros(len(words), bool)
    two = np.zeros(len(words), bool)
    one[1:] = (words[1:] == words[:-1]) & (place[1:] > 0)
    two[2:] = (words[2:] == words[:-2]) & (place[2:] > 1)
    before = np.concatenate([[False], one[:-1]])[: len(one)]
    pattern = (one + 2 * two + 4 * before).astype(np.uint64)
    yield _mixed(pattern, 2, bits), begins


@dataclass(frozen=True)
class QualityModel:
    """Log-odds that each bucket adds as a mean, and the constant."""

    bits: int
    odds: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, starts in features(texts, self.bits):
            sums = np.concatenate([[0.0], np.cumsum(self.odds[buckets], dtype=np.float64)])
            total += sums[starts[1:]] - sums[starts[:-1]]
            count += np.diff(starts)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of its features in each."""
    found, counts = np.unique(np.concatenate([b for b, _ in features([text], bits)]), return_counts=True)
    return found.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32)


def fit(
    bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int, dims: int, epochs: int, rate: float, seed: int
) -> QualityModel:
    """Minibatch gradient descent of vectors and softmax layer, by numpy."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / dims, 1.0 / dims, (1 << bits, dims)).astype(np.float32)
    layer = np.zeros((dims, 2), np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    weight = np.clip(weight, 0.2, 5.0)
    size, steps = 32, 0
    planned = epochs * -(-len(bags) // size)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), size):
            some = order[begin : begin + size]
            ids = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some])[:, None]
            lengths = np.array([len(bags[i][0]) for i in some])
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            mean = np.add.reduceat(table[ids] * share, at, axis=0)
            logits = mean @ layer + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(some)), labels[some]] -= 1
            chance *= weight[some][:, None]
            step = rate * (1 - steps / planned)
            pulled = (chance @ layer.T).astype(np.float32)
            slope = (mean.T @ chance).astype(np.float32) / len(some)
            layer -= step * slope / max(1.0, float(np.linalg.norm(slope)))
            bias -= step * chance.mean(axis=0).astype(np.float32)
            moves = np.repeat(pulled, lengths, axis=0) * share
            for d in range(dims):
                table[:, d] -= step * np.bincount(ids, moves[:, d], len(table))
            steps += 1
    odds = (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    return QualityModel(bits, odds, float(bias[1] - bias[0]))


def train_quality(
    labelled: DataFrame,
    text_column: str = "text",
    label_column: str = "quality",
    id_column: str = "doc_id",
    max_rows: int = 2000,
    bits: int = 16,
    dims: int = 8,
    epochs: int = 10,
    rate: float = 4.0,
    seed: int = 7,
) -> QualityModel:
    """Learn from a seeded sample of about ``max_rows`` labelled rows (all, if fewer).

    The sample's texts are read whole; what reaches the driver is each one's
    distinct buckets with their shares. Rows with a null label teach nothing, null
    texts count as empty. Without rows of both labels the score is the constant share of label 1.
    """
    prepare(labelled.sparkSession)
    known = labelled.where(F.col(label_column).isin(0, 1))
    size = known.count()
    sample = known.where(unit_hash(seed, id_column) < max_rows / max(size, 1)).select(
        F.col(id_column).cast("string").alias("id"),
        F.col(label_column).cast("int").alias("label"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bag(text, bits) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "label": batch["label"],
                    "buckets": [b.tobytes() for b, _ in found],
                    "shares": [s.tobytes() for _, s in found],
                }
            )

    rows = sample.mapInPandas(bags, "id string, label int, buckets binary, shares binary").collect()
    rows = sorted(rows, key=lambda r: (r["id"] or "", r["label"], bytes(r["buckets"])))
    labels = np.array([r["label"] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        return QualityModel(bits, np.zeros(1 << bits, np.float32), float(np.log(mean / (1 - mean))))
    pairs = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return fit(pairs, labels, bits, dims, epochs, rate, seed)


def score_quality(
    docs: DataFrame, model: QualityModel, text_column: str = "text", score_column: str = "score"
) -> DataFrame:
    """Add the chance of label 1, from 0 to 1, for every row's whole text.

    Null texts count as empty and get a score too. Every row gives one row with all its
    columns; a column that already has the score's name is replaced.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text))
        frame = pd.DataFrame({"text": text.fillna("").to_numpy(), "at": np.arange(len(text))})
        for part in text_slices([frame], "text", SLICE_CHARS):
            out[part["at"].to_numpy()] = shared.value.score(part["text"].tolist())
        return pd.Series(out)

    kept = docs.drop(score_column)
    return kept.withColumn(score_column, score(F.col(text_column)))
