"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the presence of its word unigrams, bigrams and
skip-grams (pairs one word apart), hashed to ``2**bits`` coordinates; words are
runs of letters and digits, A-Z lower-cased.  FTRL-proximal fits the weights
online: every coordinate has its own learning rate from the gradients it has
seen, and its L1 term leaves all but a few thousand weights at zero.  Those
are sent to the tasks as index and value arrays, and every whole text is
scored.

Fitting reads at most ``max_fit_rows`` labelled rows outside the held-out fold
(see ``labels``), dealt over ``shards`` tasks that each stream their rows in
hash order, ``epochs`` times; the shards' weights are averaged.

Defined cases: null and empty texts score from the intercept alone; without
labels every score is 0.5; repeated rows and null ids are scored like any; an
id labelled twice takes the larger label; a score of exactly 0.5 is predicted
1; a very long text is read whole, by itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import LOWER, list_array, mix64, text_bytes, word_hashes
from contentfit.llm.labels import held_out, labelled_sample

BITS = 20
MAX_FIT_ROWS = 20_000
SHARDS = 2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1

LETTER = np.zeros(256, dtype=bool)
LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
LETTER[128:] = True
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(raw: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text's n-grams and skip-grams, with repeats."""
    buf = LOWER[raw]
    edge = np.diff(np.concatenate(([0], LETTER[buf].view(np.int8), [0])).astype(np.int8))
    h = word_hashes(buf, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
    grams = np.concatenate([h, mix64(h[:-1] * _PAIR + h[1:]), mix64(h[:-2] * _PAIR + h[2:] + np.uint64(1))])
    return (grams >> np.uint64(64 - bits)).astype(np.int32)


class Ftrl:
    """FTRL-proximal state: ``z`` and ``n`` for each coordinate; the last is
    the intercept, which isn't regularised."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        size = (1 << bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.l1 = np.full(size, l1)
        self.l1[-1] = 0.0

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int):
        """One step on a text with the distinct coordinates ``at``."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        bits: int = BITS, max_fit_rows: int = MAX_FIT_ROWS, shards: int = SHARDS,
        epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``(coordinates, weights, intercept)``, None without labelled rows."""
    def shape(batches):
        for batch in batches:
            at = [np.unique(features(raw, bits)) for raw in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(at, pa.int32())],
                                             names=["order", "label", "at"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[int, list] = {}  # a task may have several shards, each learns by itself
        for f in frames:
            for shard, a, y in zip(f["shard"], f["at"], f["label"]):
                rows.setdefault(shard, []).append((a, y))
        for shard in sorted(rows):
            model = Ftrl(bits)
            for _ in range(epochs):
                for at, label in rows[shard]:
                    model.learn(at, label)
            w = model.weights(np.arange(len(model.z)))
            some = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
            yield pd.DataFrame({"at": some, "w": w[some]})

    sample = labelled_sample(docs, labels, label_col, max_fit_rows, id_col, text_col)
    shaped = sample.select("order", "label", "text").mapInArrow(shape, "order long, label int, at array<int>")
    per_shard = (shaped.withColumn("shard", F.pmod("order", F.lit(shards)))
                 .repartition(shards, "shard").sortWithinPartitions("shard", "order")
                 .select("shard", "label", "at").mapInPandas(learn, "at long, w double"))
    rows = per_shard.groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    if not rows:
        return None
    used = max(r["n"] for r in rows)
    weights = {r["at"]: r["w"] / used for r in rows}
    intercept = weights.pop(1 << bits)
    at = np.array(sorted(weights), dtype=np.int64)
    return at, np.array([weights[i] for i in at], dtype=np.float64), intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, id_col: str = "doc_id",
          text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    def run(batches):
        if model is not None:
            table = np.zeros(1 << bits)
            table[model[0]] = model[1]
        for batch in batches:
            out = []
            for raw in text_bytes(batch.column(1)):
                total = 0.0
                if model is not None:
                    total = model[2]
                    if raw is not None:
                        at = features(raw, bits)
                        total += table[np.unique(at[table[at] != 0])].sum()
                out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Fit on ``labels.toxic`` and score every document."""
    return score(docs, fit(docs, labels, **columns), **columns)
