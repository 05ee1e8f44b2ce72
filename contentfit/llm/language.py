"""Language identification by error-correcting output codes.

Every language gets a codeword.  Up to seven languages have the exhaustive
code (one bit for every split of the languages in two), more have pseudo-random
words of ``8 log2(languages)`` bits, at least 24.  For every bit a logistic
classifier over hashed byte 2- and 3-grams predicts which side of the split a
text is on.  Decoding sums over bits the logistic loss of each language's
codeword against the predicted margins; the smallest loss wins, its share of
``exp(-loss)`` is the score, and a text whose runner-up comes within
``ambiguous_margin`` is flagged.

Weights are fitted by AdaGrad, one pass over a bounded sample: about
``max_per_language`` rows of each language, picked by a hash of the id, outside
the held-out fold.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text when nothing was learned; one language alone is predicted for
all other texts with score 1; rows of a null language aren't learned from;
repeated rows and null ids are predicted like any; equally near codewords go
to the first language in order; a very long text is read block by block; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import LOWER, fold_of, mix64, text_bytes, write_stage
from contentfit.llm.labels import held_out

FOLDS, HELD_OUT = 4, 2
BITS = 15
MAX_PER_LANGUAGE = 1_500
RATE = 0.5
AMBIGUOUS_MARGIN = 0.2
UNDETERMINED = "und"

_BLOCK = 1 << 20


def codewords(n: int) -> np.ndarray:
    """``(n, bits)`` matrix of +1 and -1, rows distinct."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    bits = max(24, 8 * int(np.ceil(np.log2(n))))
    at = np.arange(n * bits, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)
    code = np.where(mix64(at) >> np.uint64(63), 1.0, -1.0).reshape(n, bits)
    return code[:, np.abs(code.sum(axis=0)) < n]  # a bit that is the same for all tells nothing


def grams(raw: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of the byte 2- and 3-grams of a lower-cased text."""
    b = LOWER[raw].astype(np.uint32)
    two = (b[:-1] << 8 | b[1:]) * np.uint32(0x9E3779B1)
    three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)
    return np.concatenate([two, three]) >> np.uint32(32 - bits)


def _blocks(raw: np.ndarray, bits: int):
    """Grams of a text block by block; blocks overlap by two bytes."""
    for i in range(0, max(1, len(raw)), _BLOCK):
        yield grams(raw[max(0, i - 2):i + _BLOCK], bits)


def margins(raw: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each bit's margin: the intercept and the mean weight of the text's grams."""
    total, n = np.zeros(weights.shape[1]), 0
    for at in _blocks(raw, bits):
        total += weights[at].sum(axis=0, dtype=np.float64)
        n += len(at)
    return total / max(1, n) + weights[-1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def decode(margin: np.ndarray, code: np.ndarray) -> tuple[int, float, float]:
    """``(language, score, lead)``: the codeword of least logistic loss, its
    share of exp(-loss), and the lead over the runner-up's share."""
    loss = np.logaddexp(0, -code * margin).sum(axis=1)
    share = np.exp(loss.min() - loss)
    share /= share.sum()
    order = np.argsort(-share, kind="stable")
    best = int(order[0])
    return best, float(share[best]), float(share[best] - share[order[1]]) if len(order) > 1 else 1.0


def _learn(rows: list[tuple[np.ndarray, int]], code: np.ndarray, bits: int) -> np.ndarray:
    """AdaGrad on the bits' logistic losses; the last row is the intercept."""
    size = 1 << bits
    w, seen = np.zeros((size + 1, code.shape[1])), np.full((size + 1, code.shape[1]), 1e-8)
    for raw, language in rows:
        times = sum(np.bincount(block, minlength=size) for block in _blocks(raw, bits))
        at = np.flatnonzero(times)
        if not len(at):
            continue
        x = np.append(times[at] / times.sum(), 1.0)[:, None]
        at = np.append(at, size)
        y = code[language]
        g = x * (-y / (1 + np.exp(np.clip(y * (w[at] * x).sum(axis=0), -30, 30))))
        seen[at] += g * g
        w[at] -= RATE * g / np.sqrt(seen[at])
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS,
        max_per_language: int = MAX_PER_LANGUAGE) -> tuple[list[str], np.ndarray | None]:
    """``(languages, weights)``."""
    known = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .where("id is not null and text is not null and lang is not null")
             .where(~held_out(F.col("id"), FOLDS, HELD_OUT)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return languages, None
    code = codewords(len(languages))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, max_per_language / counts[k]))))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, i)))
    order = F.xxhash64("id", F.lit(29))
    sample = write_stage(
        known.where(F.pmod(order, F.lit(1_000_000)) < 1_000_000 * F.get(F.array(share[F.col("lang")]), F.lit(0)))
        .select(order.alias("order"), number[F.col("lang")].alias("label"), "text"), "languages")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.frombuffer(t.encode(), dtype=np.uint8), y) for f in frames for t, y in zip(f["text"], f["label"])]
        w = _learn(rows, code, bits).astype(np.float32)
        some = np.flatnonzero(np.any(w != 0, axis=1))
        yield pd.DataFrame({"at": some, "w": [w[i].tolist() for i in some]})

    # The sample is bounded, so one task streams it in hash order.
    rows = sample.repartition(1).sortWithinPartitions("order").select("label", "text").mapInPandas(
        learn, "at long, w array<float>").collect()
    weights = np.zeros(((1 << bits) + 1, code.shape[1]), dtype=np.float32)
    for r in rows:
        weights[r["at"]] = r["w"]
    return languages, weights


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray | None], id_col: str = "doc_id",
            text_col: str = "text", bits: int = BITS, ambiguous_margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every row."""
    languages, weights = model
    code = codewords(len(languages))

    def run(batches):
        for batch in batches:
            out = []
            for raw in text_bytes(batch.column(1)):
                if raw is None or not languages or not has_letter(raw.tobytes().decode("utf-8", "replace")):
                    out.append((UNDETERMINED, 0.0, False))
                elif weights is None:
                    out.append((languages[0], 1.0, False))
                else:
                    best, score, lead = decode(margins(raw, weights, bits), code)
                    out.append((languages[best], score, lead < ambiguous_margin))
            lang, score, unsure = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score",
                       "ambiguous")


def identify(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the known languages and predict every document's."""
    model = fit(docs, **columns)
    columns.pop("lang_col", None)
    return predict(docs, model, **columns)
