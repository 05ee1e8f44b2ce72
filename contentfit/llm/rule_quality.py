"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest of shallow trees is fitted on the statistics; every path from
a root to a node is a conjunctive rule (``a <= 3.1 and b > 0.2``).  A lasso
logistic regression over the rules' 0/1 indicators keeps a few of them, which
are compiled into Spark column expressions: the score is the logistic of the
intercept and the weights of the rules that hold.

Statistics are computed for whole texts.  Fitting reads at most
``max_fit_rows`` labelled rows outside the held-out fold (see ``labels``).

Defined cases: null and empty texts have all statistics 0 and a score from
them; with one class only, every score is that class's smoothed share;
without labels it is 0.5; repeated rows and null ids are scored like any; equal
texts score the same, and a score of exactly the threshold is predicted 1; a
very long text is read whole and by itself; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import (LOWER, SPACE, free_name, list_array, text_bytes, window_hashes, with_computed, word_hashes,
                                   word_spans, write_stage)
from contentfit.llm.labels import held_out, labelled_sample

MAX_FIT_ROWS = 20_000
FIT_PARTITIONS = 8  # of the sample, which is small however many files the documents have
TREES, DEPTH = 24, 3
LASSO = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "mean_word_chars", "symbol_share", "upper_share", "digit_share", "punctuation_share", "exclaim_share",
    "pipe_share", "non_ascii_share", "lines_per_word", "repeated_line_share", "distinct_word_share",
    "repeated_triple_share", "repeated_window_share", "top_word_share", "single_char_word_share", "max_run_share",
    "stop_mark_share")
_KIND = {name: np.isin(np.arange(256), list(chars)) for name, chars in (
    ("symbol", b"#*$%&|<>@^~_=+\\/{}[]"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"),
    ("punctuation", b".,;:!?'\"-()"), ("exclaim", b"!"), ("pipe", b"|"), ("stop", b".?!"))}


def statistics(raw: np.ndarray) -> np.ndarray:
    """The statistics of a text, in the order of ``STATISTICS``."""
    out = np.zeros(len(STATISTICS))
    starts, ends = word_spans(raw)
    n = len(starts)
    if n == 0:
        return out
    histogram = np.bincount(raw, minlength=256)
    count = {k: int(histogram[m].sum()) for k, m in _KIND.items()}
    size = int(histogram[~SPACE].sum())
    lowered = LOWER[raw]
    words = word_hashes(lowered, starts, ends)
    _, times = np.unique(words, return_counts=True)
    breaks = np.flatnonzero(raw == 10)
    lo, hi = np.append(0, breaks + 1), np.append(breaks, len(raw))
    lo, hi = lo[hi > lo], hi[hi > lo]
    lines = word_hashes(raw, lo, hi)

    def repeated(k):
        w = window_hashes(words, k)
        return 1 - len(np.unique(w)) / len(w) if len(w) else 0.0

    same = np.flatnonzero(np.diff(words) != 0)
    runs = np.diff(np.concatenate(([-1], same, [n - 1])))
    out[:] = (
        np.log1p(n), size / n, count["symbol"] / size, count["upper"] / size, count["digit"] / size,
        count["punctuation"] / size, count["exclaim"] / size, count["pipe"] / size, histogram[128:].sum() / size,
        len(lines) / n, 1 - len(np.unique(lines)) / len(lines), len(times) / n, repeated(3), repeated(8),
        times.max() / n, np.count_nonzero(ends - starts == 1) / n, runs.max() / n,
        np.count_nonzero(_KIND["stop"][raw[ends - 1]]) / n)
    return out


def with_statistics(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the statistics of a text as an array column, computed once per row."""
    at, empty = df.columns.index(text_col), np.empty(0, dtype=np.uint8)

    def compute(batch: pa.RecordBatch) -> pa.Array:
        return list_array([statistics(raw if raw is not None else empty) for raw in text_bytes(batch.column(at))], pa.float64())
    return with_computed(df, name, "array<double>", compute)


def tree_paths(debug: str) -> set[tuple[tuple[int, str, float], ...]]:
    """The rules of a forest, from its printed form: for every node the
    comparisons on its path, the tightest for each feature and side."""
    rules, path = set(), []
    for line in debug.splitlines():
        if line.lstrip().startswith("Tree "):
            path = []
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+\d.eE]+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, int(found[2]), found[3], float(found[4]))]
            tight: dict[tuple[int, str], float] = {}
            for _, f, op, x in path:
                old = tight.get((f, op), x)
                tight[f, op] = min(old, x) if op == "<=" else max(old, x)
            rules.add(tuple(sorted((f, op, x) for (f, op), x in tight.items())))
    return rules


def rule_column(rule: tuple[tuple[int, str, float], ...], stats: str) -> Column:
    """A rule as a condition on the statistics column."""
    holds = F.lit(True)
    for f, op, x in rule:
        value = F.get(F.col(stats), F.lit(f))
        holds = holds & (value <= x if op == "<=" else value > x)
    return holds


class RuleModel:
    """Intercept and weighted rules; ``score`` compiles them to a column."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self, stats: str) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_fit_rows: int = MAX_FIT_ROWS) -> RuleModel:
    """Rules from a forest, weights from a lasso."""
    sample = labelled_sample(docs, labels, label_col, max_fit_rows, id_col, text_col)
    sample = with_statistics(sample.select(F.col("label").cast("double").alias("label"), "text"), "text", "stats")
    rows = write_stage(sample.select("label", "stats").repartition(FIT_PARTITIONS), "statistics").cache()
    share = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = share["n"], share["ones"] or 0.0
    if ones in (0.0, float(n)):
        rows.unpersist()
        odds = (ones + 1) / (n + 2)
        return RuleModel(float(np.log(odds / (1 - odds))), [])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, seed=11).fit(
        rows.select("label", array_to_vector("stats").alias("features")))
    rules = sorted(tree_paths(forest.toDebugString))
    held = F.array(*(rule_column(r, "stats").cast("double") for r in rules))
    lasso = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, maxIter=60).fit(
        rows.select("label", array_to_vector(held).alias("features")))
    rows.unpersist()
    return RuleModel(lasso.intercept, [(r, w) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "stats")
    return rows.withColumn("score", model.score("stats")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold; same columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    stats = free_name("stats", docs.columns)
    return with_statistics(docs, text_col, stats).where(model.score(stats) >= threshold).drop(stats)
