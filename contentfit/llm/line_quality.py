"""Quality rules with cross-document line frequency.

Per document: counts of words, characters, symbols, repeated lines and
repeated 5-word windows.  Per host: every line is normalised (A-Z lower-cased,
words joined by one space) and hashed, and the distinct documents (ids) holding
it are counted; copies of a text under several ids are several documents.
Lines of more than ``max_docs`` documents of a host are removed, and a document
that keeps less than ``min_left_pct`` percent of its words is depleted and
rejected, as is one that fails the base rules.

Defined cases: a null or empty text has no words and fails the base rules;
rows of a null host share one host; repeated rows, and rows of one id, are one
document in the counts and each get a verdict for their own text; a row with a
null id is no document that could be counted, but gets its verdict; a line in
exactly ``max_docs`` documents stays; a text of any length is hashed in pieces of
bounded memory; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import (LOWER, SPACE, list_array, run_hashes, slices, text_bytes, window_hashes, word_hashes,
                                   word_spans, write_stage)

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_DOCS_PER_HOST = 20
MIN_LEFT_PCT = 30
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = ("doc_id long, host string, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS)
           + ", line array<long>, line_words array<int>")


def text_counts(raw: np.ndarray) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """``(counts, line hashes, words per line)``; lines are distinct, their
    words summed over repeats."""
    starts, ends = word_spans(raw)
    n = len(starts)
    none = np.empty(0, dtype=np.int64)
    symbols = int(np.count_nonzero(SYMBOLS[raw]))
    if n == 0:
        return (0, 0, symbols, 0, 0), none, none
    chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~SPACE[raw]))
    words = word_hashes(raw, starts, ends)

    repeated = 0
    windows = window_hashes(words, WINDOW_WORDS)
    if len(windows):
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(times[which] > 1)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW_WORDS, -1)
        repeated = int(np.count_nonzero(np.cumsum(cover[:n])))

    breaks = np.flatnonzero(raw == 10)
    number = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    last = np.append(first[1:], n)
    at = number[first]
    line_lo = np.where(at > 0, breaks[np.maximum(at, 1) - 1] + 1, 0) if len(breaks) else np.zeros(len(at), np.int64)
    line_hi = np.append(breaks, len(raw))[at]
    exact = word_hashes(raw, line_lo, line_hi)
    dup = len(exact) - len(np.unique(exact))

    lowered = LOWER[raw]
    lines = run_hashes(word_hashes(lowered, starts, ends), first, last)
    distinct, which = np.unique(lines, return_inverse=True)
    per_line = np.bincount(which, weights=last - first).astype(np.int64)
    return (n, chars, symbols, dup, repeated), distinct.view(np.int64), per_line


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source") -> DataFrame:
    """Counts, text hash and distinct line hashes of every row."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows, lines, sizes, hashes = [], [], [], []
            for raw in text_bytes(batch.column(2)):
                raw = raw if raw is not None else np.empty(0, dtype=np.uint8)
                counts, line, size = text_counts(raw)
                rows.append(counts)
                lines.append(line)
                sizes.append(size)
                whole = word_hashes(raw, np.array([0]), np.array([len(raw)])) if len(raw) else np.zeros(1, np.uint64)
                hashes.append(int(whole.view(np.int64)[0]))
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(_COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hashes, pa.int64()),
                 *(pa.array(columns[:, i]) for i in range(len(_COUNTS))),
                 list_array(lines, pa.int64()), list_array(sizes, pa.int32())],
                names=["doc_id", "host", "text_hash", *_COUNTS, "line", "line_words"])
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    return docs.select(F.col(id_col).cast("long"), host, F.col(text_col)).mapInArrow(run, _SCHEMA)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  max_docs: int = MAX_DOCS_PER_HOST, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """One row per input row: the counts, ``n_removed_words``, ``base_failed``
    and ``kept``."""
    rows = write_stage(document_lines(docs, id_col, text_col, host_col), "lines")
    lines = rows.select("doc_id", "host", "text_hash", F.explode(F.arrays_zip("line", "line_words")).alias("l")).select(
        "doc_id", "host", "text_hash", F.col("l.line").alias("line"), F.col("l.line_words").alias("words"))
    # Two steps: documents of a line meet by id first, so a line of a third of all rows is counted in parts.
    holders = lines.where("doc_id is not null").select("host", "line", "doc_id").distinct()
    common = write_stage(holders.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
                         .select("host", "line"), "common-lines")
    removed = (lines.join(common, ["host", "line"]).select("doc_id", "host", "text_hash", "line", "words").distinct()
               .groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("n_removed_words")))
    removed = removed.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"),
                             F.col("text_hash").alias("__text"), "n_removed_words")
    out = rows.drop("line", "line_words").join(
        removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("host") == F.col("__host"))
        & (F.col("text_hash") == F.col("__text")), "left")
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < min_left_pct * F.col("n_words")
    return out.select("doc_id", *_COUNTS, gone.alias("n_removed_words"), failed.alias("base_failed"),
                      (~failed & ~depleted).alias("kept"))
