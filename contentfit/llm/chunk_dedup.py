"""Substring dedup by content-defined chunks of a gear rolling hash.

The gear hash rolls over words: ``g[i] = h(w[i]) + 2 g[i-1]``, of which the low
bits depend on the last few words alone.  Where its low bits are zero is a
*boundary* (about one word in four).  Text of few distinct words may have none
for long, so every window of ``max_words - 1`` words without a boundary gets a
*forced start*: the places where a hash of the next few words is the window's
smallest.  A chunk starts at every boundary and forced start and ends at the
first boundary ``min_words`` or more later, at most ``max_words`` long.  Both
kinds of start depend on the text near them only, so an insertion elsewhere
moves no chunk, and a passage repeated at any place in two documents has the
same chunks in both but for its edges.  Starts are less than ``max_words``
apart: a passage of ``2 max_words - 1`` words holds a whole chunk, and no word
between its first and last chunk is left out.  Chunks may overlap; what is
removed is their union.

Chunks are deduplicated by digest: of each digest the smallest id keeps its
occurrences, other documents lose theirs.  A removed word is in a chunk that an
earlier document has, so nothing disappears from the corpus.  Chunks shared by
no other document stay, also where one document repeats itself.

Defined cases: null and empty texts and texts shorter than ``min_words`` have
no chunks; rows with a null id are left alone; rows of one id count as one
document and lose the same word positions; of equal chunks the smallest id's
stay; a very long text is chunked by itself, in memory that follows its own
length; an empty table gives no rows; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import (LOWER, few, free_name, list_array, mix64, slices, text_bytes, tidy, window_hashes, with_computed,
                                   word_hashes, word_spans, write_stage)

MIN_WORDS = 20
MAX_WORDS = 26
BOUNDARY_BITS = 2
#: Words that the hash of a forced start covers.
FORCED_WORDS = 8


def gear_boundaries(words: np.ndarray, bits: int = BOUNDARY_BITS) -> np.ndarray:
    """Word positions where the gear hash's low ``bits`` bits are zero.  Those
    depend on ``bits`` words; before that many words there is no boundary."""
    g = words.copy()
    for j in range(1, bits):
        g[j:] += words[:-j] << np.uint64(j)
    at = np.flatnonzero((g & np.uint64((1 << bits) - 1)) == 0)
    return at[at >= bits - 1]


def forced_starts(words: np.ndarray, boundaries: np.ndarray, window: int, bits: int = BOUNDARY_BITS) -> np.ndarray:
    """Positions with the smallest hash of ``FORCED_WORDS`` words, ties included,
    in some window of ``window`` positions without a boundary."""
    edges = np.concatenate(([bits - 2], boundaries, [len(words)]))
    found = []
    for gap in np.flatnonzero(np.diff(edges) > window):
        lo, hi = int(edges[gap]) + 1, int(edges[gap + 1])
        h = np.full(hi - lo, np.iinfo(np.uint64).max)  # the last words of the text have no hash
        known = window_hashes(words[lo:hi + FORCED_WORDS - 1], FORCED_WORDS)
        h[:len(known)] = known
        least = np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1)
        around = np.pad(least, window - 1)  # of the windows that a position is in, the largest minimum
        found.append(lo + np.flatnonzero(np.lib.stride_tricks.sliding_window_view(around, window).max(axis=1) == h))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def chunks(words: np.ndarray, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
           bits: int = BOUNDARY_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, size, digest)`` of the chunks of a sequence of word hashes.  A
    chunk that the text's end cuts off before ``min_words`` doesn't count."""
    boundaries = gear_boundaries(words, bits)
    at = np.union1d(boundaries, forced_starts(words, boundaries, max_words - 1, bits))
    at = at[at + min_words <= len(words)]
    if not len(at):
        return at, at, np.empty(0, dtype=np.int64)
    ends = np.append(boundaries, len(words))
    end = np.minimum(ends[np.searchsorted(ends, at + min_words)], np.minimum(at + max_words, len(words)))
    step, inverse = np.uint64(0xA0761D6478BD642F), np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words) - 1, step))))
    back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(words) - 1, inverse))))
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)))
    digest = mix64((total[end] - total[at]) * back[at] + (end - at).astype(np.uint64))
    return at, end - at, digest.view(np.int64)


def _words(raw: np.ndarray) -> np.ndarray:
    raw = LOWER[raw]
    return word_hashes(raw, *word_spans(raw))


def document_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                    max_words: int = MAX_WORDS) -> DataFrame:
    """One row per chunk: ``id, start, size, digest`` (positions in words)."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            found = [chunks(_words(raw), min_words, max_words) if raw is not None else chunks(np.empty(0, np.uint64))
                     for raw in text_bytes(batch.column(1))]
            start, size, digest = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_array(list(start), pa.int32()), list_array(list(size), pa.int32()),
                 list_array(list(digest), pa.int64())], names=["id", "start", "size", "digest"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col).where("id is not null").mapInArrow(
        tidy(run), "id long, start array<int>, size array<int>, digest array<long>")
    return rows.select("id", F.explode(F.arrays_zip("start", "size", "digest")).alias("c")).select(
        "id", "c.start", "c.size", "c.digest")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document that loses words: ``doc_id, n_removed_words``, the
    merged word spans ``starts, ends`` and ``first_doc_ids``, the documents
    that keep the passages."""
    found = document_chunks(docs, id_col, text_col, min_words, max_words)
    shared = write_stage(found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                         .where("first < last").select("digest", "first"), "shared-chunks")
    hits = (document_chunks(docs, id_col, text_col, min_words, max_words).join(shared, "digest")
            .where("id > first").select("id", "start", "size", "first"))
    merged = hits.groupBy("id").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
        F.sort_array(F.collect_set("first")).alias("first_doc_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [merge_spans(*(row.values.field(i).to_numpy() for i in (0, 1))) for row in batch.column(1)]
            sizes = [int((e - s).sum()) for s, e in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), list_array([s for s, _ in found], pa.int32()),
                 list_array([e for _, e in found], pa.int32()), batch.column(2)],
                names=["doc_id", "n_removed_words", "starts", "ends", "first_doc_ids"])
    return merged.mapInArrow(tidy(run), "doc_id long, n_removed_words long, starts array<int>, ends array<int>, first_doc_ids array<long>")


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans, which come sorted."""
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(new[1:], True)]


def cut_words(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    at, _ = word_spans(buf)
    edge = np.append(at, len(buf))
    keep, done = [], 0
    for s, e in zip(starts, ends):
        s, e = min(s, len(at)), min(e, len(at))
        keep.append(raw[done:edge[s]])
        done = int(edge[e])
    return b"".join([*keep, raw[done:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with repeated passages cut from the text; same columns and rows."""
    names = [*docs.columns]
    own = {}
    for name in ("span_id", "starts", "ends", "cut"):
        own[name] = free_name(name, [*names, *own.values()])
    spans = write_stage(repeated_spans(docs, id_col, text_col, **params).select(
        F.col("doc_id").alias(own["span_id"]), F.col("starts").alias(own["starts"]), F.col("ends").alias(own["ends"])), "spans")
    joined = docs.join(few(spans, F.size(own["starts"])), F.col(id_col) == F.col(own["span_id"]), "left").drop(own["span_id"])
    text_at, starts_at, ends_at = (joined.columns.index(c) for c in (text_col, own["starts"], own["ends"]))

    def cut(batch: pa.RecordBatch) -> pa.Array:
        out = []
        for i, raw in enumerate(text_bytes(batch.column(text_at))):
            if raw is None:
                out.append(None)
                continue
            starts = batch.column(starts_at)[i].as_py()
            out.append(raw.tobytes() if starts is None else cut_words(raw.tobytes(), starts, batch.column(ends_at)[i].as_py()))
        return pa.array(out, pa.binary()).cast(pa.string())
    touched = with_computed(joined, own["cut"], "string", cut)
    return touched.select(*(F.col(own["cut"]).alias(c) if c == text_col else F.col(f"`{c}`") for c in names))
