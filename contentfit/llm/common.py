"""Shared helpers: word and shingle hashing over Arrow text buffers, and tables
written to the cluster's shared folder to cut lineage.

A *word* is a maximal run of bytes other than space and 0x09-0x0D, the class
``[^\\x20\\x09-\\x0D]+``.  Words are found and hashed with numpy over a text's
UTF-8 bytes, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from contentfit.session import ensure_checkpoint_dir

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_SHINGLE_STEP = _U(0xD6E8FEB86659FD93)
_PLACE = _U(0x9E3779B97F4A7C15)
#: 8-byte pieces hashed at once, which bounds memory whatever a word's or line's length.
_PIECES = 1 << 18
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place (murmur's avalanche steps)."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte positions of the words of ``buf`` (uint8)."""
    edge = np.diff(np.concatenate(([0], (~SPACE[buf]).view(np.int8), [0])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes (a word, a line, a whole text).

    A span's 8-byte pieces are each mixed with their place in it; the sum,
    mixed with the length, is its hash.  Pieces of many spans go through numpy
    at once, some hundred thousand at a time.
    """
    size = ends - starts
    total = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate((buf, np.zeros(8, dtype=np.uint8)))
    at = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each position on
    pieces = -(-size // 8)
    upto = np.cumsum(pieces)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, _PIECES):
        hi = min(lo + _PIECES, int(upto[-1]))
        first, last = np.searchsorted(upto, (lo, hi - 1), side="right")
        begin = upto[first:last + 1] - pieces[first:last + 1]
        here = np.minimum(upto[first:last + 1], hi) - np.maximum(begin, lo)
        of = np.repeat(np.arange(first, last + 1), here)
        nth = np.arange(lo, hi) - np.repeat(begin, here)
        h = at[starts[of] + 8 * nth] & _LOW[np.minimum(size[of] - 8 * nth, 8)]
        h += (nth.astype(np.uint64) + _U(1)) * _PLACE
        mix64(h)
        some = np.flatnonzero(here)
        total[first + some] += np.add.reduceat(h, (np.cumsum(here) - here)[some])
    total += size.astype(np.uint64) * _SHINGLE_STEP
    return mix64(total)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each window of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= _SHINGLE_STEP
        acc += words[j:n + j]
    return mix64(acc)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole word sequence, with its length."""
    return int(run_hashes(words, np.array([0]), np.array([len(words)]))[0])


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``words[first:last]``; runs aren't empty and lie
    side by side.  Every word is mixed with its place in its run."""
    if not len(first):
        return np.empty(0, dtype=np.uint64)
    size = last - first
    nth = np.arange(int(first[0]), int(last[-1])) - np.repeat(first, size)
    h = mix64(words[first[0]:last[-1]] + (nth.astype(np.uint64) + _U(1)) * _PLACE)
    return mix64(np.add.reduceat(h, first - first[0]) + size.astype(np.uint64) * _SHINGLE_STEP)


def shingle_set(buf: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``k``-word shingles, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; one without
    words has none.
    """
    buf = LOWER[buf]
    words = word_hashes(buf, *word_spans(buf))
    if len(words) == 0:
        return words
    if len(words) < k:
        return np.array([sequence_hash(words)], dtype=np.uint64)
    return np.unique(window_hashes(words, k))


def text_bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each value's UTF-8 bytes as a view of the Arrow buffer; None for null."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n, first = len(column), column.offset
    at = np.frombuffer(offsets, dtype=np.int64)[first:first + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(n):
        yield raw[at[i]:at[i + 1]] if valid[i] else None


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one numpy array per row."""
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    full = [p for p in parts if len(p)]  # an empty array's own type must not decide that of the values
    flat = np.concatenate(full) if full else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about ``most`` bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, n * most // max(1, batch.get_total_buffer_size()))
    for lo in range(0, n, step):
        yield batch.slice(lo, step)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, and then give back to the system what the partition's work has
    freed, as a worker lives on between tasks."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)
    return tidied


def with_computed(df: DataFrame, name: str, kind: str, compute: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``df`` with a column ``name`` of SQL type ``kind`` that ``compute`` makes
    from a batch of rows.

    Rows go through the worker whole, some megabytes at a time; a Python
    function of some columns would keep the others queued in the executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([*part.columns, compute(part)], names=[*part.schema.names, name])
    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, StructField(name, DataType.fromDDL(kind))]))


ROWS_PER_FILE = 100_000


def write_stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor costs no more than the stage it was in, and
    what is read twice is computed once.  The folder is the session's
    ``spark.checkpoint.dir``.  ``rows``, if the caller knows about how many
    rows there are, keeps a small table from becoming many tiny files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS, BROADCAST_ITEMS = 500_000, 2_000_000


def few(df: DataFrame, items: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if it has at most
    ``BROADCAST_ROWS`` rows and ``items``, the size of a row's arrays, sum to at
    most ``BROADCAST_ITEMS``; else as it is, for a shuffle.  Whole texts that
    meet it then stay where they are."""
    n, size = df.agg(F.count("*"), F.sum(items if items is not None else F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_ITEMS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added while a column of ``taken`` has it (in any case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name
