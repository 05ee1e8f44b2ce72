"""Sequence packing by minimum bin slack.

Documents are tokenized and cut at multiples of the sequence length; only the
last piece of a document is shorter than a sequence.  What is packed is the
*histogram* of piece lengths, at most ``capacity`` numbers however large the
corpus.  Each step takes the longest length left and finds, by subset-sum
dynamic programming over bitsets with backtracked counts, the multiset of
remaining lengths that fills the rest of the window closest to capacity.  The
pattern found is used as often as the counts allow, so steps grow with the
number of lengths, not of documents.  Pieces are ranked within their length
(over salted groups, so that a length shared by a third of all pieces isn't
one task) and the rank picks a place in the plan.

Defined cases: null and empty texts have only the end id; every row is packed,
a repeated row or a null id too; a very long text is encoded by itself and cut
into full sequences and a rest; pieces of one length are told apart by id and
place, rows equal in all take the places in any order; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentfit.llm.common import text_bytes, tidy, word_hashes, word_spans, write_stage

CAPACITY = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 600_000
CACHED_IDS = 8_000_000
CACHED_PARTS = 100_000
HASHED_BYTES = 64
SLICE_BYTES = 2_000_000
GROUP_ROWS = 20_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# Words of printable ASCII and Latin-1 letters: lower-casing them is all the normalising they need.
_LATIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# The byte alphabet writes a byte that isn't a printable Latin-1 character as a letter from U+0100 on, in byte order:
# 33 control characters and the space, U+007F, then these.
_BYTE_LETTERS = {b: 256 + 34 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 256 + 34 + 33}


class WordEncoder:
    """Token ids of texts, through caches of white-space separated words and
    of their pre-tokens.

    The vocabulary's normaliser and splitter never join what white space
    separates, so a text's ids are its words' ids in a row.  A new word of
    ASCII and Latin-1 letters is split into pre-tokens here and only new
    pre-tokens go through the merges; any other word goes through the whole
    tokenizer.  The caches start anew when they are full.

    Words are told apart by 64-bit hashes, found and compared for a whole slice
    of texts at once; words of more than ``HASHED_BYTES`` bytes are encoded each
    time.  Against a full cache a new word's hash is taken for another's with
    odds of 3 in 10^14.
    """

    def __init__(self, vocabulary: str = VOCABULARY, cached_words: int = CACHED_WORDS):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.merge = self.tokenizer.model.tokenize
        self.cached_words = cached_words
        self._clear()

    def _clear(self):
        self.hashes, self.code_of = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)  # known words, sorted
        self.codes = 0
        self.parts: dict[str, bytes] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.at = np.zeros(1 << 14, dtype=np.int64)

    def _part(self, part: str) -> bytes:
        """A pre-token's ids as little-endian 32-bit numbers."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) > CACHED_PARTS:
                self.parts.clear()
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.parts[part] = array("I", [t.id for t in self.merge(letters)]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if not _LATIN.fullmatch(word) or "<|" in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        return self._part(word) if word.isalpha() else b"".join(map(self._part, _PARTS.findall(word)))

    def _add(self, words: list[bytes]) -> range:
        """Encode words; the codes under which their ids are kept."""
        ids = [self._word(w.decode("utf-8", "replace")) for w in words]
        k, used = self.codes, int(self.at[self.codes])
        joined = np.frombuffer(b"".join(ids), dtype=np.uint32)
        while len(self.at) <= k + len(words):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.flat) < used + len(joined):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used:used + len(joined)] = joined
        self.at[k + 1:k + 1 + len(words)] = used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        self.codes += len(words)
        return range(k, self.codes)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        if self.codes > self.cached_words or self.at[self.codes] > CACHED_IDS:
            self._clear()
        data = b" ".join(texts)
        buf = np.frombuffer(data, dtype=np.uint8)
        starts, ends = word_spans(buf)
        hashes = word_hashes(buf, starts, ends)
        long = np.flatnonzero(ends - starts > HASHED_BYTES)
        hashes[long] = hashes[long[0]] if len(long) else 0  # any value: their codes are set below
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, distinct)
        codes = np.full(len(distinct), -1, dtype=np.int64)
        hit = np.flatnonzero(place < len(self.hashes))
        hit = hit[self.hashes[place[hit]] == distinct[hit]]
        codes[hit] = self.code_of[place[hit]]
        new = np.flatnonzero(codes < 0)
        new = new[(ends - starts)[at[new]] <= HASHED_BYTES]
        codes[new] = self._add([data[starts[i]:ends[i]] for i in at[new]])
        self.hashes = np.insert(self.hashes, place[new], distinct[new])
        self.code_of = np.insert(self.code_of, place[new], codes[new])
        codes, known = codes[which], self.codes
        codes[long] = self._add([data[starts[i]:ends[i]] for i in long])

        first, size = self.at[codes], self.at[codes + 1] - self.at[codes]
        before = np.cumsum(size) - size
        ids = self.flat[np.repeat(first - before, size) + np.arange(int(size.sum()))]
        self.codes = known  # the ids of long words aren't kept
        stops = np.cumsum([len(t) + 1 for t in texts])  # where the next text's words begin
        last = np.searchsorted(starts, stops)
        total = np.append(before, len(ids))
        return np.split(ids, total[last][:-1]) if texts else []


_encoders: dict[str, WordEncoder] = {}


def _encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def _slices(column: pa.Array):
    """The column's texts as bytes, some megabytes at a time, with row numbers."""
    rows, size = [], 0
    for raw in text_bytes(column):
        rows.append(raw.tobytes() if raw is not None else b"")
        size += len(rows[-1])
        if size > SLICE_BYTES:
            yield rows
            rows, size = [], 0
    yield rows


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of ``capacity``."""
    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            ids_of, done = batch.column(0), 0
            for texts in _slices(batch.column(1)):
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    data = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(data), capacity):
                        piece = data[s:s + capacity]
                        row.append(done + i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(data))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(tidy(run), _PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``counts``' lengths whose sum is closest to ``room``
    from below, long lengths first, as counts by length."""
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << part * length & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= part * length
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)`` covering the histogram: patterns are counts by
    length, found by minimum bin slack with the longest length left fixed."""
    counts, plan = {k: n for k, n in histogram.items() if n > 0}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        pattern = fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // c for k, c in pattern.items())
        plan.append((pattern, times))
        for k, c in pattern.items():
            counts[k] -= c * times
            if not counts[k]:
                del counts[k]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: the length's ranks ``[lo, hi)`` that it takes,
    how many a sequence has, the first sequence, the first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            c, lo = pattern[length], used.get(length, 0)
            rows.append((length, lo, lo + c * times, c, sequence, offset))
            used[length] = lo + c * times
            offset += c * length
        sequence += times
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = write_stage(token_pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max(1, -(-sum(histogram.values()) // GROUP_ROWS))
    pieces = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = write_stage(pieces.groupBy("length", "__salt").agg(F.count("*").alias("n"))
                       .select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "ranks")
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.join(base, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)
    places = spark.createDataFrame(
        _places(plan_patterns(histogram, capacity)),
        "length long, __lo long, __hi long, __per long, __first long, __offset long")
    nth = F.col("__rank") - F.col("__lo")
    # The plan has a bounded number of rows: a few for each of at most `capacity` lengths.
    placed = ranked.join(F.broadcast(places), "length").where("__rank >= __lo and __rank < __hi")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("__first") + F.floor(nth / F.col("__per"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.pmod(nth, F.col("__per")) * F.col("length")).cast("long").alias("offset"))
