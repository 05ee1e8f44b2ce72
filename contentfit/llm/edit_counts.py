"""Token counts that follow edits without re-encoding whole texts.

``index_tokens`` encodes a text once and keeps a *segment table*: its
pre-tokens in runs of ``LEAF`` pre-tokens, each with its characters and tokens.
``apply_edits`` builds a segment tree over the runs (sums of characters and
tokens), descends it to the runs that an edit touches, and re-encodes only
those and boundary context: one run before, and after the edit as far as the
new pre-token boundaries need to meet the old ones.  From there on the old
counts hold, as a pre-token depends on nothing before it; the changed runs'
sums are updated up to the root, which has the text's count.

``count_edited`` does both in one pass for a whole table, a worker at a time.

Edits are ``(start, end, text)`` in characters of the text as it was; where
they overlap, the one that starts first holds, and of those the longest.

Defined cases: null and empty texts have no tokens; a null edit list is an
empty one; positions beyond the text are clipped, negative and reversed ones
are ignored; edits that tie in start and end count once, the first; repeated
rows and null ids are counted like any; an edit of a very long text copies
only what is near it; an empty table gives no rows; columns of ``docs`` named like a result (``leaf_chars``,
``leaf_tokens``, ``tokens_before``, ``tokens_after``, ``n_edits``, ``reencoded_chars``) are replaced by it.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import free_name, slices, text_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
CACHED = 200_000  # pre-tokens
CACHED_CHARS = 64  # longer pre-tokens are encoded each time
EDITS = "array<struct<start: int, end: int, text: string>>"
_EDIT_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

# What ``redactions`` masks: e-mail addresses, and runs of digits as in phone, card and account numbers.
_MASKED = (("<EMAIL>", r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64}){1,8}"), ("<NUMBER>", r"\+?\d(?:[ ()./-]{0,2}\d){6,24}"))
_MASKS = re.compile("|".join(f"({p})" for _, p in _MASKED))
_NUMBERS = re.compile("()" + f"({_MASKED[1][1]})")  # for texts without an @


class TokenCounter:
    """Pre-tokens of a text and their token counts, cached by pre-token."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import regex
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for p in parts:
            if p not in known and len(p) <= CACHED_CHARS:
                known[p] = len(self.encode(p))
        return [known[p] if len(p) <= CACHED_CHARS else len(self.encode(p)) for p in parts]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


_counters: dict[str, TokenCounter] = {}


def _counter(vocabulary: str) -> TokenCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def leaves(counter: TokenCounter, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of ``LEAF`` pre-tokens."""
    parts = counter.split(text)
    at = np.arange(0, len(parts), LEAF)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), at),
            np.add.reduceat(np.array(counter.count(parts), np.int64), at))


class SegmentTree:
    """Sums over leaves, in an array whose node ``i`` has children ``2i`` and
    ``2i + 1``; column 0 sums characters, column 1 tokens."""

    def __init__(self, chars, tokens):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), dtype=np.int64)
        self.sums[self.size:self.size + len(chars), 0] = chars
        self.sums[self.size:self.size + len(chars), 1] = tokens
        level = self.size
        while level > 1:
            half = level >> 1
            self.sums[half:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level = half

    def locate(self, char: int) -> tuple[int, int]:
        """``(leaf, its first character)`` for a character position; the last
        leaf of the tree for positions at the end or beyond."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[node, 0])
            if char >= before + left:
                before += left
                node += 1
        return node - self.size, before

    def set(self, leaf: int, chars: int, tokens: int):
        node = leaf + self.size
        change = np.array((chars, tokens)) - self.sums[node]
        while node:
            self.sums[node] += change
            node >>= 1

    @property
    def total(self) -> tuple[int, int]:
        return int(self.sums[1, 0]), int(self.sums[1, 1])


def valid_edits(edits: list[dict] | None, length: int) -> list[tuple[int, int, str]]:
    """Edits in order and without overlaps."""
    clipped = sorted(((e["start"], -min(e["end"], length), e["text"] or "") for e in edits or []
                      if e and e["start"] is not None and e["end"] is not None and 0 <= e["start"] <= min(e["end"], length)))
    out, done = [], 0
    for start, end, text in clipped:
        if start >= done and not (out and start == out[-1][0]):
            out.append((start, -end, text))
            done = -end
    return out


def edit_text(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, done = [], 0
    for start, end, new in edits:
        parts += [text[done:start], new]
        done = end
    return "".join([*parts, text[done:]])


class Tail:
    """The text behind an edit as pieces, the nearest last, so that no edit
    copies what follows it."""

    def __init__(self):
        self.pieces: list[tuple[str, int, int]] = []

    def put(self, text: str, lo: int, hi: int):
        """Put ``text[lo:hi]`` before what is there."""
        if lo < hi:
            self.pieces.append((text, lo, hi))

    def first(self, n: int) -> str:
        """The first ``n`` characters, or all if there are fewer."""
        out = []
        for text, lo, hi in reversed(self.pieces):
            if n <= 0:
                break
            out.append(text[lo:min(hi, lo + n)])
            n -= hi - lo
        return "".join(out)


def recount(counter: TokenCounter, text: str, chars, tokens, edits: list[tuple[int, int, str]]
            ) -> tuple[list[int], list[int], int]:
    """``(chars, tokens, re-encoded characters)``: the leaf sums after the
    edits.  Edits are applied from the last to the first, so positions of
    earlier ones and their leaves stay as they were."""
    if not len(chars):
        new = edit_text(text, edits)
        c, t = leaves(counter, new)
        return c.tolist(), t.tolist(), len(new)
    tree, n, touched = SegmentTree(chars, tokens), len(chars), 0
    tail, done = Tail(), len(text)
    for start, end, new in reversed(edits):
        leaf = min(tree.locate(start)[0], n - 1)
        at = sum_before(tree, leaf)
        # For the same reason, as much before the edit is context.
        while leaf and start - at < 4:
            leaf -= 1
            at = sum_before(tree, leaf)
        tail.put(text, end, done)
        tail.put(new, 0, len(new))
        done = start
        shift, last, stop = len(new) - (end - start), leaf, at + int(tree.sums[leaf + tree.size, 0])
        while True:
            # Old runs up to ``last`` end at old character ``stop``; is it a boundary of the new text as well?
            while last < n - 1 and stop < end + 1:
                last += 1
                stop += int(tree.sums[last + tree.size, 0])
            # A pre-token's end may depend on the two characters behind it: a few more make its end certain.
            size = (stop + 4 if last < n - 1 else tree.total[0]) + shift - at
            region = (text[at:start] + tail.first(size - (start - at)))[:size]
            parts = counter.split(region)
            goal, size, taken = stop + shift - at, 0, 0
            if last == n - 1:
                taken, size = len(parts), len(region)
                break
            while size < goal and taken < len(parts):
                size += len(parts[taken])
                taken += 1
            if size == goal:
                break
            last += 1
            stop += int(tree.sums[last + tree.size, 0])
        counts = counter.count(parts[:taken])
        touched += size
        # The new pre-tokens are dealt over the leaves from ``leaf`` to ``last``; leaves may grow or become empty.
        each = -(-taken // (last - leaf + 1)) if taken else 0
        for j in range(leaf, last + 1):
            lo, hi = (j - leaf) * each, min((j - leaf + 1) * each, taken)
            tree.set(j, sum(map(len, parts[lo:hi])), sum(counts[lo:hi]))
    cells = tree.sums[tree.size:tree.size + n]
    return cells[:, 0].tolist(), cells[:, 1].tolist(), touched


def sum_before(tree: SegmentTree, leaf: int) -> int:
    """Characters before a leaf, from the left siblings on its path."""
    node, total = leaf + tree.size, 0
    while node > 1:
        if node & 1:
            total += int(tree.sums[node - 1, 0])
        node >>= 1
    return total


def masks(text: str) -> list[dict]:
    """Edits that mask e-mail addresses and long digit runs."""
    return [{"start": m.start(), "end": m.end(), "text": _MASKED[m.lastindex - 1][0]}
            for m in (_MASKS if "@" in text else _NUMBERS).finditer(text)]


def redactions(text_col: str) -> Column:
    """``masks`` as a column of edits."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masks(t) for t in texts.to_pylist()], _EDIT_TYPE)
    return F.arrow_udf(run, EDITS)(F.col(text_col))


def count_edited(docs: DataFrame, edits_of: Callable[[str], list[dict]] = masks, id_col: str = "doc_id",
                 text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_edits, tokens_before, tokens_after, reencoded_chars`` of every
    row: indexed, edited and recounted in one pass, one text at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for raw in text_bytes(batch.column(1)):
                text = raw.tobytes().decode("utf-8", "replace") if raw is not None else ""
                chars, tokens = leaves(counter, text)
                before = after = int(tokens.sum())
                edits, touched = valid_edits(edits_of(text), len(text)) if text else [], 0
                if edits:
                    _, new, touched = recount(counter, text, chars, tokens, edits)
                    after = sum(new)
                out.append((len(edits), before, after, touched))
            columns = np.array(out, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(columns[:, i]) for i in (1, 2, 3))],
                names=["doc_id", "n_edits", "tokens_before", "tokens_after", "reencoded_chars"])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_edits int, tokens_before long, tokens_after long, reencoded_chars long")


def index_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``leaf_chars`` and ``leaf_tokens``, its segment table."""
    def run(texts: pa.Array) -> pa.Array:
        counter = _counter(vocabulary)
        pairs = [leaves(counter, t or "") for t in texts.to_pylist()]
        return pa.array([{"chars": c, "tokens": t} for c, t in pairs], pa.struct(
            [("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]))
    index = F.arrow_udf(run, "struct<chars: array<long>, tokens: array<long>>").asNondeterministic()
    own = free_name("leaves", docs.columns)
    return (docs.withColumn(own, index(F.col(text_col)))
            .withColumn("leaf_chars", F.col(f"{own}.chars")).withColumn("leaf_tokens", F.col(f"{own}.tokens")).drop(own))


def apply_edits(indexed: DataFrame, edits: Column, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``indexed`` with the edits applied: the text, its segment table, and
    ``tokens_before, tokens_after, n_edits, reencoded_chars``."""
    result = pa.struct([("text", pa.string()), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())),
                        ("n_edits", pa.int32()), ("reencoded", pa.int64())])

    def run(texts: pa.Array, chars: pa.Array, tokens: pa.Array, changes: pa.Array) -> pa.Array:
        counter, out = _counter(vocabulary), []
        for t, c, k, e in zip(texts.to_pylist(), chars.to_pylist(), tokens.to_pylist(), changes.to_pylist()):
            some = valid_edits(e, len(t or "")) if e else []
            if some:
                c, k, touched = recount(counter, t or "", c, k, some)
                t = edit_text(t or "", some)
            out.append({"text": t, "chars": c, "tokens": k, "n_edits": len(some), "reencoded": touched if some else 0})
        return pa.array(out, result)

    udf = F.arrow_udf(run, "struct<text: string, chars: array<long>, tokens: array<long>, n_edits: int, reencoded: long>")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    own = free_name("done", indexed.columns)
    done = (indexed.withColumn("tokens_before", total("leaf_tokens"))
            .withColumn(own, udf.asNondeterministic()(F.col(text_col), "leaf_chars", "leaf_tokens", edits)))
    return (done.withColumn(text_col, F.col(f"{own}.text")).withColumn("leaf_chars", F.col(f"{own}.chars"))
            .withColumn("leaf_tokens", F.col(f"{own}.tokens")).withColumn("n_edits", F.col(f"{own}.n_edits"))
            .withColumn("reencoded_chars", F.col(f"{own}.reencoded")).drop(own)
            .withColumn("tokens_after", total("leaf_tokens")))
