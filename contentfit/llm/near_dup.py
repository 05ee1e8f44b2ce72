"""MinHash near-dedup with odd sketches.

A document's set is its distinct ``k``-word shingles (as 64-bit hashes).
Documents of one set are one *class*, named by a 128-bit digest of the set.
Each class has ``bands * rows`` MinHash samples, used twice:

* every ``rows`` samples make one band key; classes sharing a key are
  candidates (at Jaccard 0.8 and 32 bands of 4, all but 5 in 10^8 links);
* all samples are folded into an *odd sketch*: sample ``(i, value)`` flips one
  bit of a parity bitmap.  Equal samples cancel in the XOR of two bitmaps, so
  its population count estimates how many samples differ, most precisely
  when few do.  Candidates whose count can't come from a similarity at the
  threshold (``reject_bits``) are dropped before their sets are read.

What passes is confirmed on the full sets.  A band's bucket isn't expanded into
pairs.  Its smallest class is its *hub*.  Every class is verified against its
smallest hub, then, where components still differ, against its other hubs.
What is left are classes of different components in a bucket.  For these each
class has a bitmap of the hub's shingles that it has and a hashed bitmap of its
other shingles, and the number of those that no other open class has (its
*private* ones, see ``_linkable``): two of them share as many of the hub's
shingles as the bitmaps have common bits, and no more others than the hashed
bitmaps and the fewer of the not private ones allow.  That bound is close, so
most pairs that pass it are links, and it never fails, so none is lost.

Defined cases: an empty or null text has no shingles and links with nothing; a
text of fewer than ``k`` words is one shingle; a row with a null id is linked
with nothing and stays; rows of one id stay or go by their own text, and a row
repeated whole stays or goes as one; of equal sets the smallest id stays; a
very long text's set is made by itself, in memory that follows its own length;
an empty table gives no rows; extra columns of any name are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentfit.llm.common import few, free_name, list_array, mix64, shingle_set, slices, text_bytes, tidy, with_computed, write_stage
from contentfit.llm.graph import components

SHINGLE_WORDS = 4
THRESHOLD_PCT = 80
BANDS, ROWS = 32, 4
SKETCH_BITS = 256

_SAMPLES_SCHEMA = "id long, n_shingles long, digest binary, bands array<long>, odd array<long>"
_SLICE = 2048


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds[n:].astype(np.uint32)


def minhash_samples(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash samples: minima of ``n`` odd-multiplier permutations of
    the 32-bit folded shingles, a slice at a time to stay in cache."""
    mult, add = _coefficients(n)
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), _SLICE):
        part = mult[:, None] * x[None, i:i + _SLICE]
        part += add[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    rows = samples.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return acc.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of the samples as 64-bit words."""
    at = mix64((np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) + samples) % np.uint64(bits)
    parity = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def reject_bits(samples: int, bits: int, threshold: float) -> int:
    """Population count that a pair at the threshold exceeds with odds of about
    one in 10^9: six standard deviations above the mean.  The deviation is that
    of the number of differing samples, each of which flips two bits, and that
    of folding them into the bitmap."""
    flipped = 2 * samples * (1 - threshold)
    clear, clear_pair = (1 - 2 / bits) ** flipped, (1 - 4 / bits) ** flipped
    sampling = 4 * samples * threshold * (1 - threshold) * clear ** 2
    folding = bits / 4 * (1 - clear_pair) + bits ** 2 / 4 * (clear_pair - clear ** 2)
    return int(bits * (1 - clear) / 2 + 6 * (sampling + folding) ** 0.5)


def class_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                  bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """Per row: id, set size, set digest, band keys and odd sketch (null
    digest, keys and sketch without shingles)."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for raw in text_bytes(batch.column(1)):
                s = shingle_set(raw, k) if raw is not None and len(raw) else ()
                if len(s):
                    m = minhash_samples(s, bands * rows)
                    out.append((len(s), set_digest(s), band_keys(m, bands), odd_sketch(m, bits)))
                else:
                    out.append((0, None, (), ()))
            n, digest, keys, odd = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 list_array(list(keys), pa.int64()), list_array(list(odd), pa.int64())],
                names=["id", "n_shingles", "digest", "bands", "odd"])
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(run), _SAMPLES_SCHEMA)


def full_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``(digest, shingles)`` of rows' full sets."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(raw, k) for raw in text_bytes(batch.column(0)) if raw is not None]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in sets], pa.binary()),
                 list_array([s.view(np.int64) for s in sets], pa.int64())], names=["digest", "shingles"])
    return docs.select(text_col).mapInArrow(tidy(run), "digest binary, shingles array<long>")


def _flips(a: str, b: str, words: int) -> Column:
    """Population count of the XOR of two odd sketches."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)), F.lit(0))


def _confirm(pairs: DataFrame, sets: DataFrame, pct: int, most_bits: int, words: int) -> DataFrame:
    """Pairs ``(u, v)`` whose odd sketches allow the threshold and whose full
    sets reach it."""
    a = sets.select(F.col("digest").alias("u"), F.col("odd").alias("odd_u"), F.col("shingles").alias("set_u"))
    b = sets.select(F.col("digest").alias("v"), F.col("odd").alias("odd_v"), F.col("shingles").alias("set_v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    size = F.size("set_u") + F.size("set_v")
    likely = pairs.join(a, "u").join(b, "v").where(_flips("odd_u", "odd_v", words) <= most_bits)
    return likely.where(100 * both >= pct * (size - both)).select("u", "v")


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """Flags as 64-bit words."""
    return np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64, dtype=bool))), bitorder="little").view(np.int64)


def hub_bitmaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Per pair ``(hub, digest)``: ``bits``, which of the hub's shingles, in its
    set's order, the other class has, and ``common``, how many; ``others``, its
    other shingles hashed into four times as many bits, and ``lost``, how many
    of those fell on a bit that was set."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            columns = [], [], [], []
            for hub, mine in zip(batch.column(2), batch.column(3)):
                hub, mine = hub.values.to_numpy(), mine.values.to_numpy()
                other = mine[~np.isin(mine, hub, assume_unique=True)]
                size = 256 * -(-len(hub) // 64)
                at = np.unique(mix64(other.view(np.uint64).copy()) % np.uint64(size)).astype(np.int64)
                hashed = np.zeros(size, dtype=bool)
                hashed[at] = True
                found = _bitmap(np.isin(hub, mine, assume_unique=True)), len(mine) - len(other), _bitmap(hashed), len(other) - len(at)
                for column, value in zip(columns, found):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                 list_array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())],
                names=["hub", "digest", "bits", "common", "others", "lost"])
    a = sets.select(F.col("digest").alias("hub"), F.col("shingles").alias("hub_set"))
    both = pairs.join(a, "hub").join(sets.select("digest", "shingles"), "digest").select("hub", "digest", "hub_set", "shingles")
    return both.mapInArrow(tidy(run), "hub binary, digest binary, bits array<long>, common int, others array<long>, lost int")


def _linkable(left: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Members ``(key, band, digest, label, hub)`` that can still be linked in
    their bucket, with set size ``n``, ``own``, the number of private shingles,
    and ``most``, the largest set they can link to.

    A private shingle is one that no other open class and no hub of an open
    bucket has, so it can't be shared.  A set of ``n`` shares at most ``n - own``, and a
    partner has at most ``(100 + pct)(n - own)/pct - n`` shingles.  That is
    exact, is counted without pairs, and settles most near copies that fall
    short of the threshold.
    """
    ends = left.select("digest").unionByName(left.select(F.col("hub").alias("digest"))).distinct()
    opened = write_stage(ends.join(sets, "digest").select("digest", "shingles"), "opened")
    own = (opened.select("digest", F.explode("shingles").alias("s")).groupBy("s")
           .agg(F.count("*").alias("c"), F.min("digest").alias("digest")).where("c = 1")
           .groupBy("digest").agg(F.count("*").alias("own")))
    sizes = opened.select("digest", F.size("shingles").alias("n")).join(own, "digest", "left").select(
        "digest", "n", F.coalesce("own", F.lit(0)).alias("own"))
    sizes = sizes.withColumn("most", F.floor((100 + pct) * (F.col("n") - F.col("own")) / pct) - F.col("n"))
    left = write_stage(left.join(write_stage(sizes, "sizes"), "digest"), "open")
    least = write_stage(left.groupBy("key").agg(F.min("n").alias("least")), "least")
    return left.join(least, "key").where("most >= least").drop("least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, n_links``.

    ``component_id`` is the smallest id reachable over links of Jaccard
    similarity ``pct``/100 or more; ``n_links`` counts the class's confirmed
    links to other classes (at least one in each component of several
    classes, not all pairs).  ``params`` are those of ``_verdicts``.
    """
    return _verdicts(docs, id_col, text_col, **params).drop("digest")


def _verdicts(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE_WORDS, pct: int = THRESHOLD_PCT,
              bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of ``near_duplicates`` with their set digest."""
    samples = write_stage(class_samples(docs, id_col, text_col, k, bands, rows, bits), "samples")
    most, words = reject_bits(bands * rows, bits, pct / 100), bits // 64
    classes = write_stage(
        samples.where("digest is not null and id is not null").groupBy("digest")
        .agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "classes")
    keyed = classes.select("digest", F.posexplode("bands").alias("band", "key"))
    hubs = write_stage(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("hub")).where("n > 1")
                       .select("key", F.col("n").alias("in_bucket"), "hub"), "hubs")
    members = write_stage(keyed.join(hubs, "key").where("hub <> digest"), "members")

    ends = members.select("digest").unionByName(hubs.select(F.col("hub").alias("digest"))).distinct()
    sketches = write_stage(classes.join(ends, "digest"), "sketches")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_col).join(
        few(sketches.select("rep").distinct()), "rep", "left_semi")
    sets = write_stage(full_sets(texts, "rep", text_col, k).join(sketches.select("digest", "odd"), "digest")
                       .groupBy("digest").agg(F.first("odd").alias("odd"), F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs):
        return write_stage(_confirm(pairs, sets, pct, most, words), "links")

    def ordered(a, b):
        return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")

    def labelled(frame, end="digest", label="label"):
        star = stars.select(F.col("node").alias(end), F.col("label").alias(label))
        return frame.join(star, end, "left").withColumn(label, F.coalesce(label, end))

    def linked(pairs):
        """The links with those among ``pairs``, and the components so far."""
        new = confirmed(pairs)
        if new.isEmpty():
            return links, stars
        merged = stars.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(new)
        return write_stage(links.unionByName(new).distinct(), "links"), components(merged)

    first = write_stage(members.groupBy("digest").agg(F.min("hub").alias("first")), "first-hubs")
    links = confirmed(first.select(*ordered("first", "digest")))
    stars = components(links)

    others = members.join(first, "digest").where("hub <> first").select("digest", "hub").distinct()
    now = labelled(labelled(others), "hub", "hub_label").where("label <> hub_label")
    links, stars = linked(now.select(*ordered("hub", "digest")).distinct())

    # Only buckets of three or more classes hold a pair without their hub.
    now = write_stage(labelled(members.where("in_bucket > 2")), "open")
    mixed = write_stage(now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                        .where("lo <> hi").select("key"), "mixed")
    left = write_stage(now.join(mixed, "key").select("key", "band", "digest", "label", "hub"), "open")
    left = write_stage(_linkable(left, sets, pct), "linkable")
    bitmaps = write_stage(hub_bitmaps(left.select("hub", "digest").distinct(), sets), "bitmaps")
    left = left.join(bitmaps, ["hub", "digest"]).join(sketches.select("digest", "odd", "bands"), "digest")
    left = write_stage(left.withColumn("rest", F.col("n") - F.col("common") - F.col("own")).drop("hub", "common", "own"), "open")
    right = left.select("key", *(F.col(c).alias(f"other_{c}") for c in ("digest", "label", "n", "most", "odd", "bands", "bits", "rest", "others", "lost")))
    first_shared = F.array_position(F.zip_with("bands", "other_bands", lambda a, b: a == b), F.lit(True))

    def common_bits(c):
        return F.aggregate(F.zip_with(c, f"other_{c}", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, m: n + m)

    shared = common_bits("bits") + F.least("rest", "other_rest", common_bits("others") + F.least("lost", "other_lost"))
    pairs = left.join(right, "key").where(
        (F.col("digest") < F.col("other_digest")) & (F.col("label") != F.col("other_label"))
        & (F.col("other_n") <= F.col("most")) & (F.col("n") <= F.col("other_most"))
        & (_flips("odd", "other_odd", words) <= most)
        & ((100 + pct) * shared >= pct * (F.col("n") + F.col("other_n")))
        & (first_shared == F.col("band") + 1))  # a pair of several common buckets comes from one
    links, stars = linked(pairs.select(F.col("digest").alias("u"), F.col("other_digest").alias("v")))

    ends = links.select(F.col("u").alias("digest")).unionByName(links.select(F.col("v").alias("digest")))
    degree = write_stage(ends.groupBy("digest").agg(F.count("*").alias("n_links")), "degree")
    placed = write_stage(
        labelled(classes.select("digest", "rep")).join(degree, "digest", "left")
        .select("digest", "rep", "label", F.coalesce("n_links", F.lit(0)).alias("n_links")), "placed")
    smallest = write_stage(placed.groupBy("label").agg(F.min("rep").alias("component")), "smallest")
    placed = write_stage(placed.join(smallest, "label").select("digest", "component", "n_links"), "placed")
    out = samples.select("id", "n_shingles", "digest").join(placed, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "digest")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                         **params) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` drops; same columns."""
    own = free_name("near_id", docs.columns)
    of_set, mine = free_name("near_set", docs.columns), free_name("near_digest", docs.columns)
    verdict = write_stage(_verdicts(docs, id_col, text_col, k, **params).where("doc_id is not null")
                          .groupBy(F.col("doc_id").alias(own), F.col("digest").alias(of_set))
                          .agg(F.min("kept").alias("kept")), "verdicts")
    gone = write_stage(verdict.groupBy(own).agg(F.min("kept").alias("all"), F.max("kept").alias("some"))
                       .where("not all").select(own, "some"), "dropped")
    out = docs.join(few(gone.select(own)), F.col(id_col) == F.col(own), "left_anti")
    mixed = gone.where("some").select(own)
    if mixed.isEmpty():
        return out

    # An id with texts that go and texts that stay: its rows are told apart by their sets.
    at = docs.columns.index(text_col)

    def digest(batch: pa.RecordBatch) -> pa.Array:
        sets = [shingle_set(raw, k) if raw is not None and len(raw) else () for raw in text_bytes(batch.column(at))]
        return pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())

    rows = with_computed(docs.join(mixed, F.col(id_col) == F.col(own), "left_semi"), mine, "binary", digest)
    left = rows.join(verdict.where("not kept").select(own, of_set), (F.col(id_col) == F.col(own)) & (F.col(mine) == F.col(of_set)),
                     "left_anti")
    return out.unionByName(left.drop(mine))
