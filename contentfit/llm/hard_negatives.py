"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered.  For a cluster, every candidate has an upper bound on
its inner product with any member: its length times the cosine of its angle to
the centre less the widest member's angle.  A task sorts its candidates by
that bound once for each cluster, and every member walks that list until the
bound falls below what it still needs, so what it hasn't seen can't matter.
Bounds are widened for rounding, and scores are exact integers, so the result
is that of scoring everything.

Two walks: the first finds each anchor's best rows of its label (its
positives); the second, for each positive, the best rows of other labels whose
score is at most the positive's and at least ``floor_pct`` percent of it.  What
a task has found carries over from one block of candidates to the next, and
each task sends a few rows for each anchor to the merge.

Anchors are a share of all rows, so they are taken in chunks of about
``CHUNK_ANCHORS`` (whole clusters, by range), each sent to the tasks and walked
against all rows; neither side is shuffled.  Clusters are fitted on at most
``FIT_ANCHORS`` anchors picked by a hash; they decide how long the walks are, not
what they find.

Defined cases: rows with a null label, a null, empty or odd-width vector or a
component that is null or not finite take no part; a row with a null id is a
candidate after all others of its score and no anchor; repeated rows are rows of
their own, so a copy of an anchor is one of its positives; an anchor without
positives, or a positive without negatives, gives no rows; a negative positive
score leaves an empty range; zero vectors score 0; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentfit.llm.common import write_stage
from contentfit.llm.int_vectors import exact_products, ids_column, ids_of, matrix, scaled_rows
from contentfit.session import ensure_checkpoint_dir

SCALE = 256
POSITIVES, NEGATIVES, FLOOR_PCT = 5, 5, 80
CHUNK_ANCHORS = 20_000
FIT_ANCHORS = 10_000
CLUSTER_ANCHORS, MAX_CLUSTERS = 64, 256
#: Candidates of a list that members are scored against at once.
STEP = 1024
_FOUND = "anchor long, need long, id long, score long"


class Best:
    """The best ``k`` candidates of each need so far, by score, then id."""

    def __init__(self, needs: int, k: int):
        self.k = k
        self.rows = np.empty((0, 3), dtype=np.int64)  # need, -score, id
        self.least = np.full(needs, np.iinfo(np.int64).min)  # the score that a full need's next candidate must reach

    def add(self, need: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([need, -score, ids], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        self.rows = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.least[full[:, 0]] = -full[:, 1]


class Cluster:
    """Members of a cluster (rows ``at`` of the chunk), and what each still needs.

    A need is a range of scores, ``low`` to ``high``, of which the best ``k``
    candidates are wanted.
    """

    def __init__(self, at: np.ndarray, anchors: dict, needs: dict, k: int):
        self.at, self.v, self.label, self.row = at, anchors["v"][at], anchors["label"][at], anchors["row"][at]
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        centre = unit.sum(axis=0)
        size = np.sqrt((centre ** 2).sum())
        self.centre = centre / size if size > 1e-9 else None
        # Without a centre, or with a zero vector, any angle is possible.
        self.width = np.pi if self.centre is None or not self.length.all() else float(
            np.arccos(np.clip(unit @ self.centre, -1, 1)).max())
        self.needs = np.flatnonzero(np.isin(needs["anchor"], at))
        self.member = np.searchsorted(at, needs["anchor"][self.needs])
        self.low, self.high = needs["low"][self.needs], needs["high"][self.needs]
        self.best = Best(len(self.needs), k)

    def bounds(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Upper bounds of the candidates' products with a member of length 1."""
        if self.centre is None:
            return length * (1 + 1e-9)
        angle = np.arccos(np.clip((x @ self.centre) / np.maximum(length, 1e-300), -1, 1))
        return length * np.cos(np.maximum(0, angle - self.width - 1e-6)) + length * 1e-9

    def wanted(self) -> np.ndarray:
        """The score that each need's next candidate must reach."""
        return np.maximum(self.low, self.best.least)

    def walk(self, x: np.ndarray, length: np.ndarray, label: np.ndarray, row: np.ndarray, ids: np.ndarray, same: bool) -> int:
        """Search a block of candidates; returns how many products were made."""
        if not len(self.needs):
            return 0
        bound, made = self.bounds(x.astype(np.float64), length), 0
        order = np.argsort(-bound)
        for lo in range(0, len(order), STEP):
            wanted = self.wanted()  # of a member's needs, the lowest counts; one without needs wants nothing
            least = np.full(len(self.at), np.inf)
            np.minimum.at(least, self.member, wanted.astype(np.float64))
            active = np.flatnonzero(least <= self.length * bound[order[lo]] + 1e-6)
            if not len(active):
                break
            some = order[lo:lo + STEP]
            scores = exact_products(self.v[active], x[some])
            made += scores.size
            equal = self.label[active][:, None] == label[some][None, :]
            right = (equal if same else ~equal) & (self.row[active][:, None] != row[some][None, :])
            own = np.full(len(self.at), -1)
            own[active] = np.arange(len(active))
            need = np.flatnonzero(own[self.member] >= 0)
            scores_of, right_of = scores[own[self.member[need]]], right[own[self.member[need]]]
            n, c = np.nonzero(right_of & (scores_of >= wanted[need][:, None]) & (scores_of <= self.high[need][:, None]))
            if len(n):
                self.best.add(need[n], scores_of[n, c], ids[some[c]])
        return made


def _walk(rows: DataFrame, anchors: dict, needs: dict, k: int, same: bool, path: str) -> DataFrame:
    """The best ``k`` candidates for each need of a chunk's anchors, one file
    set for each chunk (written again whole if a task is lost)."""
    width = anchors["v"].shape[1]
    labels = sorted(set(anchors["names"]))
    own = dict(zip(labels, range(len(labels))))
    anchors = {**anchors, "label": np.array([own[n] for n in anchors["names"]], dtype=np.int64)}
    del anchors["names"]
    known = pa.array(labels, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = [Cluster(np.flatnonzero(anchors["cluster"] == c), anchors, needs, k) for c in np.unique(anchors["cluster"])]
        for batch in batches:
            x = matrix(batch.column(3), width)
            length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            label = pc.fill_null(pc.index_in(batch.column(2), known), -1).to_numpy(zero_copy_only=False)
            row, ids = batch.column(0).to_numpy(zero_copy_only=False), ids_of(batch.column(1))
            for cluster in clusters:
                cluster.walk(x, length, label, row, ids, same)
        for cluster in clusters:
            need, score, ids = cluster.best.rows[:, 0], -cluster.best.rows[:, 1], cluster.best.rows[:, 2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors["row"][cluster.at[cluster.member[need]]]), pa.array(needs["number"][cluster.needs[need]]),
                 ids_column(ids), pa.array(score)], names=["anchor", "need", "id", "score"])

    found = rows.select("row", "id", "label", "v").mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "need").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(ranked.schema).parquet(path)


def clustered(anchors: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """``anchors`` with ``cluster`` and ``chunk``, and how many chunks there are."""
    n = anchors.count()
    k = min(MAX_CLUSTERS, max(1, n // CLUSTER_ANCHORS))
    if k == 1:
        anchors = anchors.withColumn("cluster", F.lit(0))
    else:
        unit = Normalizer(inputCol="raw", outputCol="unit").transform(
            anchors.withColumn("raw", array_to_vector(F.col("v").cast("array<double>"))))
        sample = write_stage(unit.orderBy(F.xxhash64("id"), "row").limit(FIT_ANCHORS).select("unit"), "anchor-sample")
        model = KMeans(k=k, featuresCol="unit", predictionCol="cluster", maxIter=5, seed=13).fit(sample)
        anchors = model.transform(unit).drop("raw", "unit")
    anchors = write_stage(anchors, "clustered")
    # Whole clusters share a chunk; one larger than a chunk is split by a hash.  At most MAX_CLUSTERS rows.
    plan, at, filled = [], 0, 0
    for r in anchors.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect():
        pieces = -(-r["n"] // chunk)
        if filled and filled + r["n"] > chunk:
            at, filled = at + 1, 0
        plan.append((r["cluster"], at, pieces))
        at, filled = (at + pieces, 0) if pieces > 1 else (at, filled + r["n"])
    plan = anchors.sparkSession.createDataFrame(plan, "cluster int, first int, pieces int")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
    return anchors.join(F.broadcast(plan), "cluster").withColumn("chunk", F.col("first") + piece).drop("first", "pieces"), n


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   floor_pct: int = FLOOR_PCT, chunk: int = CHUNK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each anchor and each of its first ``positives`` rows
    of the same label, the first ``negatives`` rows of other labels that score
    between ``floor_pct`` percent of the positive's score and that score.

    ``is_anchor`` is a condition on ``id``; scores are products of the scaled
    integers, higher first, ties by smaller id.
    """
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, width = scaled_rows(df, id_col, vec_col, F.col("label") if label is None else label, scale)
    rows = rows.where("label is not null")
    anchors, n = clustered(rows.where(is_anchor & F.col("id").isNotNull()), chunk)
    if not n:
        return spark.createDataFrame([], out)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    chunks = [r["chunk"] for r in anchors.select("chunk").distinct().orderBy("chunk").collect()]  # rows / (rows a chunk)
    for c in chunks:
        some = anchors.where(F.col("chunk") == c).orderBy("row").collect()  # about ``chunk`` rows
        held = {"row": np.array([r["row"] for r in some], dtype=np.int64), "names": [r["label"] for r in some],
                "cluster": np.array([r["cluster"] for r in some]),
                "v": np.array([r["v"] for r in some], dtype=np.int64).reshape(-1, width)}
        place = {r["row"]: i for i, r in enumerate(some)}
        every = np.arange(len(some))
        most = np.iinfo(np.int64)
        found = _walk(rows, held, {"anchor": every, "number": np.zeros(len(some), np.int64), "low": np.full(len(some), most.min),
                                   "high": np.full(len(some), most.max)}, positives, True, f"{path}/positives/chunk={c}")
        near = found.orderBy("anchor", "rank").collect()  # at most ``positives`` rows an anchor of the chunk
        score = np.array([r["score"] for r in near], dtype=np.int64)
        needs = {"anchor": np.array([place[r["anchor"]] for r in near], dtype=np.int64),
                 "number": np.array([r["rank"] for r in near], dtype=np.int64),
                 "low": -(-floor_pct * score // 100), "high": score}
        some_range = needs["low"] <= needs["high"]
        _walk(rows, held, {c: x[some_range] for c, x in needs.items()}, negatives, False, f"{path}/negatives/chunk={c}")
    pos = spark.read.schema("anchor long, need long, id long, score long, rank int").parquet(
        *(f"{path}/positives/chunk={c}" for c in chunks))
    neg = spark.read.schema("anchor long, need long, id long, score long, rank int").parquet(
        *(f"{path}/negatives/chunk={c}" for c in chunks))
    pos = pos.select("anchor", F.col("rank").cast("long").alias("need"), F.col("id").alias("positive_id"),
                     F.col("score").alias("positive_score"))
    return (neg.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(pos, ["anchor", "need"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
