"""Largest inner products with an adaptive dimension scan over inverted lists.

Vectors are scaled by the largest norm, get one more component so that the largest inner product is the
least distance, are rotated at random, and cut into blocks of columns. The number of lists grows with the
table, and each row goes to the list of its nearest centroid; long lists are dealt out in parts. A query
meets the parts of the lists it probes. Within a part, candidates are scanned block by block: after d of D
rotated dimensions the partial squared distance, scaled by D/d, estimates the whole one, and a candidate is
abandoned once it exceeds the query's bound by the factor (1 + ``EPSILON`` / sqrt(d))^2, which is a
hypothesis test on its being among the nearest. The bound is the k-th nearest of a sample, known
before the scan. What is left is measured exactly, on the original vectors, in double precision.

Centroids are fitted in two steps: a few on a bounded sample, and below each as many as its share of the
lists, each in a task of its own on a sample that grows with the lists. How many lists are probed comes from
``ASKED`` rows compared with every row of the table: as few as hold ``WANTED`` of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import Scratch, cut, parts

#: Rows of the sample that bounds and the first centroids are fitted on; rows of a list, on average, and of one of its parts, at most.
SAMPLE, LIST, PART = 8_192, 1_000, 4_096
#: Lists, at most: beyond LISTS x LIST rows the lists grow longer. Sampled rows for each list. Columns of a block; strictness of the test.
LISTS, ROWS, COLUMNS, EPSILON = 65_536, 16, 16, 2.1
#: Rows whose true neighbours tell how many lists to probe, and the share of these that the probed lists hold.
ASKED, WANTED = 128, 0.97
SEED = 11
_PLACES = 1 << 30


def _fine(vector: str) -> Column:
    return F.expr(f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vector}, x -> x != 0)")


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a finite, non-null vector that is not zero; of rows with the same id, the least vector.

    Components stay single precision if they are, and are double otherwise.
    """
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    return vectors.where(F.col(id_column).isNotNull() & _fine(vector)).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(v).alias("v"))


def left_out(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, reason) of the rows that take no part in ``search``: no id, no vector, not finite, zero, or another length than ``common_length``."""
    width = common_length(usable(vectors, id_column, vector))
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(F.col(id_column).isNull(), "no id").when(v.isNull(), "no vector").when(odd, "not finite").when(~F.exists(v, lambda x: x != 0), "zero").when(F.size(v) != width, "length")
    return vectors.select(F.col(id_column).cast("long").alias("id"), reason.alias("reason")).where("reason is not null")


def common_length(rows: DataFrame) -> int:
    """The length that most vectors of ``rows`` (id, v) have, the longer on ties; 0 for no rows."""
    found = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found[0] if found else 0


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows, in their own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Index:
    """What is fitted: the rotation, the largest norm, centroids, the number of probed lists, the sample."""

    rotation: np.ndarray
    norm: float
    centroids: np.ndarray
    probes: int
    ids: np.ndarray
    sample: np.ndarray

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Scaled and rotated vectors with the extra component: 0 for queries, what is missing to length 1 for rows."""
        unit = x / self.norm
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(1 - (unit.astype(np.float64) ** 2).sum(axis=1), 0))
        return np.hstack([unit, extra[:, None]]).astype(np.float32) @ self.rotation

    def closeness(self, turned: np.ndarray) -> np.ndarray:
        return turned @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)

    def nearest(self, turned: np.ndarray) -> np.ndarray:
        """The list of each row."""
        step = max(1, (1 << 22) // len(self.centroids))
        return np.concatenate([self.closeness(turned[i : i + step]).argmax(axis=1) for i in range(0, len(turned), step)]).astype(np.int32) if len(turned) else np.zeros(0, np.int32)


def lloyd(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``count`` centroids of the rows of x, at most as many as there are rows."""
    centroids = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    step = max(1, (1 << 22) // len(centroids))
    for _ in range(rounds if len(centroids) > 1 else 1):
        half = 0.5 * (centroids**2).sum(axis=1)
        near = np.concatenate([(x[i : i + step] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), step)])
        order = np.argsort(near, kind="stable")
        full, first = np.unique(near[order], return_index=True)
        centroids[full] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def fit(rows: DataFrame, total: int, norm: float, sample: int = SAMPLE) -> Index:
    """An index of ``rows`` (id, v): the sample are the rows whose ids hash lowest, and the lists grow with ``total``."""
    table = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    ids, x = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1] + 1,) * 2))[0].astype(np.float32)
    index = Index(rotation, norm, np.zeros((1, x.shape[1] + 1), np.float32), 1, ids, x)
    lists = int(np.clip(round(total / LIST), 1, LISTS))
    index.centroids = lloyd(index.turned(x), int(np.ceil(lists**0.5)), rng)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.nearest(shared.value.turned(_matrix(batch.column(1)))))], names=["id", "v", "cell"])

    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(_PLACES))
    kind = rows.schema["v"].dataType.simpleString()
    taken = cut(rows.where(place < int(_PLACES * min(1.0, 2 * ROWS * lists / total))).mapInArrow(cells, f"id long, v {kind}, cell int"))
    sizes = dict(taken.groupBy("cell").count().collect())  # a row for each of the first centroids
    most = 8 * len(index.centroids)
    below = {cell: int(np.clip(round(lists * n / sum(sizes.values())), 1, most)) for cell, n in sizes.items()}
    shares = [(cell, below[cell], int(_PLACES * min(1.0, 2 * ROWS * lists / total) * min(1.0, 2 * ROWS * below[cell] / n))) for cell, n in sizes.items()]
    chosen = taken.join(F.broadcast(rows.sparkSession.createDataFrame(shares, "cell int, below int, share long")), "cell").where(place < F.col("share"))

    def refine(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        x = shared.value.turned(_matrix(group.column("v").combine_chunks()))
        found = lloyd(x, group.column("below")[0].as_py(), np.random.default_rng(SEED), 6)
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
        return pa.table({"cell": pa.array(np.full(len(found), group.column("cell")[0].as_py(), np.int32)), "centroid": pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1)))})

    made = chosen.groupBy("cell").applyInArrow(refine, "cell int, centroid array<float>").toArrow().sort_by("cell")
    if made.num_rows:
        index.centroids = _matrix(made.column("centroid").combine_chunks()).astype(np.float32)
    return index


def needed_probes(listed: DataFrame, index: Index, k: int, asked: int = ASKED, wanted: float = WANTED) -> int:
    """As few lists as hold ``wanted`` of the k true neighbours, among all rows (id, v, list), of ``asked`` sampled rows."""
    shared = listed.sparkSession.sparkContext.broadcast(index)
    asked = min(asked, len(index.ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value.ids[:asked], shared.value.sample[:asked].astype(np.float64)
        top, at = np.full((asked, 0), -np.inf), np.zeros((asked, 0), np.int32)
        for batch in parts(batches, 4096):
            scores = x @ _matrix(batch.column(1)).astype(np.float64).T
            scores[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            top, at = np.hstack([top, scores]), np.hstack([at, np.broadcast_to(batch.column(2).to_numpy(), scores.shape)])
            if top.shape[1] > k:
                keep = np.argpartition(-top, k - 1, axis=1)[:, :k]
                top, at = np.take_along_axis(top, keep, axis=1), np.take_along_axis(at, keep, axis=1)
        q, j = np.nonzero(top > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(at[q, j]), pa.array(top[q, j])], names=["q", "list", "score"])

    found = listed.mapInArrow(best, "q int, list int, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    pairs = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("q", "list").collect()  # asked x k rows
    if not pairs:
        return 1
    place = np.argsort(np.argsort(-index.closeness(index.turned(index.sample[:asked], True)), axis=1), axis=1)
    needed = np.sort([place[q, at] for q, at in pairs])
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))))]) + 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(first of its group, rows) for runs of rows with the same list and part."""
    last = None
    for batch in batches:
        if batch.num_rows:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                now = (a[lo], b[lo])
                yield now != last, batch.slice(lo, hi - lo)
                last = now


FOUND = "query_id long, vec_id long, score double"


def scan(rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_turned: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of each query that the block-wise tests leave, k of a query at most: (query row, row, score)."""
    width = turned.shape[1]
    square = 1 + (query_turned.astype(np.float64) ** 2).sum(axis=1)
    limit = (square - 2 * bounds).astype(np.float32)  # infinite where a query has no bound
    d = min(COLUMNS, width)

    def passes(partial: np.ndarray, upto: int, limits: np.ndarray) -> np.ndarray:
        return partial * (width / upto) <= (1 + EPSILON / np.sqrt(upto)) ** 2 * limits if upto < width else partial <= limits * (1 + 1e-5) + 1e-5

    x, q = turned[:, :d], query_turned[:, :d]
    partial = (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * q @ x.T
    at_q, at_x = np.nonzero(passes(partial, d, limit[:, None]))
    partial = partial[at_q, at_x]
    while d < width and len(at_q):
        upto = min(d + COLUMNS, width)
        out = np.empty(len(at_q), np.float32)
        for lo in range(0, len(at_q), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            out[part] = ((turned[at_x[part], d:upto] - query_turned[at_q[part], d:upto]) ** 2).sum(axis=1)
        partial = partial + out
        keep = passes(partial, upto, limit[at_q])
        at_q, at_x, partial, d = at_q[keep], at_x[keep], partial[keep], upto
    other = ids[at_x] != query_ids[at_q]
    at_q, at_x = at_q[other], at_x[other]
    score = np.empty(len(at_q))
    for lo in range(0, len(at_q), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        score[part] = (rows[at_x[part]].astype(np.float64) * queries[at_q[part]].astype(np.float64)).sum(axis=1)
    order = np.lexsort((ids[at_x], -score, at_q))
    at_q, at_x, score = at_q[order], at_x[order], score[order]
    rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, side="left")
    return at_q[rank < k], at_x[rank < k], score[rank < k]


def search(vectors: DataFrame, is_query: F.Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product found for each row where ``is_query``.

    ``is_query`` is a condition on ``id``. A query is no candidate of its own; all other usable rows
    are. Ties go to the smaller id. ``left_out`` names the rows that take no part: those that are not
    ``usable``, and vectors of another length than most. Of equal vectors only the k+1 smallest ids can be among
    any nearest k, so only these are indexed. An empty table gives an empty result. Only the two columns are read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = scratch.written(usable(vectors, id_column, vector), "vectors")
    rows = rows.where(F.size("v") == common_length(rows))
    if rows.isEmpty():
        scratch.clear()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = rows.schema["v"].dataType.simpleString()
    same = Window.partitionBy("v").orderBy("id")
    kept = scratch.written(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"), "distinct")
    total, norm = kept.agg(F.count("*"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x as double) * cast(x as double)))"))).first()
    index = fit(kept, total, float(norm) * (1 + 1e-6))
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 4096):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fitted.value.nearest(fitted.value.turned(_matrix(batch.column(1)))))], names=["id", "v", "list"])

    listed = scratch.written(kept.mapInArrow(assign, f"id long, v {kind}, list int"), "listed")
    index.probes = needed_probes(listed, index, k)
    shared = spark.sparkContext.broadcast(index)
    sizes = cut(listed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))  # one row for each list

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in parts(batches, 256):
            x, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            near = -index.closeness(index.turned(x, True))
            lists = np.argpartition(near, index.probes - 1, axis=1)[:, : index.probes] if index.probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
            scores = x @ index.sample.T
            scores[ids[:, None] == index.ids[None, :]] = -np.inf
            bound = np.full(len(x), -np.inf)
            near = np.zeros((len(x), 0), np.int64)
            if len(index.ids) > k:
                near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                bound = np.take_along_axis(scores, near, axis=1).min(axis=1).astype(np.float64) / index.norm**2 - 1e-4
            exact = (index.sample[near].astype(np.float64) * x[:, None, :].astype(np.float64)).sum(axis=2)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1])
            known = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(index.ids[near].reshape(-1), pa.int64()), pa.array(exact.reshape(-1))], names=["vec_id", "score"]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * lists.shape[1]), pa.array(lists.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound), lists, known], names=["id", "v", "bound", "lists", "known"])

    probed = scratch.written(rows.where(is_query).mapInArrow(probe, f"id long, v {kind}, bound double, lists array<int>, known array<struct<vec_id: long, score: double>>"), "probed")
    asked = probed.select("id", "v", "bound", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")  # LISTS rows at most
    asked = asked.select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(1).alias("side"), "id", "v", "bound")
    stored = listed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "v", F.lit(0.0).alias("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids, rows_ = [], []
        ready: tuple | None = None
        for new, batch in _runs(batches):
            if new:
                ids, rows_, ready = [], [], None
            side = batch.column(2).to_numpy()
            split = int(np.searchsorted(side, 1))
            if split:
                ids.append(batch.column(3).slice(0, split).to_numpy())
                rows_.append(_matrix(batch.column(4).slice(0, split)))
            if split == batch.num_rows or not rows_:
                continue
            if ready is None:
                x = np.concatenate(rows_)
                ready = x, index.turned(x), np.concatenate(ids)
            for lo in range(split, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                q, query_ids = _matrix(part.column(4)), part.column(3).to_numpy()
                at_q, at_x, score = scan(ready[0], ready[1], ready[2], q, index.turned(q, True), query_ids, part.column(5).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at_q]), pa.array(ready[2][at_x]), pa.array(score)], names=["query_id", "vec_id", "score"])

    both = stored.union(asked).repartition("list", "part").sortWithinPartitions("list", "part", "side")
    # The sample's nearest are rows too: with them no query is left with fewer than k.
    found = both.mapInArrow(run, FOUND).union(probed.select("id", F.explode("known").alias("x")).select("id", "x.vec_id", "x.score"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    scratch.clear()
    return out
