"""Ranked lexical search: WAND in each shard of the documents, the shards' best merged.

``postings`` reads the texts once and writes, for shards of bounded size, the lists of documents that hold a term. How
many documents there are, how long, and in how many each term stands comes from that table, so weights hold for the
whole corpus. The lists then meet the queries by term, and each shard is searched for a block of queries in one task.

``wand`` goes through a shard's documents in ascending order. Each list is known by the largest impact of its term. Lists
sorted by the document they stand at, the pivot is the first document where the sum of these bounds exceeds the
threshold, the lowest score among the best so far: all lists skip to it. From there documents are taken in
blocks: one is scored only if the bounds of the terms that it holds exceed the threshold. Lists whose bounds together
don't reach the threshold offer no documents; they are only looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, cut, longs, slices, tidy
from .hashing import U64, Words

#: Bytes of text of a shard, from which its lists are written.
SHARD = 32 << 20
#: Pairs (query, term) in a block of queries; queries of more terms are a block of their own.
BLOCK = 65_536
#: Distinct terms of all queries that are sent to the tasks, so that only their lists are written; of more, all lists are.
SENT = 1_000_000
#: Documents that are taken with one threshold, at most.
STRIDE = 1024
#: Bytes that are no part of a term: ASCII but for digits and letters.
APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_POSTINGS = "shard long, term long, docs array<int>, counts array<int>, ids array<long>, lengths array<long>"
_ROW = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def grouped(keys: tuple[np.ndarray, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns, sorted by the first, then the second, ...; and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [x[order] for x in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    at = np.flatnonzero(new)
    return [x[at] for x in keys], np.diff(np.append(at, len(order)))


class Shard:
    """Documents and their terms, until there is enough for lists."""

    def __init__(self) -> None:
        self.bytes, self.rows = 0, 0
        self.terms, self.docs, self.counts, self.lengths = [], [], [], []
        self.ids: list[pa.Array] = []

    def add(self, ids: pa.Array, words: Words, wanted: np.ndarray | None) -> None:
        n = words.last - words.first
        terms, docs = words.hashes(), np.repeat(np.arange(len(n)) + self.rows, n)
        if wanted is not None:
            near = wanted[np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)] if len(wanted) else ~terms
            terms, docs = terms[near == terms], docs[near == terms]
        (terms, docs), counts = grouped((terms, docs))
        for column, values in zip((self.terms, self.docs, self.counts, self.lengths), (terms, docs.astype(np.int32), counts.astype(np.int32), n), strict=True):
            column.append(values)
        self.ids.append(ids.cast(pa.int64()))
        self.rows += len(n)
        self.bytes += len(words.data)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row for the documents, by ascending id (null ids last, as they come), and one for each term."""
        ids = pa.chunked_array(self.ids, pa.int64()).combine_chunks()
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())))
        place = np.empty(self.rows, np.int32)
        place[order] = np.arange(self.rows, dtype=np.int32)
        lengths = np.concatenate(self.lengths)[order]
        nothing = lambda n, kind: pa.nulls(n, pa.list_(kind))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.int64()), nothing(1, pa.int32()), nothing(1, pa.int32()), whole(ids.take(pa.array(order))), whole(pa.array(lengths, pa.int64()))], schema=_ROW)
        terms, docs, counts = (np.concatenate(x) for x in (self.terms, self.docs, self.counts))
        docs = place[docs]
        order = np.lexsort((docs, terms))
        terms, docs, counts = terms[order], docs[order], counts[order]
        new = np.ones(len(terms), bool)
        new[1:] = terms[1:] != terms[:-1]
        first = np.flatnonzero(new)
        bounds = pa.array(np.append(first, len(terms)), pa.int32())
        n = len(first)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), longs(terms[first]), pa.ListArray.from_arrays(bounds, pa.array(docs)), pa.ListArray.from_arrays(bounds, pa.array(counts)), nothing(n, pa.int64()), nothing(n, pa.int64())], schema=_ROW
        )


def postings(docs: DataFrame, key: str, text: str, wanted: np.ndarray | None = None, size: int = SHARD) -> DataFrame:
    """(shard, term, docs, counts) for each term of a shard, and a row (shard, ids, lengths) for the documents that ``docs`` counts off.

    A shard has texts of ``size`` bytes, or one longer text more. With ``wanted`` (sorted), only its terms have rows; lengths count all terms.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                now.add(batch.column(0).slice(first, end - first), Words(data, offsets, APART), shared.value)
                if now.bytes >= size:
                    yield from now.batches(number)
                    number, now = number + 1, Shard()
        if now.rows:
            yield from now.batches(number)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, _POSTINGS)


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term, times): how often each item has each term. Rows that repeat an item and a text count once; other texts of an item add their terms."""
    ship(items.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, APART)
                (docs, terms), times = grouped((np.repeat(np.arange(end - first), words.last - words.first), words.hashes()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs + first)), longs(terms), longs(times)], names=["item", "term", "times"])

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text")).distinct()
    found = rows.mapInArrow(run, rows.select("item").schema.add("term", "long").add("times", "long"))
    return found.groupBy("item", "term").agg(F.sum("times").alias("times"))


def wand(lists: list[tuple[np.ndarray, np.ndarray]], k: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(scores, documents) of the ``k`` documents with the highest sums of impacts above 0, ties to the smaller one.

    ``lists``: for each term its documents, ascending, and their impacts in 64 bits.
    """
    lists = sorted(lists, key=lambda x: x[1].max())
    tops = np.array([x[1].max() for x in lists], np.int64)
    together = np.cumsum(tops)
    at = [0] * len(lists)
    end_of_all = np.iinfo(np.int64).max
    scores, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold, size = 0, 64
    while (few := int(np.searchsorted(together, threshold, side="right"))) < len(lists):
        heads = np.array([docs[i] if i < len(docs) else end_of_all for (docs, _), i in zip(lists, at, strict=True)], np.int64)
        order = np.argsort(heads, kind="stable")
        pivot = heads[order[np.searchsorted(np.cumsum(tops[order]), threshold, side="right")]]
        if pivot == end_of_all:
            break
        starts = [np.searchsorted(docs, pivot) for docs, _ in lists]
        at = [np.searchsorted(docs, pivot + size) for docs, _ in lists]
        found = np.unique(np.concatenate([lists[i][0][starts[i] : at[i]] for i in range(few, len(lists))]))
        bound, places = np.zeros(len(found), np.int64), []
        for (docs, _), top, low, high in zip(lists, tops, starts, at, strict=True):
            place = np.searchsorted(docs[low:high], found) + low
            place[place == high] = -1
            place[(place >= 0) & (docs[place] != found)] = -1
            bound[place >= 0] += top
            places.append(place)
        beat = np.flatnonzero(bound > threshold)
        if len(beat):
            score = np.zeros(len(beat), np.int64)
            for (_, impacts), place in zip(lists, places, strict=True):
                place = place[beat]
                score += np.where(place >= 0, impacts[place], 0)
            scores, best = np.append(scores, score), np.append(best, found[beat])
            keep = np.lexsort((best, -scores))[:k]
            keep = keep[scores[keep] > 0]
            scores, best = scores[keep], best[keep]
            threshold = int(scores[-1]) if len(scores) == k else 0
        size = min(2 * size, stride)
    return scores, best


def impacts(counts: np.ndarray, weight: int, room: np.ndarray) -> np.ndarray:
    """Of each posting, its share of a score: the weight times the count, damped by itself and by the document's length."""
    counts = counts.astype(np.int64)
    return weight * ((1_000_000_000 * counts) // (1000 * counts + room))


def weight(documents: int, holding: Column) -> Column:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * holding + 1))).cast("long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): each item's ``k`` documents with the highest scores above 0, all if fewer.

    Terms are stretches of bytes but ASCII other than digits and letters, A to Z in lower case. Null and empty texts
    have no terms: such items have no rows, such documents are not counted. Equal scores go by ascending
    key, null keys last; rows that repeat a key are documents of their own. Rows that repeat an item and a text count
    once; rows of one item with other texts add their terms. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    terms = scratch.written(query_terms(items, item, item_text), "terms")
    distinct = terms.select("term").distinct()
    wanted = np.sort(np.array([r[0] for r in distinct.toLocalIterator()], np.int64).view(U64)) if distinct.count() <= SENT else None
    index = scratch.written(postings(docs, key, text, wanted), "postings")
    sizes = index.where("term is null").select(F.reduce("lengths", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("all")), lambda x, n: F.struct((x["n"] + (n > 0).cast("long")).alias("n"), (x["all"] + n).alias("all"))).alias("x"))
    documents, words = (int(x or 0) for x in sizes.agg(F.sum("x.n"), F.sum("x.all")).first())
    blocks = max(1, -(-terms.count() // BLOCK))
    holding = index.where("term is not null").groupBy("term").agg(F.sum(F.size("docs")).alias("holding"))
    wants = terms.join(holding, "term").groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term").agg(weight(documents, F.first("holding")).alias("weight"), F.collect_list(F.struct("item", "times")).alias("items"))
    lists = index.where("term is not null").join(wants.where("weight > 0"), "term").select("shard", "block", "weight", "items", "docs", "counts", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")
    heads = index.where("term is null").select("shard", F.explode(numbers).alias("block"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast(lists.schema["items"].dataType).alias("items"), "docs", "counts", "ids", "lengths")
    kind = terms.schema["item"].dataType

    def run(group: pa.Table) -> pa.Table:
        head = pa.compute.is_null(group.column("weight"))
        (ids,), (lengths,) = (group.filter(head).column(c).to_pylist() for c in ("ids", "lengths"))
        room = 8 * (25 + np.array([75 * n * documents // words for n in lengths] if words else lengths, np.int64))
        of: dict = {}
        for row in group.filter(pa.compute.invert(head)).to_batches(max_chunksize=1):
            at = row.column("docs")[0].values.to_numpy()
            worth = impacts(row.column("counts")[0].values.to_numpy(), row.column("weight")[0].as_py(), room[at])
            for x in row.column("items")[0].as_py():
                of.setdefault(x["item"], []).append((at, worth * x["times"]))
        out: list[tuple] = [(x, ids[d], int(s)) for x, found in of.items() for s, d in zip(*wand(found, k), strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (group.schema.field("items").type.value_type.field("item").type, pa.int64(), pa.int64()), strict=True)], names=["item", "doc", "score"])

    found = lists.unionByName(heads).groupBy("shard", "block").applyInArrow(run, terms.select("item").schema.add("doc", "long").add("score", "long"))
    ranks = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    out = cut(found.withColumn("rank", ranks).where(F.col("rank") <= k).select(F.col("item").cast(kind).alias(item), "rank", F.col("doc").alias(key), "score"))
    scratch.clear()
    return out
