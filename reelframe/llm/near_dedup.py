"""MinHash near-duplicates, with odd sketches to verify banded candidates.

One Arrow pass hashes the word shingles of whole texts and returns, for each document, the size of
its shingle set, a 128-bit digest of the set, ``BANDS`` keys of ``ROWS`` MinHash values each, and an
odd sketch: the MinHash samples folded into a parity bitmap. Then, in Spark:

1. documents with the same set collapse into one representative, the smallest id;
2. each representative is a candidate with the smallest member of all its buckets (band keys), one
   pair each; the population count of the XOR of two odd sketches estimates how many samples differ
   and drops low pairs; the others are confirmed on full shingle sets, and links give components;
3. buckets that still hold several components are dealt out in blocks of ``BLOCK`` members. Within two
   blocks, sketches of different components are compared; members that pass are fetched with their
   texts and confirmed on full sets, and what leaves the task is a spanning forest of what the links join.
   No pair list is ever made. A block holds ``BLOCK`` members and about ``MASS`` shingles at most.

What the method may lose: two sets with similarity 0.75 share no band with probability (1 - 0.75^6)^64 =
4e-6, and their sketches differ by more than the five deviations allowed with less than 1e-6; both fall
fast with higher similarity. Every other link between different texts is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import BROADCAST_ROWS, Scratch, cut, long_lists, longs, slices, tidy
from .components import components
from .hashing import U64, Words, mix, runs

#: Words of a shingle; similarity in hundredths from which documents are linked.
SHINGLE, SIMILAR = 5, 75
BANDS, ROWS = 64, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 512
#: Members of a bucket that are compared with as many others in one task, and their shingles, more or less.
BLOCK, MASS = 1024, 1 << 21

_rng = np.random.default_rng(97)
_A = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_FOLD = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | U64(1)


def widest(similar: float) -> int:
    """Of two sets at least so similar, the most bits in which their odd sketches differ: the mean and five deviations.

    With J the similarity, each of the samples differs with probability 1-J and then toggles two
    bits. n/2 (1 - (1-2/n)^d) bits are set after d toggles, with a variance below a quarter of n
    from the folding and that of d carried through the slope.
    """
    n, differ = BITS, SAMPLES * (1 - similar)
    left = (1 - 2 / n) ** (2 * differ)
    mean = n / 2 * (1 - left)
    folding = n / 4 * (1 - left**2)
    sampling = (2 * left) ** 2 * SAMPLES * similar * (1 - similar)
    return int(mean + 5 * (folding + sampling) ** 0.5) + 1


def shingle_set(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets)
    hashes = words.hashes()
    for first, last in zip(words.first.tolist(), words.last.tolist(), strict=True):
        yield np.unique(runs(hashes, first, last, SHINGLE))


def minima(shingles: np.ndarray, block: int = 128) -> np.ndarray:
    """MinHash samples: of each of the permutations, the least value over the set."""
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (shingles >> U64(32)).astype(np.uint32)
    room = np.empty((min(block, len(short)), SAMPLES), np.uint32)
    for i in range(0, len(short), block):
        x = short[i : i + block]
        part = room[: len(x)]
        np.multiply(x[:, None], _A, out=part)
        np.add(part, _B, out=part)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of samples; the band's number is part of the key."""
    grouped = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((mix(grouped + _BAND) * _BAND).sum(axis=2, dtype=np.uint64))


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS / 64 words a row: the parity of how many samples fall on each bit."""
    n = len(samples)
    at = (mix(samples.astype(np.uint64) + _FOLD) >> U64(40)).astype(np.int64) % BITS + BITS * np.arange(n)[:, None]
    parity = (np.bincount(at.reshape(-1), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64).reshape(n, BITS // 64)


SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1)):
            n = np.zeros(end - first, np.int64)
            sums = np.zeros((end - first, 2), np.uint64)
            samples = np.zeros((end - first, SAMPLES), np.uint32)
            for i, found in enumerate(shingle_set(data, offsets)):
                if n_found := len(found):
                    n[i] = n_found
                    sums[i] = mix(found).sum(dtype=np.uint64), mix(found ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    samples[i] = minima(found)
            full = pa.array(n == 0)
            null = lambda column: pc.if_else(full, None, column)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first).cast(pa.int64()), pa.array(n), null(longs(sums[:, 0].copy())), null(longs(sums[:, 1].copy())), null(long_lists(band_keys(samples))), null(long_lists(odd_sketches(samples)))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, text): the set's size and digest, band keys and odd sketch; null ones without words."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign, SIGNED)


@tidy
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for first, end, data, offsets in slices(batch.column(2)):
            left = list(shingle_set(data, offsets))
            other = batch.column(3).slice(first, end - first)
            i = 0
            for _, _, more, cuts in slices(other):
                for right in shingle_set(more, cuts):
                    both = len(np.intersect1d(left[i], right, assume_unique=True))
                    keep[first + i] = 100 * both >= SIMILAR * (len(left[i]) + len(right) - both) > 0
                    i += 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _texts(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of the documents in ``ids`` (id), written to the shared folder.

    The ids are broadcast if there are ``BROADCAST_ROWS`` at most, and joined by a shuffle otherwise.
    """
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return scratch.written(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi"), "texts")


def confirmed(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough; only their texts are shuffled."""
    texts = _texts(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), scratch)
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the same first three columns; a run may go on over several batches."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if waiting and (k or now != last):
                yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
        last = tuple(c[-1] for c in columns)
    if waiting:
        yield pa.concat_batches(waiting) if len(waiting) > 1 else waiting[0]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, width)


def _sides(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block; the same rows where a block meets itself."""
    one, two, own = (group.column(i)[0].as_py() if i < 3 else group.column(i).to_numpy() for i in (1, 2, 3))
    return np.flatnonzero(own == one), np.flatnonzero(own == two)


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, the rows with a partner of another component whose sketch is near enough.

    Two rows share several buckets as a rule; only the one of the first band that they share counts.
    """
    most = widest(SIMILAR / 100)
    kept: list[pa.RecordBatch] = []
    for group in _groups(batches):
        left, right = _sides(group)
        component, sketches, bands = group.column(5).to_numpy(), _matrix(group.column(6), BITS // 64), _matrix(group.column(7), BANDS)
        if not len(left) or not len(right):
            continue
        key = np.uint64(group.column(0)[0].as_py() % 2**64)
        band = int((bands[0] == key).argmax())
        need = np.zeros(group.num_rows, dtype=bool)
        for i in range(0, len(left), 64):
            rows = left[i : i + 64]
            differ = np.bitwise_count(sketches[rows, None, :] ^ sketches[None, right, :]).sum(axis=2, dtype=np.int32)
            x, y = np.nonzero((differ <= most) & (component[rows, None] != component[None, right]))
            for j in range(0, len(x), 4096):
                p, q = rows[x[j : j + 4096]], right[y[j : j + 4096]]
                first = (bands[p] == bands[q]).argmax(axis=1) == band
                need[p[first]] = need[q[first]] = True
        if need.any():
            kept.append(group.filter(pa.array(need)).select(list(range(6))))
        if len(kept) >= 256:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


@tidy
def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group, pairs of members (a, b) that join all components which links on full shingle sets join."""
    for group in _groups(batches):
        left, right = _sides(group)
        sets = [x for _, _, data, offsets in slices(group.column(6)) for x in shingle_set(data, offsets)]
        sizes = np.array([len(x) for x in sets])
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        often = times > 1  # shingles of one row alone add to no intersection
        number = np.cumsum(often) - 1
        use = often[place]
        of, place = of[use], number[place[use]]
        both = np.zeros((len(left), len(right)), np.float32)
        at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        for lo in range(0, int(often.sum()), 4096):
            part = (place >= lo) & (place < lo + 4096)
            x, y = (np.zeros((len(side), 4096), np.float32) for side in (left, right))
            for m, at in ((x, at_left), (y, at_right)):
                here = part & (at[of] >= 0)
                m[at[of[here]], place[here] - lo] = 1
            both += x @ y.T
        component, rep = group.column(5).to_numpy(), group.column(4).to_numpy()
        x, y = np.nonzero((100 * both >= SIMILAR * (sizes[left][:, None] + sizes[right][None, :] - both)) & (component[left][:, None] != component[right][None, :]))
        if len(x):
            ends = np.concatenate([left[x], right[y]])
            _, row, node = np.unique(component[ends], return_index=True, return_inverse=True)
            root = least_reachable(len(row), *np.split(node, 2))
            moved = np.flatnonzero(root != np.arange(len(row)))
            p, q = rep[ends[row[moved]]], rep[ends[row[root[moved]]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n nodes that each reaches over the edges a[i], b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _differ(left: str, right: str) -> F.Column:
    """The number of bits in which two sketches differ."""
    return F.expr(" + ".join(f"bit_count({left}[{i}] ^ {right}[{i}])" for i in range(BITS // 64)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; more columns do no harm).

    Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    Rows with the same doc_id are one document with several texts: they share a component. A null
    doc_id takes part in no link, has a null component and is kept. Ties: the smallest id stands for a group.
    An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.written(signatures(docs), "signed")
    sets = cut(signed.where("set_a is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    leaders = signed.join(sets.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b"], "left_semi").select(F.col("doc_id").alias("rep"), F.ceil(F.log2(F.col("n_shingles") + 1)).cast("byte").alias("weight"), "bands", "sketch")
    leaders = scratch.written(leaders, "leaders")
    banded = leaders.select("rep", "weight", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    shared = scratch.written(banded.join(buckets, "key").select("key", "rep", "weight", "least"), "shared")

    # One candidate for each representative: the smallest member of all its buckets.
    star = shared.groupBy(F.col("rep").alias("b")).agg(F.min("least").alias("a")).where("a < b").select("a", "b")
    a, b = (leaders.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    star = cut(star.join(a, "a").join(b, "b").where(_differ("sketch_a", "sketch_b") <= widest(SIMILAR / 100)).select("a", "b"))
    links = cut(confirmed(docs, star, scratch))
    joined = components(links)

    # Buckets that still hold several components, block against block.
    placed = shared.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "weight", F.coalesce("component", "rep").alias("component"))
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum(F.pow(F.lit(2.0), "weight")).alias("mass")).where("low < high")
    keys = keys.select("key", F.least("members", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("mass") / MASS))).cast("int").alias("blocks"))
    dealt = placed.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "rep", "component", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "rep", "component")
    apart = dealt.join(leaders, "rep").select("key", "one", "two", "own", "rep", "component", "sketch", "bands")
    apart = apart.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_near, "key long, one int, two int, own int, rep long, component long")
    apart = scratch.written(apart, "apart")
    if not apart.isEmpty():
        ids = cut(apart.select(F.col("rep").alias("id")).distinct())
        texts = _texts(docs, ids, scratch).withColumnRenamed("id", "rep")
        groups = apart.join(texts, "rep").select("key", "one", "two", "own", "rep", "component", "text")
        more = groups.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two").mapInArrow(_link, "a long, b long")
        more = cut(more.distinct())
        if not more.isEmpty():
            joined = components(links.union(more))

    moved = sets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(moved, ["set_a", "set_b"], "left")
    found = cut(found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept")))
    scratch.clear()
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: the document with the smallest id of each component stays.

    Of rows with the same doc_id one stays: that whose text has the least hash, whatever the partitions;
    rows whose doc_id is null all stay. Such rows are folded before the shuffle, so that no id is a task.
    """
    gone = cut(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    out = named.unionByName(docs.where("doc_id is null"))
    if again.isEmpty():
        return out.select(docs.columns)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rest = F.to_json(F.struct(*docs.columns))
    one = named.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text", rest)).alias("row")).select("row.*")
    return out.join(again, "doc_id", "left_anti").unionByName(one).select(docs.columns)
