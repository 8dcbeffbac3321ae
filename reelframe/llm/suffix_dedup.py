"""Suffix-array dedup: every byte covered by a long string that starts anywhere else goes.

Sorting all suffixes of a corpus would send each of its bytes many times. Instead, each start has an anchor: of the short
grams in the string of ``length`` bytes that begins there, the one with the smallest hash (the first of equals). Equal strings
have equal anchors, and neighbouring starts mostly share one, so the corpus has a few anchors for each ``length`` bytes. Anchors that occur once are
dropped by a count. Of the others, the texts around them (a context: all starts of that anchor and what their strings
cover) meet by anchor in blocks of bounded size, whose suffixes are sorted by ``suffix_sort.order``. Suffixes
that agree over ``length`` bytes are repeats.

An anchor with more contexts than a block holds is dealt over several blocks. There the strings that a block could
not decide alone are compared by digest, one row for each different string of a block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .common import BROADCAST_ROWS, Scratch, cut, longs, slices, tidy
from .hashing import _BASE, _INVERSE, _TABLE, U64, mix, powers
from .suffix_sort import order

#: Bytes of a string that counts as a repeat.
LENGTH = 200
#: Contexts of an anchor in one block, about.
GROUP = 1024
#: Bits of the map of repeated anchors, which goes to all tasks (16 MB); more than an eighth as many anchors are joined instead.
BITS = 1 << 27
_PAGE = 32_768
#: Stretches of starts, of all texts, that are sent to all tasks at most (some 40 MB); to more of them the texts are shuffled.
SPANS = 1_000_000
#: Bytes of contexts that are sorted at once, where anchors allow it.
SORTED = 2 << 20
#: A text is taken in pieces of so many starts: a place in it fits the low bits of a packed hash.
PIECE = 1 << 21
_LOW = U64((1 << 22) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, texts, lows, highs): the starts low to high of a text, counted in ``data``, have the anchor with that hash."""
    gram = max(1, length // 5)
    window = length - gram + 1
    for first in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[first : first + PIECE + length - 1]
        n = len(piece) - length + 1
        if n <= 0:
            return
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * powers(_BASE, len(piece))[:-1], out=sums[1:])
        grams = mix((sums[gram:] - sums[:-gram]) * powers(_INVERSE, len(piece))[: len(piece) - gram + 1])
        packed = np.full(-(-len(grams) // window) * window, ~U64(0))
        packed[: len(grams)] = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        rows = packed.reshape(-1, window)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]  # from a start to the end of its row
        behind = np.minimum.accumulate(rows, axis=1).reshape(-1)[window - 1 : window - 1 + n]  # from the row's begin to the last gram
        best = (np.minimum(ahead, behind) & _LOW).astype(np.int64)
        some = slice(np.searchsorted(offsets, first, side="right") - 1, np.searchsorted(offsets, first + n, side="left"))  # texts with starts here
        sizes = np.minimum(offsets[1:][some], first + n) - np.maximum(offsets[:-1][some], first)
        text = np.repeat(np.arange(some.start, some.stop), sizes)
        starts = np.flatnonzero(np.arange(first + length, first + length + n) <= np.repeat(offsets[1:][some], sizes))
        if not len(starts):
            continue
        new = np.ones(len(starts), bool)
        new[1:] = (best[starts[1:]] != best[starts[:-1]]) | (text[starts[1:]] != text[starts[:-1]])
        at = np.flatnonzero(new)
        low, high = starts[at], starts[np.append(at[1:], len(starts)) - 1]
        yield grams[best[low]], text[low], low + first, high + first


def repeated_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(key, n) of anchors with two occurrences or more in ``rows`` (whose last column is the text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                for keys, *_ in anchors(data, offsets, length):
                    keys, n = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([longs(keys), longs(n)], names=["key", "n"])

    return rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """A map of fixed size with the bit ``key mod bits`` set for each key; made in Spark."""
    at = F.pmod("key", F.lit(bits))
    pages = keys.select(F.floor(at / _PAGE).alias("page"), (at % _PAGE).alias("spot")).groupBy("page").agg(F.bitmap_construct_agg("spot").alias("map")).collect()
    out = np.zeros((bits // _PAGE, _PAGE // 8), np.uint8)
    for page, found in pages:
        out[page] = np.frombuffer(found, np.uint8)
    return out.reshape(-1)


_CONTEXT = "key long, id {id}, hash long, low long, context binary"


def contexts(rows: DataFrame, length: int, repeated: DataFrame, bits: int = BITS) -> DataFrame:
    """(key, id, hash, low, context) of the anchors of ``rows`` (id, hash, text) that may be repeated: by a map of bits, or by a join if they are too many for it."""
    spark = rows.sparkSession
    shape = StructType.fromDDL(_CONTEXT.format(id="long"))
    shape["id"].dataType = rows.schema["id"].dataType
    shared = None
    if repeated.count() <= bits // 8:
        shared = spark.sparkContext.broadcast(bit_map(repeated, bits))
    else:

        @tidy
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, _, data, offsets in slices(batch.column(2)):
                    for keys, text, *_ in anchors(data, offsets, length):
                        of = pa.array(text + first)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), longs(keys)], names=["id", "hash", "key"])

        every = rows.mapInArrow(listed, rows.select("id", "hash").schema.add("key", "long"))
        mine = every.join(repeated.select("key"), "key", "left_semi").groupBy(F.col("id").alias("id_"), F.col("hash").alias("hash_")).agg(F.collect_set("key").alias("keys"))
        rows = rows.join(mine, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))).select("id", "hash", "text", "keys")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                raw = data.tobytes()
                known = None if shared else np.unique(batch.column(3).slice(first, end - first).flatten().to_numpy())
                for keys, text, low, high in anchors(data, offsets, length):
                    if shared:
                        bit = keys & U64(bits - 1)
                        keep = shared.value[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1 > 0
                    else:
                        keep = np.isin(keys.view(np.int64), known)
                    keys, text, low, high = keys[keep], text[keep], low[keep], high[keep]
                    for at in range(0, len(keys), 4096):
                        now = slice(at, at + 4096)
                        of = pa.array(text[now] + first)
                        cuts = [raw[a : b + length] for a, b in zip(low[now].tolist(), high[now].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([longs(keys[now]), batch.column(0).take(of), batch.column(1).take(of), longs(low[now] - offsets[text[now]]), pa.array(cuts, pa.binary())], names=shape.names)

    return rows.mapInArrow(run, shape)


def decided(found: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Of whole blocks of contexts: the stretches of starts (low to high) that are repeats, and a row for each string that other blocks may repeat (with its text if it stands here once)."""
    blocks = list(zip(found.column("key").to_pylist(), found.column("part").to_pylist(), strict=True))
    texts, lows, parts = found.column("context").to_pylist(), found.column("low").to_numpy(), found.column("parts").to_numpy()
    first_of: dict = {}
    model = np.array([first_of.setdefault((b, t), i) for i, (b, t) in enumerate(zip(blocks, texts, strict=True))])
    copies = np.bincount(model, minlength=len(model))
    kinds: dict = {}
    for b, _ in first_of:
        kinds[b] = kinds.get(b, 0) + 1
    # suffixes of the different contexts of a block, unless it has one only and no other block has its anchor
    sort = np.array([i for (b, _), i in first_of.items() if kinds[b] > 1 or parts[i] > 1], np.int64)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts_of = sizes - length + 1
    n = starts_of[sort]
    data = np.frombuffer(b"".join(texts[i] for i in sort), np.uint8)
    begin = np.cumsum(sizes[sort]) - sizes[sort]
    owner = np.repeat(sort, n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place, same = order(data, within + np.repeat(begin, n), length) if len(sort) else (np.zeros(0, np.int64), np.zeros(0, bool))
    head = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    times = np.add.reduceat(copies[owner[place]], head) if len(head) else np.zeros(0, np.int64)
    twice = np.zeros(len(owner), bool)
    twice[place] = times[group] > 1
    # stretches of repeated starts of each context that was sorted; its copies have the same ones
    flat = np.flatnonzero(twice)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1] + 1) | (owner[flat[1:]] != owner[flat[:-1]])
    at = np.flatnonzero(new)
    a, b = flat[at], flat[np.append(at[1:], len(flat)) - 1] if len(at) else flat
    spans: dict[int, list] = {}
    for o, x, y in zip(owner[a].tolist(), within[a].tolist(), within[b].tolist(), strict=True):
        spans.setdefault(o, []).append((x, y))
    sorted_ = np.zeros(len(texts), bool)
    sorted_[sort] = True
    rows, low, high = [], [], []
    for i, m in enumerate(model.tolist()):
        mine = spans.get(m, ()) if sorted_[m] else ((0, int(starts_of[m]) - 1),) if copies[m] > 1 else ()
        for x, y in mine:
            rows.append(i)
            low.append(int(lows[i]) + x)
            high.append(int(lows[i]) + y)
    names = ["id", "hash", "low", "high", "digest", "n"]
    for c in range(0, len(rows), 65_536):
        of = pa.array(rows[c : c + 65_536], pa.int64())
        k = len(of)
        yield pa.RecordBatch.from_arrays([_taken(found, "id", of), _taken(found, "hash", of), pa.array(low[c : c + k], pa.int64()), pa.array(high[c : c + k], pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names=names)
    lead = place[head]
    wide = np.flatnonzero(parts[owner[lead]] > 1)
    for c in range(0, len(wide), 65_536):
        now = wide[c : c + 65_536]
        one, who = lead[now], owner[lead[now]]
        where = (within[one] + np.repeat(begin, n)[one]).tolist()
        digests = [hashlib.blake2b(data[x : x + length].tobytes(), digest_size=16).digest() for x in where]
        start = longs(lows[who] + within[one])
        of = pa.array(who)
        yield pa.RecordBatch.from_arrays([_taken(found, "id", of), _taken(found, "hash", of), start, start, pa.array(digests, pa.binary()), longs(times[now])], names=names)


def _taken(found: pa.Table, column: str, of: pa.Array) -> pa.Array:
    out = found.column(column).take(of)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def sorted_blocks(found: DataFrame, repeated: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """``decided`` over all contexts, dealt by anchor and, of anchors with more than ``group`` contexts, over several parts."""
    hot = repeated.where(F.col("n") > group).select("key", F.ceil(F.col("n") / group).cast("int").alias("parts"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    parts = F.coalesce("parts", F.lit(1))
    rows = found.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("id", "hash", "low"), parts).cast("int")).withColumn("parts", parts)
    shape = found.select("id", "hash").schema.add("low", "long").add("high", "long").add("digest", "binary").add("n", "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                held.append(batch)
                size += batch.column("context").get_total_buffer_size() * batch.num_rows // max(1, whole.num_rows)
                if size < SORTED:
                    continue
                table = pa.Table.from_batches(held)
                key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
                if len(cuts):  # the last block may go on
                    yield from decided(table.slice(0, int(cuts[-1])), length)
                    held = table.slice(int(cuts[-1])).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from decided(pa.Table.from_batches(held), length)

    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, shape)


def repeats(rows: DataFrame, length: int, scratch: Scratch, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """(id, hash, low, high): stretches of starts in ``rows`` (id, hash, text) whose string of ``length`` bytes starts anywhere else too."""
    repeated = scratch.written(repeated_anchors(rows, length), "anchors")
    found = scratch.written(sorted_blocks(contexts(rows, length, repeated, bits), repeated, length, group), "repeats")
    open_ = found.where("digest is not null")
    elsewhere = open_.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    late = open_.where("n = 1").join(elsewhere, "digest", "left_semi")
    return found.where("digest is null").select("id", "hash", "low", "high").union(late.select("id", "hash", "low", "high"))


def merged(found: DataFrame) -> DataFrame:
    """(id, hash, spans): of each text, its stretches of starts, those that touch or overlap as one. One shuffle, by text."""
    w = Window.partitionBy("id", "hash").orderBy("low", "high")
    fresh = F.col("low") > F.coalesce(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))
    islands = found.withColumn("fresh", fresh).withColumn("island", F.sum(F.col("fresh").cast("int")).over(w))
    spans = islands.groupBy("id", "hash", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.groupBy("id", "hash").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with removed (start, end of the maximal runs of removed bytes), bytes (of the text in UTF-8) and kept (the bytes that stay), in place of columns of such names.

    A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else, in this or another text, overlapping or not. Null
    texts are empty. Strings never cross texts. Rows may repeat keys and texts: each is a text of its own, so rows
    that repeat a text of ``length`` bytes or more lose all of it. An empty table gives an empty result.
    """
    if length < 2:
        raise ValueError("a repeat has two bytes at least")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("removed", "bytes", "kept")]
    name = uuid.uuid4().hex
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    starts = cut(merged(repeats(rows, length, scratch)).select(F.col("id").alias(f"i{name}"), F.col("hash").alias(f"h{name}"), F.col("spans").alias(f"s{name}")))
    scratch.clear()
    on = F.col(key).eqNullSafe(F.col(f"i{name}")) & (F.xxhash64(text) == F.col(f"h{name}"))
    small = (starts.agg(F.sum(F.size(f"s{name}"))).first()[0] or 0) <= SPANS
    joined = docs.select(rest).join(F.broadcast(starts) if small else starts, on, "left").select(*rest, f"s{name}")
    column = rest.index(text)
    shape = docs.select(rest).schema
    for c in StructType.fromDDL("removed array<struct<start: bigint, end: bigint>>, bytes bigint, kept binary"):
        shape = shape.add(c)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(column)):
                raw = data.tobytes()
                removed, kept = [], []
                for i, found in enumerate(batch.column(len(rest)).slice(first, end - first).to_pylist()):
                    whole, runs = raw[offsets[i] : offsets[i + 1]], []
                    for low, high in sorted((x["low"], x["high"] + length) for x in found or ()):
                        if runs and low <= runs[-1]["end"]:
                            runs[-1]["end"] = max(runs[-1]["end"], high)
                        else:
                            runs.append({"start": low, "end": high})
                    edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(whole)]
                    removed.append(runs)
                    kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, end - first).columns[:-1], pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), longs(np.diff(offsets)), pa.array(kept, pa.binary())],
                    names=shape.names,
                )

    return joined.mapInArrow(run, shape)
