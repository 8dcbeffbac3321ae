"""Benchmark decontamination with DataFrame functions only: a broadcast set of test n-grams.

Items are cut into windows of ``WINDOW`` words (an item of fewer words is one window). Over the word
windows of each document, bitmaps of the first two words and of whole windows (literals of a bounded size) pass few
others; what passes is joined with the windows on the words themselves, which verifies the hit. Up to
``WINDOWS_MOST`` windows are broadcast; of more, those that any document may have are looked for first, once each, and
broadcast if they are few enough. The result is the same.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a window.
WINDOW = 10
#: So many windows are broadcast at most, about 100 bytes each; bits of a bitmap, at most and for each window.
WINDOWS_MOST, BITS_MOST, BITS = 1 << 18, 1 << 25, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, after A-Z are lower-cased; and a word with what stands before it, in the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WITH_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame) -> DataFrame:
    """(gram, size, hash, lead, items): each distinct window, its words joined by spaces, hashes of all of them and of the first two, and the items that have it."""
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    split = split.select("item_id", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("size"))
    each = split.select("item_id", "size", "w", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("at"))
    each = each.select("item_id", "size", F.expr("slice(w, at, size)").alias("part"))
    each = each.select("item_id", "size", F.array_join("part", " ").alias("gram"), F.expr("xxhash64(transform(part, x -> xxhash64(x)))").alias("hash"), F.expr("xxhash64(xxhash64(part[0]), xxhash64(try_element_at(part, 2)))").alias("lead"))
    return each.groupBy("gram", "size").agg(F.first("hash").alias("hash"), F.first("lead").alias("lead"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _width(n: int) -> int:
    """Bits of the bitmap of n windows."""
    return min(BITS_MOST, 1 << max(10, (BITS * max(1, n) - 1).bit_length()))


def bitmaps(known: DataFrame, counts: dict[int, int]) -> dict[tuple[int, str], np.ndarray]:
    """For each size and each of ``hash`` and ``lead``: the longs of a bitmap of the windows' hashes.

    They are joined in Spark, so that the driver gets a row for each long with a bit, never one for each window.
    """
    masks = F.create_map(*(F.lit(x) for size, n in counts.items() for x in (size, _width(n) - 1)))
    bit = known.select("size", F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).bitwiseAND(masks[F.col("size")]).alias("bit")) for c in ("hash", "lead")))).alias("x")).select("size", "x.*")
    words = bit.groupBy("size", "of", F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word")).toArrow()
    out = {(size, of): np.zeros(_width(n) // 64, np.int64) for size, n in counts.items() for of in ("hash", "lead")}
    size, of, at, word = (words.column(c).to_numpy() for c in ("size", "of", "at", "word"))
    for (k, name), bitmap in out.items():
        here = (size == k) & (of == name)
        bitmap[at[here]] = word[here]
    return out


def _passes(bitmap: np.ndarray, value: str) -> str:
    """SQL for whether the hash ``value`` may be in ``bitmap``, which becomes a literal."""
    literal = f"from_json('{json.dumps(bitmap.tolist())}', 'array<bigint>')"
    return f"exists(array({value}), h -> (shiftright({literal}[cast(h & {64 * len(bitmap) - 1} as int) div 64], cast(h & 63 as int)) & 1L) = 1L)"


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, n_words, spans, items) for each distinct (doc_id, text) of ``docs``.

    spans: sorted array of (first, end) word positions of occurring windows, from 0; items: sorted
    ids, as strings, of the items with one. ``mark`` is a hash of the text. Null and empty texts
    have no words and no spans. Only ``doc_id`` and ``text`` are read.
    """
    known = cut(windows(benchmark))
    counts = {r[0]: r[1] for r in known.groupBy("size").count().collect()}  # at most WINDOW rows
    n, maps = sum(counts.values()), bitmaps(known, counts) if counts else {}
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    base = base.select("doc_id", "mark", F.size("w").cast("long").alias("n_words"), "w", F.expr("transform(w, x -> xxhash64(x))").alias("wh"))
    passed = {}
    for size in sorted(counts):
        places = f"if(size(wh) >= {size}, sequence(1, size(wh) - {size} + 1), array())"
        if size > 2:  # two words tell most places off, at a fifth of the cost
            places = f"filter({places}, i -> {_passes(maps[size, 'lead'], 'xxhash64(wh[i - 1], wh[i])')})"
        places = f"filter({places}, i -> {_passes(maps[size, 'hash'], f'xxhash64(slice(wh, i, {size}))')})"
        passed[size] = f"transform({places}, i -> struct(i as at, {size} as size, array_join(slice(w, i, {size}), ' ') as gram))"
    found = f"concat({', '.join(passed.values())})" if passed else "cast(array() as array<struct<at:int,size:int,gram:string>>)"
    rows = base.select("doc_id", "mark", "n_words", F.explode_outer(F.expr(found)).alias("x")).select("doc_id", "mark", "n_words", "x.*")
    known = known.select("gram", "size", "items")
    if n > WINDOWS_MOST:
        rows = cut(rows)
        known = cut(known.join(rows.select("gram", "size").distinct(), ["gram", "size"], "left_semi"))
        n = known.count()
    # Beyond the bound the join is shuffled; a common window is then a skewed key of its left side, which Spark splits.
    rows = rows.join(F.broadcast(known) if n <= WINDOWS_MOST else known, ["gram", "size"], "left")
    span = F.when(F.col("items").isNotNull(), F.struct((F.col("at") - 1).alias("first"), (F.col("at") - 1 + F.col("size")).alias("end")))
    return rows.groupBy("doc_id", "mark", "n_words").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


#: Words inside any span: sorted spans are merged from the left.
COVERED = "aggregate(spans, struct(0L as n, 0L as until), (a, x) -> struct(a.n + greatest(0L, x.end - greatest(a.until, cast(x.first as bigint))) as n, greatest(a.until, cast(x.end as bigint)) as until), a -> a.n)"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for each distinct (doc_id, text).

    A row repeated with the same id and text gives one row of the result. Ties do not arise: every
    occurrence counts. An empty benchmark hits nothing; an empty ``docs`` gives an empty result.
    """
    found = hits(docs, benchmark).withColumn("n_hit", F.expr(COVERED))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or with the hit spans cut out of the texts (``what="spans"``).

    The columns stay as they are; rows without a hit stay untouched. A cut word goes with the
    separators before it.
    """
    own = uuid.uuid4().hex
    key, mark, spans = f"k{own}", f"m{own}", f"s{own}"
    marked = hits(docs, benchmark).where("size(spans) > 0").select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("spans").alias(spans))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(mark))
    if what == "documents":
        return docs.join(marked.drop(spans), same, "left_anti")
    cut = F.concat(
        F.array_join(F.expr(rf"filter(regexp_extract_all(text, r'{WITH_GAP}', 0), (x, i) -> not exists({spans}, s -> i >= s.first and i < s.end))"), ""),
        F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0),
    )
    return docs.join(marked, same, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut)).select(docs.columns)
