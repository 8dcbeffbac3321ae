"""One pass over each key's rows in order, with a state from row to row; and scans, ranks and steps that split a key over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows of a key, at most, that one task sorts; a key with more is split.
ROWS = 1_000_000
#: Parts into which the order of a table with such a key is cut, at most.
PARTS = 10_000

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def walked(rows: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], walk: Callable[..., tuple], added: str) -> DataFrame:
    """``rows`` with the columns ``added`` (DDL), which a walk over each key's rows in ``order`` computes.

    ``walk(state, *inputs)`` is given a run of a key's rows, the columns as numpy arrays, and returns the next
    state and a sequence for each added column; the state is None at the first run of a key. Rows stream
    through in Arrow batches, so a key of any length needs no more than its state and a batch; it is one task, since
    each row depends on the row before. Inputs must not be null. A null key is a key.
    """
    ship(rows.sparkSession)
    fields = T.StructType.fromDDL(added).fields
    kinds = [_ARROW[f.dataType.simpleString()] for f in fields]
    names = [*rows.columns, *(f.name for f in fields)]
    by, at = rows.columns.index(key), [rows.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, fresh = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = pc.run_end_encode(batch.column(by))
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            out: list[list[Any]] = [[] for _ in fields]
            lo = 0
            for value, hi in zip(coded.values.to_pylist(), coded.run_ends.to_pylist(), strict=True):
                if fresh or value != last:
                    last, state, fresh = value, None, False
                state, *found = walk(state, *(c[lo:hi] for c in columns))
                for o, f in zip(out, found, strict=True):
                    o.extend(f.tolist() if hasattr(f, "tolist") else f)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=names)

    ordered = rows.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def ranked(rows: DataFrame, key: str, order: str, into: str, width: int = 1 << 16) -> DataFrame:
    """``rows`` with the place of each among its key's, by the number ``order``, from 1 on.

    A key is split into buckets of ``width``, which are ranked apart; only their counts are summed up over a
    whole key. Rows with the same order and key have places in any order.
    """
    cut = rows.withColumn("_bucket", F.floor(F.col(order) / width))
    sizes = cut.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at"))
    return cut.withColumn("_own", own).join(sizes, same).withColumn(into, (F.col("_own") + F.col("_before")).cast("int")).drop("_bucket", "_own", "_key", "_at", "_before")


def steps(points: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """(key, step): from each distinct value of ``at`` of a key to the next one.

    Values meet in buckets of ``width``; a bucket's first value goes back to the last one of the bucket before, of
    which only the bounds are lined up over a whole key. Nulls have no steps.
    """
    values = points.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_at"), F.floor(F.col(at) / width).alias("_bucket")).distinct()
    bounds = values.groupBy(key, "_bucket").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    across = bounds.select(key, (F.col("_low") - F.lag("_high").over(Window.partitionBy(key).orderBy("_bucket"))).alias("step"))
    inside = values.select(key, (F.col("_at") - F.lag("_at").over(Window.partitionBy(key, "_bucket").orderBy("_at"))).alias("step"))
    return inside.union(across).where("step is not null")


class Scan:
    """Values from all rows before or after a row of its key, in two passes where a key is too long for one task.

    Rows are cut into parts by quantiles of the first order column, the same for all keys, so a part of a key has about
    ``rows`` rows at most, or those of one value. Inside a part the values are windows; a part is summed up by an
    associative step (sum, last value, next value), these summaries are lined up over a key, a row for each part, and what
    comes in from other parts is handed to the rows. Rows and summaries meet by key and part, by which the rows are dealt
    already. Without a key of more than ``rows`` rows, or if the first order column is no number or time, all is one part: windows go by
    the key itself, so rows that are dealt by it are not shuffled, nor is what is grouped by it and more.

    Several ``take`` share one dealing and sorting of the rows. The order should have no ties, or they go either way.
    """

    def __init__(self, df: DataFrame, key: str | Sequence[str], order: Sequence[str], rows: int | None = None):
        rows = ROWS if rows is None else rows
        self.columns, self.order = df.columns, [F.col(c) for c in order]
        self.key = [key] if isinstance(key, str) else list(key)
        kind = df.schema[order[0]].dataType
        longest = df.groupBy(*self.key).count().agg(F.max("count"), F.sum("count")).first() if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType)) else (0, 0)
        self.split = (longest[0] or 0) > rows
        self.df, self.by = df, self.key
        if self.split:
            self.by = ["_k", "_part"]
            self.df = df.withColumn("_k", F.struct(*self.key)).withColumn("_part", F.lit(-1.0))
            n = min(PARTS, -(-longest[1] // rows))
            at = df.select(F.col(order[0]).cast("timestamp_ltz" if isinstance(kind, T.TimestampNTZType) else kind).cast("double").alias("_v"))
            cuts = sorted(set(at.where("not isnan(_v)").approxQuantile("_v", [i / n for i in range(1, n)], 0.1 / n)))
            if cuts:
                value = F.col(order[0]).cast("timestamp_ltz" if isinstance(kind, T.TimestampNTZType) else kind).cast("double")
                buckets = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_v", outputCol="_part", handleInvalid="keep")
                dealt = buckets.transform(self.df.drop("_part").withColumn("_v", value))
                self.df = dealt.withColumn("_part", F.when(F.col("_v").isNull(), -1.0).otherwise(F.col("_part"))).drop("_v")

    def take(self, **values: tuple[str, Column]) -> Scan:
        """Columns more: ``sum``: of the rows before, 0 without any; ``last``: the last value before that is not null; ``next``: the first one after."""
        w = Window.partitionBy(*self.by).orderBy(*self.order)
        before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
        place = F.struct(*self.order)
        local, whole, carried = [], [], []
        parts = Window.partitionBy("_k").orderBy("_part")
        early, late = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
        for name, (kind, value) in values.items():
            if kind == "sum":
                local.append(F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))
                whole.append(F.sum(value).alias(name))
                carried.append(F.coalesce(F.sum(name).over(early), F.lit(0)).alias(f"_c_{name}"))
            else:
                there = F.when(value.isNotNull(), place)
                back = kind == "last"
                local.append((F.last(value, ignorenulls=True).over(before) if back else F.first(value, ignorenulls=True).over(after)).alias(name))
                whole.append((F.max_by(value, there) if back else F.min_by(value, there)).alias(name))
                carried.append((F.last(name, ignorenulls=True).over(early) if back else F.first(name, ignorenulls=True).over(late)).alias(f"_c_{name}"))
        kept = [c for c in self.df.columns if c not in values]
        out = self.df.select(*kept, *local)
        if self.split:
            sums = self.df.groupBy("_k", "_part").agg(*whole).select("_k", "_part", *carried)
            found = out.join(sums, ["_k", "_part"])
            both = [(F.col(n) + F.col(f"_c_{n}") if kind == "sum" else F.coalesce(n, f"_c_{n}")).alias(n) for n, (kind, _) in values.items()]
            out = found.select(*kept, *both)
        self.df = out
        return self

    def also(self, **values: Column) -> Scan:
        """Columns more, of each row by itself."""
        for name, value in values.items():
            self.df = self.df.withColumn(name, value)
        return self

    def done(self, *drop: str) -> DataFrame:
        """The rows, without the columns named."""
        return self.df.drop("_k", "_part", *drop)
