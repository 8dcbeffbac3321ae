"""Hooks: named judges of what a job reaches, stage by stage, as relations.

What a job reaches is a table of events (job, stage, item, and what there is to judge). Every hook judges every event of
its stages by itself, all in one pass over the table; which of the answers a job came to, as rejections end it, follows from their
order. Records come out as rows: (job, stage, item, hook, mode, verdict, reason, annotations, error).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

# The stages in the order a job reaches them.
STAGES = ("source", "probe", "decoded-frame", "encoder-frame", "still", "artifact", "completed", "failed")
_PLACE = {s: i for i, s in enumerate(STAGES)}
_ANSWER = "struct<reason:string,annotations:map<string,string>,error:string>"


def answer(reason: Column | None = None, annotations: dict[str, Column] | None = None, error: Column | None = None) -> Column:
    """UDF-03: a hook's answer: a rejection where ``reason`` is not null, named values to record, an error where it failed."""
    kept = F.create_map(*(x for k, v in annotations.items() for x in (F.lit(k), v.cast("string")))) if annotations else F.create_map().cast("map<string,string>")
    null = F.lit(None).cast("string")
    return F.struct((null if reason is None else reason).alias("reason"), kept.alias("annotations"), (null if error is None else error).alias("error")).cast(_ANSWER)


@dataclass(frozen=True)
class Hook:
    """UDF-01/02/04: a judge of some stages.

    ``judge``: a Column of ``answer`` over an event's columns, or a function of an event as a dict, which returns
    (reason or None, annotations) and may raise. ``background``: a rejection ends the job at its next stage, not at once.
    ``fail_closed``: an error is a rejection. ``required``: runs without being named.
    """

    name: str
    stages: Sequence[str]
    judge: Column | Callable[[dict[str, Any]], tuple[str | None, dict[str, str]]]
    background: bool = False
    fail_closed: bool = False
    required: bool = True

    def __post_init__(self) -> None:
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"no such stages: {sorted(unknown)}")


@dataclass(frozen=True)
class Hooks:
    """An ordered set of hooks with unique names."""

    hooks: tuple[Hook, ...] = ()

    def with_hook(self, hook: Hook) -> Hooks:
        """UDF-09: the set with ``hook`` last; one of the same name is replaced."""
        return Hooks((*(h for h in self.hooks if h.name != hook.name), hook))

    def merged(self, other: Hooks) -> Hooks:
        """SET-07: every hook of ``other`` added in its order; a name in both takes the other's."""
        out = self
        for hook in other.hooks:
            out = out.with_hook(hook)
        return out

    def select(self, names: Sequence[str]) -> Hooks:
        """SET-07: the required hooks and the optional ones named; an unknown name is an error."""
        known = {h.name for h in self.hooks}
        if unknown := [n for n in names if n not in known]:
            raise ValueError(f"cannot select {sorted(unknown)}: hooks of this set are {sorted(known)}")
        return Hooks(tuple(h for h in self.hooks if h.required or h.name in names))

    def described(self) -> list[dict[str, Any]]:
        """UDF-05: what is registered, in the order it runs."""
        return [{"name": h.name, "stages": list(h.stages), "mode": "background" if h.background else "blocking", "on_error": "reject" if h.fail_closed else "continue", "required": h.required} for h in self.hooks]


def _called(events: DataFrame, number: int, judge: Callable[[dict[str, Any]], tuple[str | None, dict[str, str]]], stages: Sequence[str]) -> DataFrame:
    """``events`` with ``_a<number>``: the answers of a Python judge, in Arrow batches; what it raises is the error of that event alone."""
    names, at, wanted = events.columns, events.columns.index("stage"), frozenset(stages)
    kind = pa.struct([("reason", pa.string()), ("annotations", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] not in wanted:
                    out.append(None)
                    continue
                try:
                    reason, notes = judge(dict(zip(names, row, strict=True)))
                    out.append({"reason": reason, "annotations": list((notes or {}).items()), "error": None})
                except Exception as e:  # a hook that errs is a record, not a failed task
                    out.append({"reason": None, "annotations": [], "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*names, f"_a{number}"])

    schema = T.StructType([*events.schema.fields, *T.StructType.fromDDL(f"_a{number} {_ANSWER}").fields])
    return events.mapInArrow(run, schema)


def records(events: DataFrame, hooks: Hooks) -> DataFrame:
    """UDF-01 to 05: the records of every job of ``events`` (job, stage, item, ...), up to where it ends.

    Within a job, events go by stage and item, and hooks in the order of the set. A rejection of a blocking hook ends the job
    there: nothing after it has a record. One of a background hook ends it at its next stage. Events of ``failed`` count for jobs that a
    hook ended or that have no ``completed`` event; what is said there ends nothing. A null item is item 0.
    """
    ship(events.sparkSession)
    marked = events.withColumn("item", F.coalesce(F.col("item"), F.lit(0)))
    given = []
    for n, hook in enumerate(hooks.hooks):
        if isinstance(hook.judge, Column):
            marked = marked.withColumn(f"_a{n}", F.when(F.col("stage").isin(*hook.stages), hook.judge))
        else:
            marked = _called(marked, n, hook.judge, hook.stages)
        given.append(F.struct(F.lit(n).alias("n"), F.lit(hook.name).alias("hook"), F.lit(hook.background).alias("background"), F.lit(hook.fail_closed).alias("closed"), F.col(f"_a{n}").alias("a")))
    place = F.create_map(*(F.lit(x) for pair in _PLACE.items() for x in pair))
    out = marked.select("job", "stage", "item", F.try_element_at(place, F.col("stage")).alias("at"), F.explode(F.array(*given)).alias("x")).where("x.a is not null and at is not null").select("job", "stage", "item", "at", "x.n", "x.hook", "x.background", "x.closed", "x.a.reason", "x.a.annotations", "x.a.error")
    reason = F.coalesce("reason", F.when(F.col("closed") & F.col("error").isNotNull(), F.concat("hook", F.lit(" failed: "), "error")))
    out = out.withColumn("reason", reason).withColumn("order", F.struct("at", "item", "n"))
    ends = F.col("reason").isNotNull() & (F.col("at") < _PLACE["failed"])
    # Where each job ends: folded before the shuffle, so a job with a third of all events is no single task.
    first = out.where(ends & ~F.col("background")).groupBy("job").agg(F.min("order").alias("stop"))
    later = out.where(ends & F.col("background")).join(first, "job", "left").where("stop is null or order <= stop").groupBy("job").agg(F.min("at").alias("last"))
    done = marked.where("stage = 'completed'").select("job").distinct().withColumn("done", F.lit(True))
    out = out.join(first, "job", "left").join(later, "job", "left").join(done, "job", "left")
    ran = (F.col("stop").isNull() | (F.col("order") <= F.col("stop"))) & (F.col("last").isNull() | (F.col("at") <= F.col("last")))
    ended = F.col("stop").isNotNull() | F.col("last").isNotNull() | F.col("done").isNull()
    out = out.where(F.when(F.col("at") == _PLACE["failed"], ended).otherwise(ran))
    return out.select("job", "stage", "item", "hook", F.when(F.col("background"), "background").otherwise("blocking").alias("mode"), F.when(F.col("reason").isNull(), "continue").otherwise("reject").alias("verdict"), "reason", "annotations", "error", F.col("order"))


def rejections(found: DataFrame) -> DataFrame:
    """UDF-05: (job, hook, stage, item, reason) of the rejection that ended each job, the first in order."""
    ended = found.where((F.col("verdict") == "reject") & (F.col("stage") != "failed"))
    first = F.min_by(F.struct("hook", "stage", "item", "reason"), "order")
    return ended.groupBy("job").agg(first.alias("x")).select("job", "x.*")


@dataclass(frozen=True)
class Measure:
    """A measure in parts: ``update(state, rows, delta)`` takes a batch of a title's rows into a state, ``merge`` makes one of two, ``finish(state, delta)`` gives the scores.

    States can be pickled. Rows come in any order and any batches, so the three must not depend on these.
    """

    start: Callable[[], Any]
    update: Callable[[Any, pa.RecordBatch, int], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any, int], dict[str, float]]


def _or_none(made: Callable[[], Any]) -> Any:
    """What ``made`` gives; None if it fails: one setting that cannot be measured must not cost the others."""
    try:
        return made()
    except Exception:
        return None


def _same(a: Any, b: Any) -> bool:
    """Whether two titles are one, as Spark has it: NaN is one title."""
    return a == b or (a != a and b != b)


def per_title(frames: DataFrame, title: str, deltas: Sequence[int], measure: Measure, scores: str) -> DataFrame:
    """UDF-07: a row (title, delta, <scores>) for each title and candidate. ``scores``: DDL of what the measure returns.

    Rows are dealt and sorted by title, so a batch has few titles or all rows of them; it becomes a state for each of its titles and candidates,
    and those of a title in a task are merged as they come. A title with more rows than a task should have is split by Spark (a rebalance),
    and the states of its parts are merged after a shuffle. A candidate that fails, in any part, is left out, not the sweep. A null title is a title.
    """
    ship(frames.sparkSession)
    names, rest = [x.split()[0] for x in scores.split(", ")], [c for c in frames.columns if c != title]
    kind = frames.schema[title].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value, states = None, None, None
        done: list[tuple[pa.Array, list[bytes | None]]] = []

        def shown() -> pa.RecordBatch:
            values = pa.concat_arrays([v for v, _ in done]).take(pa.array([i for i in range(len(done)) for _ in deltas], pa.int64()))
            return pa.RecordBatch.from_arrays([values, pa.array([d for _ in done for d in deltas], pa.int32()), pa.array([x for _, xs in done for x in xs], pa.binary())], names=["title", "delta", "state"])

        def close() -> None:
            if value is not None:
                done.append((value, [_or_none(lambda x=x: pickle.dumps(x[0])) if x else None for x in states]))

        for batch in batches:
            if not batch.num_rows:
                continue
            ends, low = pc.run_end_encode(batch.column(0).dictionary_encode(null_encoding="encode").indices).run_ends.to_pylist(), 0
            for name, high in zip(batch.column(0).take(pa.array([0, *ends[:-1]])).to_pylist(), ends, strict=True):
                if value is None or not _same(name, last):
                    close()
                    last, value, states = name, batch.column(0).slice(low, 1), None
                mine = batch.slice(low, high - low)
                # a state is in a list of its own; None once it failed
                fresh = [_or_none(lambda d=d: [measure.update(measure.start(), mine, d)]) for d in deltas]
                states = fresh if states is None else [x and y and _or_none(lambda x=x, y=y: [measure.merge(x[0], y[0])]) for x, y in zip(states, fresh, strict=True)]
                low = high
            if len(done) > 1000:
                yield shown()
                done.clear()
        close()
        if done:
            yield shown()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, fine, value = None, None, False, None
        done: list[tuple[pa.Array, int, dict[str, float]]] = []

        def close() -> None:
            if key is not None and fine:
                try:
                    found = measure.finish(state, key[1])
                    done.append((value, key[1], {c: float(found[c]) for c in names}))
                except Exception:  # one setting that cannot be measured must not cost the others
                    pass

        for batch in batches:
            for i, (name, delta, part) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if key is None or key[1] != delta or not _same(name, key[0]):
                    close()
                    key, state, fine, value = (name, delta), None, True, batch.column(0).slice(i, 1)
                try:
                    fine = fine and part is not None
                    if fine:
                        mine = pickle.loads(part)
                        state = mine if state is None else measure.merge(state, mine)
                except Exception:  # as above
                    fine = False
            if len(done) > 1000:
                yield shown(done)
                done.clear()
        close()
        if done:
            yield shown(done)

    def shown(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([v for v, _, _ in done]), pa.array([d for _, d, _ in done], pa.int32()), *(pa.array([x[c] for *_, x in done], pa.float64()) for c in names)], names=[title, "delta", *names])

    dealt = frames.select(F.col(title).alias("title"), *rest).hint("rebalance", "title").sortWithinPartitions("title")
    states = dealt.mapInArrow(parts, f"title {kind}, delta int, state binary")
    return states.repartition("title", "delta").sortWithinPartitions("title", "delta").mapInArrow(merged, f"`{title}` {kind}, delta int, " + ", ".join(f"{c} double" for c in names))


def detected(frames: DataFrame, keep: Sequence[str], inputs: Sequence[str], detector: Callable[..., list[tuple[str, float, float, float, float, float]]]) -> DataFrame:
    """UDF-08: a row (<keep>, label, score, x0, y0, x1, y1) for each box that ``detector(*inputs)`` finds in a frame; none for a frame without.

    The detector is any function, a model loaded on first use among them; frames stream through it in Arrow batches.
    """
    ship(frames.sparkSession)
    n = len(keep)
    rows = frames.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(inputs)))
    made = ["label", "score", "x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, boxes = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)):
                for box in detector(*values):
                    at.append(i)
                    boxes.append(box)
            columns = list(zip(*boxes, strict=True)) if boxes else [()] * 6
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:n]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:])], names=[*keep, *made])

    shape = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{shape}, label string, " + ", ".join(f"{c} double" for c in made[1:]))
