"""Toxicity by a classifier chain of linear models over hashed words and word beginnings.

Categories are predicted in order; the model of each category sees the text's features and the
log-odds of all earlier categories. While fitting, those log-odds come from models that did not see
the row (out of fold), so a later model learns to trust an earlier one as far as it deserves.

The chain is fitted on a bounded sample of labelled rows (``ROWS``). Features are counted in Spark; then the
sample's whole texts become counts of the chosen features, and one task fits the chain on these: ``ROWS``
rows of a few hundred numbers, whatever the length of the texts. Scoring goes over every whole text in
Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, cut, longs, slices, tidy
from .hashing import U64, Words

#: Labelled rows that the chain is fitted on, at most: those whose ids hash lowest.
ROWS = 8_000
#: Features of each category: the most strongly associated ones that ``LEAST`` sampled texts have.
FEATURES, LEAST = 256, 4
FOLDS, RIDGE = 4, 1.0
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A text is rejected from this probability of the deciding category.
CUT = 0.4

#: Words are runs of a-z, 0-9 and bytes above 0x7F.
BREAK = np.ones(256, dtype=bool)
BREAK[48:58] = BREAK[97:123] = BREAK[128:] = False


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The words of a run of texts; for each kind of feature, the hashes and the words they come from."""
    words = Words(data, offsets, separator=BREAK)
    length = words.ends - words.starts

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield words.hashes(), np.arange(len(length))
        for k in BEGINNINGS:
            longer = np.flatnonzero(length > k)
            yield words.hashes(k)[longer] ^ U64(0x5851F42D4C957F2D), longer

    return words, each()


def _texts_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first)), words.last - words.first)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) pairs of all texts, each pair once."""
    found, rows = [], []
    for first, _, data, offsets in slices(texts, 1 << 18):
        words, kinds = occurrences(data, offsets)
        of = _texts_of(words)
        hashes, at = zip(*kinds, strict=True)
        h, row = np.concatenate(hashes), of[np.concatenate(at)]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        found.append(h[new])
        rows.append((row[new] + first).astype(np.int32))
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def counts(texts: pa.Array, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each chosen feature (sorted hashes), and how many words it has."""
    out, lengths = np.zeros((len(texts), len(chosen)), np.float32), np.zeros(len(texts), np.float32)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(chosen >> U64(48)).astype(np.int64)] = True
    for first, end, data, offsets in slices(texts):
        words, kinds = occurrences(data, offsets)
        of = _texts_of(words)
        lengths[first:end] = words.last - words.first
        if not len(chosen):
            continue
        for hashes, at in kinds:
            likely = np.flatnonzero(maybe[(hashes >> U64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(chosen, hashes[likely]), len(chosen) - 1)
            hit = chosen[place] == hashes[likely]
            np.add.at(out, (of[at[likely[hit]]] + first, place[hit]), 1)
    return out, lengths


def association(present: Column, wanted: Column, rows: int, hits: int) -> Column:
    """G squared of features that ``present`` texts have, ``wanted`` of them in the category, of ``hits`` among ``rows``."""

    def part(seen: Column, expected: Column) -> Column:
        return seen * F.log(F.greatest(seen, F.lit(1e-9)) / F.greatest(expected, F.lit(1e-9)))

    share = hits / max(rows, 1)
    absent, lost = rows - present, hits - wanted
    return 2 * (part(wanted, present * share) + part(present - wanted, present * (1 - share)) + part(lost, absent * share) + part(absent - lost, absent * (1 - share)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 4 / max(size, 1e-9))
        if size < 1e-4:
            break
    return w


@dataclass
class Chain:
    """A fitted chain: the categories in order, features, their base rates, and a weight row for each category."""

    categories: Sequence[str]
    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: list[np.ndarray] = field(default_factory=list)
    columns: list[np.ndarray] = field(default_factory=list)

    def inputs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By how many deviations each count exceeds what a text of that length has by chance, clipped; the word counts."""
        seen, lengths = counts(texts, self.chosen)
        return self.excess(seen, lengths), lengths

    def excess(self, seen: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        usual = lengths[:, None] * self.rates
        return np.clip((seen - usual) / np.sqrt(usual + 1), -2, 6)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each category; each model sees those of the categories before."""
        out = np.zeros((len(x), len(self.weights)))
        for k, (w, use) in enumerate(zip(self.weights, self.columns, strict=True)):
            out[:, k] = np.clip(np.hstack([x[:, use], out[:, :k]]) @ w[:-1] + w[-1], -20, 20)
        return out

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Zero in every category for texts without words."""
        x, lengths = self.inputs(texts)
        return np.where(lengths[:, None] > 0, 1 / (1 + np.exp(-self.odds(x))), 0.0)


def fit_chain(seen: np.ndarray, lengths: np.ndarray, labels: np.ndarray, categories: Sequence[str], picks: Sequence[np.ndarray]) -> Chain:
    """A chain from the counts of the chosen features (``seen``: a row for each text, a column for each of all picks, sorted), the
    word counts, and ``labels``: 0 or 1 for each text and category, in chain order. No rows: a chain that says 0."""
    chain, n = Chain(tuple(categories)), len(seen)
    if not n:
        chain.weights, chain.columns = [np.append(np.zeros(k), -20.0) for k in range(len(categories))], [np.zeros(0, int)] * len(categories)
        return chain
    chain.chosen = np.unique(np.concatenate(picks))
    clean = labels.sum(axis=1) == 0
    chain.rates = (seen[clean].sum(axis=0) + 0.01) / max(1.0, lengths[clean].sum())
    x = chain.excess(seen, lengths)
    fold = np.arange(n) % FOLDS
    earlier = np.zeros((n, 0))
    for k in range(len(categories)):
        use = np.searchsorted(chain.chosen, np.sort(picks[k]))
        part, y = np.hstack([x[:, use], earlier]), labels[:, k].astype(float)
        unseen = np.zeros(n)
        for f in range(FOLDS):
            w = fit_linear(part[fold != f], y[fold != f])
            unseen[fold == f] = part[fold == f] @ w[:-1] + w[-1]
        chain.weights.append(fit_linear(part, y))
        chain.columns.append(use)
        earlier = np.hstack([earlier, np.clip(unseen, -20, 20)[:, None]])
    return chain


def strongest(sample: DataFrame, categories: Sequence[str]) -> list[np.ndarray]:
    """Of each category, the ``FEATURES`` features most strongly associated with it, of those that ``LEAST`` texts of ``sample`` (text, <categories>) have."""
    names = [f"in_{c}" for c in categories]

    @tidy
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(0), np.stack([batch.column(1 + k).to_numpy() for k in range(len(names))], axis=1)
            for first, end, _, _ in slices(texts):
                feature, row = distinct_features(texts.slice(first, end - first))
                values, place, present = np.unique(feature, return_inverse=True, return_counts=True)
                wanted = [pa.array(np.bincount(place, weights=labels[first:end][row, k], minlength=len(values)).astype(np.int64)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([longs(values), pa.array(present), *wanted], names=["feature", "present", *names])

    each = sample.select("text", *categories).mapInArrow(found, "feature long, present long, " + ", ".join(f"{c} long" for c in names))
    common = cut(each.groupBy("feature").agg(F.sum("present").alias("present"), *(F.sum(c).alias(c) for c in names)).where(F.col("present") >= LEAST))
    n, *hits = sample.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in categories)).first()
    out = []
    for name, h in zip(names, hits, strict=True):
        strength = association(F.col("present").cast("double"), F.col(name).cast("double"), n, h)
        best = common.orderBy(F.desc(strength), "feature").limit(FEATURES).select("feature").toArrow()  # FEATURES rows
        out.append(best.column("feature").to_numpy().view(np.uint64))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], rows: int = ROWS) -> Chain:
    """A chain fitted on the ``rows`` labelled documents whose doc_id hashes lowest.

    ``labels``: doc_id and one 0/1 column for each category; rows with a null in any of these are not used, nor null texts; of several rows of a document, each category counts if any row has it.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select("doc_id", *(F.col(c).cast("int").alias(c) for c in categories)).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    names, scratch = tuple(categories), Scratch(spark)
    sample = scratch.written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "labelled")
    picks = strongest(sample, names)
    every = np.unique(np.concatenate(picks))

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, lengths = counts(batch.column(0), every)
            ends = pa.array(np.arange(len(seen) + 1, dtype=np.int32) * len(every))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(seen.reshape(-1)))], names=["doc_id", "mark", *names, "length", "seen"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
            seen = table.column("seen").combine_chunks().flatten().to_numpy().reshape(table.num_rows, len(every))
            chain = fit_chain(seen, table.column("length").to_numpy(), np.stack([table.column(c).to_numpy() for c in names], axis=1), names, picks)
        else:
            chain = fit_chain(np.zeros((0, 0)), np.zeros(0), np.zeros((0, len(names))), names, picks)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(chain)], pa.binary())], names=["chain"])

    shape = "doc_id long, mark long, " + ", ".join(f"{c} int" for c in names) + ", length float, seen array<float>"
    vectors = sample.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), *names).mapInArrow(counted, shape)
    made = vectors.repartition(1).mapInArrow(run, "chain binary").first()  # ROWS rows of numbers
    scratch.clear()
    return pickle.loads(made[0]) if made else fit_chain(np.zeros((0, 0)), np.zeros(0), np.zeros((0, len(names))), names, picks)


def score(docs: DataFrame, chain: Chain, column: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each category, in place of columns of such names.

    Null and empty texts, and texts without words, have probability 0 throughout. Repeated rows are
    scored alike. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    added = [f"p_{c}" for c in chain.categories]
    rest = [c for c in docs.columns if c not in added]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.probabilities(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(len(added)))], names=[*rest, *added])

    schema = docs.select(rest).schema
    for name in added:
        schema = schema.add(name, "double")
    return docs.select(rest).mapInArrow(run, schema)


def chain_labels(labels: DataFrame) -> DataFrame:
    """The categories that ``labels`` (quality, toxic) has, in chain order: poor and toxic."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"), F.col("toxic").cast("int").alias("toxic"))


CATEGORIES = ("poor", "toxic")


def reject_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rows whose probability of ``toxic`` is ``CUT`` or more; the columns stay as they are."""
    marked = score(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), chain)  # the caller's own p_toxic stays its own
    return marked.where(F.col("p_toxic") < CUT).select(*(F.col(f"row.`{c}`") for c in docs.columns))
