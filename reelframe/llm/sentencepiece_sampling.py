"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

A text is taken as bytes with one leading space; pieces are byte strings in which U+2581 stands for a
space. Every way to spell the bytes as pieces is a path of the lattice, with probability in
proportion to the product of its pieces' weights. The forward pass sums the weights of all paths to
each position; the backward pass draws the last piece, then the one before, and so on, which samples
a whole path exactly. Draws come from a counter hashed with the row's key, so a row gets the same
segmentation whatever partition or batch it is in. Characters without a piece fall back to byte
pieces, so decoding returns the text byte for byte.

No piece has a space after another character, so the lattice falls apart before each run of spaces:
the forward pass is done once for each distinct part of a batch, in numpy over all parts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import slices, tidy
from .hashing import U64, mix, powers

#: The vocabulary's file, and the exponent on the pieces' weights: 0 takes all segmentations alike, large values the best.
MODEL, ALPHA, SEED = "/opt/tokenizers/piece_bpe_32k.model", 1.0, 1
#: Bytes of text in one lattice; a longer single text is a lattice of its own.
CHUNK = 1 << 19
_SPACE = 32


@dataclass
class Pieces:
    """A vocabulary: the bytes of each piece, log-weights, byte pieces, and a trie with a row for each inner node."""

    data: np.ndarray
    offsets: np.ndarray
    log_weight: np.ndarray
    byte_ids: np.ndarray
    step: np.ndarray
    piece_at: np.ndarray
    splits: bool


_loaded: dict[tuple[str, float], Pieces] = {}


def load(model: str = MODEL, alpha: float = ALPHA) -> Pieces:
    """The vocabulary of a model file, once for each process.

    Scores of a unigram model are log-probabilities. Those of a BPE model are whole numbers, minus
    the rank of the merge; a piece of rank r then weighs 1 / (r + 10), as in Zipf's law.
    """
    if (model, alpha) in _loaded:
        return _loaded[model, alpha]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    scores = np.array([sp.get_score(i) for i in range(n)])
    usual = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)])
    ranked = bool(np.all(scores[usual] == np.round(scores[usual])))
    weight = -np.log(np.clip(-scores, 0, n) + 10) if ranked else scores.copy()
    weight[~usual] = weight[usual].min()
    spelled: list[bytes] = []
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        else:
            spelled.append(sp.id_to_piece(i).replace("▁", " ").encode() if usual[i] else b"")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so decoding could lose characters")
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i in np.flatnonzero(usual).tolist():
        node = 0
        for b in spelled[i]:
            node = children[node].setdefault(b, len(children)) if b not in children[node] else children[node][b]
            if node == len(children):
                children.append({})
        ends.setdefault(node, i)
    inner = [k for k, c in enumerate(children) if c]
    place = np.full(len(children), -1, np.int32)
    place[inner] = np.arange(len(inner))
    place[[k for k, c in enumerate(children) if not c]] = np.arange(len(inner), len(children))
    step = np.full((len(inner), 256), -1, np.int32)
    for k in inner:
        for b, to in children[k].items():
            step[place[k], b] = place[to]
    piece_at = np.full(len(children), -1, np.int32)
    for k, i in ends.items():
        piece_at[place[k]] = i
    lengths = [len(x) for x in spelled]
    splits = not any(b" " in x.lstrip(b" ") for x in spelled)
    found = Pieces(np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum(lengths)]), alpha * weight, byte_ids, step, piece_at, splits)
    _loaded[model, alpha] = found
    return found


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = np.flatnonzero(lengths)
    if len(full):
        first = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        out[first] = starts[full]
        out[first[1:]] -= starts[full][:-1] + lengths[full][:-1] - 1
    return np.cumsum(out)


def edges(text: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every piece that fits somewhere in the parts text[offsets[i]:offsets[i + 1]]."""
    n = len(text)
    limit = np.repeat(offsets[1:], np.diff(offsets))
    at, node = np.arange(n), np.zeros(n, np.int32)
    starts, ends, ids = [], [], []
    depth, inner = 0, len(pieces.step)
    single = np.zeros(n, np.int32)  # bytes of the character that starts here and has a piece of its own
    lead = text
    width = np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))
    while len(at):
        node = pieces.step[node, text[at + depth]]
        depth += 1
        alive = node >= 0
        at, node = at[alive], node[alive]
        piece = pieces.piece_at[node]
        hit = np.flatnonzero(piece >= 0)
        starts.append(at[hit])
        ends.append(at[hit] + depth)
        ids.append(piece[hit])
        own = at[hit][width[at[hit]] == depth]
        single[own] = depth
        go = (node < inner) & (at + depth < limit[at])
        at, node = at[go], node[go]
    spelled = np.zeros(n + 1, np.int64)
    np.add.at(spelled, np.flatnonzero(single), 1)
    np.add.at(spelled, np.flatnonzero(single) + single[single > 0], -1)
    bare = np.flatnonzero(np.cumsum(spelled[:-1]) == 0)
    starts.append(bare)
    ends.append(bare + 1)
    ids.append(pieces.byte_ids[text[bare]])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)


class Lattice:
    """Forward sums over the parts, and for each node the pieces that end there with their cumulated probabilities."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray, pieces: Pieces):
        starts, ends, ids = edges(text, offsets, pieces)
        lengths = np.diff(offsets)
        part = np.repeat(np.arange(len(lengths)), lengths)[starts]
        #: Nodes of part i: the positions from its start to its end, one more than it has bytes.
        self.begin = offsets[:-1] + np.arange(len(lengths))
        self.end = self.begin + lengths
        source, target = starts + part, ends + part
        depth = target - self.begin[part]
        order = np.argsort(depth * (len(text) + len(lengths) + 1) + target, kind="stable")
        self.source, self.ids = source[order], ids[order]
        target, depth, weight = target[order], depth[order], pieces.log_weight[self.ids]
        n = len(text) + len(lengths)
        forward = np.full(n, -np.inf)
        forward[self.begin] = 0
        new = np.ones(len(target), dtype=bool)
        new[1:] = target[1:] != target[:-1]
        groups = np.flatnonzero(new)
        self.first = np.zeros(n, np.int64)
        self.first[target[groups]] = groups
        levels = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        at_group = np.searchsorted(groups, levels)
        sums = np.empty(len(target))
        for k in range(len(levels) - 1):
            lo, hi = levels[k], levels[k + 1]
            if lo == hi:
                continue
            g = groups[at_group[k] : at_group[k + 1]]
            path = forward[self.source[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(path, g - lo)
            size = np.diff(np.append(g, hi))
            part_sum = np.exp(path - np.repeat(top, size))
            total = np.add.reduceat(part_sum, g - lo)
            forward[target[g]] = top + np.log(total)
            sums[lo:hi] = part_sum / np.repeat(total, size)
        self.forward = forward
        last = np.append(groups[1:], len(target)) - 1 if len(groups) else groups
        # In units of 2^-53, in whole numbers modulo 2^64: what a node's pieces add up to does not depend on what else is in the batch.
        running = np.cumsum((sums * 2.0**53).astype(np.uint64))
        self.upto = running - np.repeat(np.concatenate([np.zeros(1, np.uint64), running[last[:-1]]]) if len(groups) else np.zeros(0, np.uint64), np.diff(np.append(groups, len(target))))
        self.upto[last] = U64(1 << 62)  # rounding never runs past a node's last piece

    def sample(self, parts: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of one sampled path through each of ``parts``, joined, and how many each has; ``draws`` seeds each path."""
        node = self.end[parts]
        stop = self.begin[parts]
        who = np.arange(len(parts))
        count = np.zeros(len(parts), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            u = mix(draws[who] + U64(step * 0x9E3779B97F4A7C15 % 2**64)) >> U64(11)
            edge = self.first[node]
            behind = np.flatnonzero(self.upto[edge] <= u)
            while len(behind):
                edge[behind] += 1
                behind = behind[self.upto[edge[behind]] <= u[behind]]
            taken.append((who, self.ids[edge]))
            count[who] += 1
            node = self.source[edge]
            on = node != stop[who]
            who, node = who[on], node[on]
            step += 1
        last = np.cumsum(count) - 1
        out = np.zeros(int(count.sum()), np.int32)
        for k, (who, ids) in enumerate(taken):
            out[last[who] - k] = ids
        return out, count


def sample_texts(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, joined, and the number of each text's pieces. An empty text has none."""
    full = np.flatnonzero(np.diff(offsets))
    text = np.insert(data, offsets[full], _SPACE)
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    row_start = offsets[full] + np.arange(len(full))
    opens = np.zeros(n, dtype=bool)
    if pieces.splits:
        opens = text == _SPACE
        opens[1:] &= text[:-1] != _SPACE
    opens[row_start] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + U64(1)) * _BYTE[text] * powers(_BASE, n)[:-1], out=prefix[1:])
    same = mix((prefix[ends] - prefix[starts]) * powers(_DOWN, n)[starts]) + (ends - starts).astype(np.uint64)
    _, which, part = np.unique(same, return_index=True, return_inverse=True)
    lengths = ends[which] - starts[which]
    lattice = Lattice(text[_ragged(starts[which], lengths)], np.concatenate([[0], np.cumsum(lengths)]), pieces)
    row = np.searchsorted(row_start, starts, side="right") - 1
    within = np.arange(len(starts)) - np.searchsorted(starts, row_start)[row]
    draws = mix(keys[full][row] + mix(within.astype(np.uint64) + U64(0x2545F4914F6CDD1D)))
    ids, count = lattice.sample(part, draws)
    per_row = np.zeros(len(offsets) - 1, np.int64)
    per_row[full] = np.add.reduceat(count, np.searchsorted(starts, row_start))
    return ids, per_row


_BASE = 0x9E3779B97F4A7C15
_DOWN = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def join_pieces(ids: np.ndarray, counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, joined, and their offsets: the inverse of ``sample_texts``."""
    lengths = pieces.offsets[ids + 1] - pieces.offsets[ids]
    data = pieces.data[_ragged(pieces.offsets[ids], lengths)] if len(ids) else np.zeros(0, np.uint8)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    rows = np.concatenate([[0], np.cumsum(counts)])
    bounds = upto[rows]
    lead = bounds[:-1][np.diff(bounds) > 0]
    lead = lead[data[lead] == _SPACE]
    data = np.delete(data, lead)
    return data, bounds - np.searchsorted(lead, bounds)


def encode(docs: DataFrame, key: Column | str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, into: str = "pieces") -> DataFrame:
    """``docs`` with the sampled piece ids in ``into`` (array<int>) and ``lossless``: whether they decode to the very text.

    Null texts have a null array and are lossless; empty texts an empty one. Columns named ``into``,
    ``lossless`` or ``_key`` are replaced. Rows with the same key and text get the same pieces; a null
    key is a key like any other. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (into, "lossless", "_key")]
    at = rest.index(text)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, alpha)
        for batch in batches:
            texts, seeds = batch.column(at), batch.column(len(rest)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, end, data, offsets in slices(texts, CHUNK):
                ids, counts = sample_texts(data, offsets, seeds[first:end], pieces)
                back, bounds = join_pieces(ids, counts, pieces)
                same = len(back) == len(data) and np.array_equal(bounds, offsets) and np.array_equal(back, data)
                same = np.full(end - first, True) if same else np.array([back[bounds[i] : bounds[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - first)])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                part = batch.slice(first, end - first)
                lists = pc.if_else(part.column(at).is_valid(), lists, None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(same)], names=[*rest, into, "lossless"])

    schema = docs.select(rest).schema.add(into, T.ArrayType(T.IntegerType())).add("lossless", "boolean")
    return docs.select(*rest, F.xxhash64(F.lit(seed), F.col(key) if isinstance(key, str) else key).alias("_key")).mapInArrow(run, schema)


def decode(coded: DataFrame, pieces_column: str = "pieces", model: str = MODEL, into: str = "decoded") -> DataFrame:
    """``coded`` with the text of its piece ids in ``into``; null for a null array. Control pieces have no text."""
    ship(coded.sparkSession)
    rest = [c for c in coded.columns if c != into]
    at = rest.index(pieces_column)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            lists = batch.column(at)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = join_pieces(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, pieces)
            texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_valid(), texts, None).cast(pa.string())], names=[*rest, into])

    return coded.select(rest).mapInArrow(run, coded.select(rest).schema.add(into, "string"))
