"""Deep-shallow suffix sorting, to a bounded depth, of many suffixes at once.

Shallow: multikey quicksort. A character is eight bytes; each round sorts the members of every group by the next
character, and groups of one are done. Suffixes that still agree after ``SHALLOW`` bytes have long prefixes in common, where
more rounds would read the same bytes again and again. Deep: each such group goes into a blind trie, a binary tree that knows only the bits
at which its strings part. A new suffix goes down by these bits alone, is compared once with the leaf it reaches,
and branches off at the first bit that differs. The leaves from left to right are the order. All groups take in
their next suffix together, in numpy passes.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which groups are sorted by characters; a multiple of 8.
SHALLOW = 24
_PAD = 16


class Suffixes:
    """Suffixes of ``data`` at ``starts``, each read to ``depth`` bytes: all of them are that long."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, depth: int):
        self.data = np.concatenate([data, np.zeros(_PAD, np.uint8)])
        self.starts, self.depth = starts.astype(np.int64), depth
        self._words = np.ndarray((len(self.data) - 7,), ">u8", self.data, 0, (1,)).astype(np.uint64)  # of each place, aligned and in the machine's order

    def word(self, which: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of the suffixes from ``at`` on; those past the depth are 0."""
        out = self._words[self.starts[which] + at]
        past = at + 8 - self.depth
        return out if past <= 0 else out >> np.uint64(8 * past) << np.uint64(8 * past)

    def bit(self, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (self.data[self.starts[which] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1

    def parts_at(self, a: np.ndarray, b: np.ndarray, first: int) -> np.ndarray:
        """The first bit where suffixes a and b differ, from byte ``first`` on; -1 if none does."""
        out = np.full(len(a), -1, np.int64)
        left, x, y = np.arange(len(a)), self.starts[a], self.starts[b]
        for at in range(first, self.depth, 8):
            if not len(left):
                break
            differ = self._words[x + at] ^ self._words[y + at]
            if (past := at + 8 - self.depth) > 0:
                differ = differ >> np.uint64(8 * past)  # those past the depth do not count
            same = differ == 0
            if same.all():
                continue
            found = ~same
            z = differ[found]
            high = np.full(len(z), 8 * max(past, 0), np.int64)
            for shift in (32, 16, 8, 4, 2, 1):  # the highest bit that is set
                big = z >> np.uint64(shift) != 0
                z = np.where(big, z >> np.uint64(shift), z)
                high += shift * big
            out[left[found]] = 8 * at + 63 - high
            left, x, y = left[same], x[same], y[same]
        return out


def order(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``starts``, by the ``depth`` bytes that follow each; whether each has the same bytes as the one before)."""
    s = Suffixes(data, starts, depth)
    n = len(starts)
    out = np.arange(n)
    head = np.zeros(n, bool)  # where a group begins
    head[:1] = True
    at = np.arange(n)  # places of ``out`` whose groups are not done
    for byte in range(0, min(shallow, depth), 8):
        group = np.cumsum(head)[at]
        key = s.word(out[at], byte)
        sorted_ = np.lexsort((key, group)) if byte else np.argsort(key, kind="stable")
        out[at] = out[at][sorted_]
        key = key[sorted_]
        head[at[1:][(key[1:] != key[:-1])]] = True
        last = np.append(head[1:], True)
        at = at[~(head[at] & last[at])]
    same = ~head
    if len(at) and depth > shallow:
        begins = at[head[at]]
        sizes = np.diff(np.append(np.flatnonzero(np.append(head[at], True)), [])).astype(np.int64)
        placed, equal = _tries(s, out[at], sizes, shallow)
        out[at] = placed
        same[at] = equal
        same[begins] = False
    return out, same


def _tries(s: Suffixes, members: np.ndarray, sizes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Each group of members, one after the other, in order; and whether each is the same as the one before in its group.

    A reference is a node if 0 or more, else ``~member``. Node i is made when member i comes in, if it differs from all before.
    """
    n = len(members)
    base = np.cumsum(sizes) - sizes
    skip = np.zeros(n, np.int64)  # the bit at which a node parts
    child = np.zeros((n, 2), np.int64)
    root = ~base  # of each group; first its first member
    copies = np.ones(n, np.int64)  # of each leaf: members with the same bytes
    leaf_of = np.arange(n)
    alive = np.argsort(-sizes, kind="stable")
    for turn in range(1, int(sizes.max())):
        alive = alive[: int(np.searchsorted(-sizes[alive], -turn, side="left"))]
        new = base[alive] + turn
        suffix = members[new]
        ref = root[alive].copy()
        while len(open_ := np.flatnonzero(ref >= 0)):  # down by the bits that nodes know
            node = ref[open_]
            ref[open_] = child[node, s.bit(suffix[open_], skip[node])]
        near = ~ref
        bit = s.parts_at(suffix, members[near], first)
        twin = bit < 0
        copies[near[twin]] += 1
        leaf_of[new[twin]] = near[twin]
        mine = np.flatnonzero(~twin)
        if not len(mine):
            continue
        group, new, suffix, bit = alive[mine], new[mine], suffix[mine], bit[mine]
        ref, parent, side = root[group].copy(), np.full(len(mine), -1, np.int64), np.zeros(len(mine), np.int64)
        while True:  # down again, to where the new branch goes
            node = np.where(ref >= 0, ref, 0)
            go = np.flatnonzero((ref >= 0) & (skip[node] < bit))
            if not len(go):
                break
            parent[go] = ref[go]
            side[go] = s.bit(suffix[go], skip[ref[go]])
            ref[go] = child[parent[go], side[go]]
        one = s.bit(suffix, bit).astype(np.int64)
        skip[new] = bit
        child[new, one] = ~new
        child[new, 1 - one] = ref
        top = parent < 0
        root[group[top]] = new[top]
        child[parent[~top], side[~top]] = new[~top]
    # leaves from left to right: sizes of all subtrees from the deepest up, then places from the roots down
    levels, ref = [], root
    while len(ref := ref[ref >= 0]):
        levels.append(ref)
        ref = child[ref].reshape(-1)
    weight = np.zeros(n, np.int64)
    of = lambda r: np.where(r >= 0, weight[np.maximum(r, 0)], copies[np.maximum(~r, 0)])
    for level in reversed(levels):
        weight[level] = of(child[level, 0]) + of(child[level, 1])
    leaf_place, place = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(ref: np.ndarray, where: np.ndarray) -> None:
        node = ref >= 0
        place[ref[node]] = where[node]
        leaf_place[~ref[~node]] = where[~node]

    put(root, base)
    for level in levels:
        put(child[level, 0], place[level])
        put(child[level, 1], place[level] + of(child[level, 0]))
    by_leaf = np.argsort(leaf_place[leaf_of], kind="stable")  # members of one leaf keep their order
    spot = leaf_place[leaf_of][by_leaf]
    equal = np.zeros(n, bool)
    equal[1:] = spot[1:] == spot[:-1]
    return members[by_leaf], equal
