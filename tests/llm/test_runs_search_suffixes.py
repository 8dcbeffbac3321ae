"""Periodic runs, ranked search and suffix-array dedup against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows

from reelframe.llm import lexical, periodic, suffix_dedup, suffix_sort
from reelframe.llm.common import Scratch
from reelframe.llm.hashing import mix


def docs(spark, *texts):
    """Rows (doc_id, text) with more columns, some of which clash with names the operators use."""
    made = [(i, t, "x", 1.5, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, runs string, collapsed double, term int")


# Periodic runs


def plain_runs(w, least=6, times=4):
    """(start, length, period) of all runs, by trying every period at every place."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapsed(text):
    w = [x for x in (text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return found, " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(r):
    w = [r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 40))]
    for _ in range(r.randint(0, 2)):
        unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        w += (unit * 8)[: r.randint(0, 70)] + [r.choice("abx") for _ in range(r.randint(0, 4))]
    return w


def test_runs_equal_a_plain_search(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "one", "a " * 6, "a b " * 7, "é\x0b" * 9 + "\x85 " * 8, ("x " * 700 + "y ") * 5, " ".join(f"w{i}" for i in range(3000)) + " ja nein" * 900]
    texts += [(" " * r.randint(1, 2)).join(random_words(r)) for _ in range(300)]
    df = docs(spark, *texts, *texts[:40])
    got = {x["doc_id"]: x for x in periodic.collapse(df).collect()}
    assert periodic.collapse(df).columns == ["doc_id", "text", "term", "runs", "collapsed"]
    for i, text in enumerate([*texts, *texts[:40]]):
        runs, collapsed = plain_collapsed(text)
        assert [tuple(x) for x in got[i]["runs"]] == runs and got[i]["collapsed"] == collapsed
    assert periodic.collapse(df.limit(0)).collect() == []


def test_runs_take_other_limits(spark):
    text = "a b c d e f " * 5 + "x x x x"
    assert [tuple(x) for x in periodic.collapse(docs(spark, text), least=4, times=5).first()["runs"]] == plain_runs(text.split(), 4, 5)
    assert (periodic.overlap(), periodic.overlap(4, 5)) == (5, 4)
    with pytest.raises(ValueError):
        periodic.collapse(docs(spark, text), times=3)


def test_runs_survive_sums_that_agree_by_chance(monkeypatch):
    """Blocks of the same length count as equal in a third of all cases: what is found must still be right."""
    honest = periodic.Blocks.equal

    def lying(self, a, b, size):
        return honest(self, a, b, size) | ((a * 7 + b * 3 + size) % 3 == 0)

    monkeypatch.setattr(periodic.Blocks, "equal", lying)
    r = random.Random(9)
    for _ in range(200):
        w = random_words(r)
        values = mix(np.array([ord(x) for x in w], np.uint64))
        s, e, q = periodic.main_lorentz(values, np.array([0]), np.array([len(w)]))
        assert set(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == set(plain_runs(w))


def test_masking_leaves_words_outside_repeats_alone():
    values = mix(np.arange(100, dtype=np.uint64))
    low, high = periodic.segments(values, np.array([0]), np.array([100]), 5)
    assert len(low) == len(high) == 0
    values[40:60] = values[np.arange(20) % 4]
    low, high = periodic.segments(values, np.array([0, 50]), np.array([50, 100]), 5)  # in two documents
    assert list(zip(low.tolist(), high.tolist(), strict=True)) == [(40, 50), (50, 60)]


# Ranked search


def terms_of(text):
    import re

    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain_search(documents, items, k):
    """(item, rank, doc, score): every document scored against every item, with whole numbers."""
    words = [(d, Counter(terms_of(t)), len(terms_of(t))) for d, t in documents]
    n_docs, n_all = sum(n > 0 for *_, n in words), sum(n for *_, n in words)
    holding = Counter(t for _, c, _ in words for t in c)
    wants = {}
    for item, text in dict.fromkeys(items):
        wants.setdefault(item, Counter()).update(terms_of(text))
    out = []
    for item, want in wants.items():
        scored = []
        for d, c, n in words:
            s = sum(times * math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_all))) for t, times in want.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def random_text(r):
    vocabulary = ["the", "The", "of", "é", "x1", "rare", "Süß", "über", *(f"w{i}" for i in range(30))]
    return r.choice([" ", "-", "\n", "_"]).join(r.choices(vocabulary, [30, 10, 20, 5, 5, 1, 1, 2, *[1] * 30], k=r.randint(0, 40)))


@pytest.mark.parametrize(("k", "block", "sent"), [(10, 65_536, 1_000_000), (3, 20, 5)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, block, sent):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SENT", sent)
    r = random.Random(11)
    texts = [None, "", "...", "the the THE", "rare " * 2000, *(random_text(r) for _ in range(150))]
    documents = [(None if i % 29 == 7 else i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (6, texts[9]), (900, texts[9]), (901, texts[9])]
    items = [(0, "the of"), (1, None), (2, "rare rare über"), (2, "rare rare über"), (2, "x1"), (None, "w1 w2 the w3"), (4, "nowhere"), *((i, random_text(r)) for i in range(5, 25))]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in documents], "doc_id long, text string, score int, item int").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(df, wanted, k)) == plain_search(documents, items, k)
    assert lexical.search(df.limit(0), wanted).collect() == lexical.search(df, wanted.limit(0)).collect() == []


def test_shards_are_bounded_and_merged(spark):
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} common") for i in range(500)], "doc_id long, text string").repartition(2)
    small = lexical.postings(df, "doc_id", "text", size=1)
    heads = small.where("term is null").select("ids").collect()
    assert len(heads) >= 2 and sorted(x for h in heads for x in h.ids) == list(range(500)) and all(h.ids == sorted(h.ids) for h in heads)


def test_wand_equals_a_full_sum_and_skips():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            at = np.flatnonzero(rng.random(n) < rng.random() ** 3)
            if len(at):
                lists.append((at.astype(np.int32), rng.integers(0, int(rng.choice([3, 50, 10_000])), len(at))))
        if not lists:
            continue
        total = np.zeros(n, np.int64)
        for at, worth in lists:
            total[at] += worth
        order = np.lexsort((np.arange(n), -total))[:k]
        order = order[total[order] > 0]
        scores, best = lexical.wand(lists, k, stride=int(rng.choice([64, 1024])))
        assert best.tolist() == order.tolist() and scores.tolist() == total[order].tolist()

    class Counted(np.ndarray):
        """An array that counts the places that are looked up."""

        seen = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counted.seen += len(key)
            return super().__getitem__(key)

    n = 100_000
    common = np.ones(n, np.int64).view(Counted)
    rare = np.arange(0, n, 1000)
    lexical.wand([(np.arange(n), common), (rare, np.full(len(rare), 100))], 10)
    assert Counted.seen < n / 20  # once ten rare ones are found, common ones alone are not looked at


# Suffix-array dedup


def test_suffixes_are_sorted_to_the_depth():
    r = np.random.default_rng(1)
    for _ in range(300):
        depth, letters, n = int(r.choice([1, 7, 8, 24, 25, 40, 64])), int(r.choice([1, 2, 4, 256])), int(r.integers(64, 500))
        d = r.integers(0, letters, n).astype(np.uint8)
        for _ in range(int(r.integers(0, 4))):
            size = int(r.integers(0, n))
            i, j = r.integers(0, n - size + 1, 2)
            d[j : j + size] = d[i : i + size].copy()
        starts = r.permutation(n - depth + 1)[: int(r.integers(0, n - depth + 2))]
        order, same = suffix_sort.order(d, starts, depth, int(r.choice([8, 24])))
        strings = [d[x : x + depth].tobytes() for x in starts[order]]
        assert strings == sorted(strings) and sorted(order.tolist()) == list(range(len(starts)))
        assert same.tolist() == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]


def plain_repeats(texts, length):
    """Of each text, the starts whose string starts anywhere else."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    return [[i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1] for x in raw]


def repeating_texts(r, length):
    letter = lambda n, of="abcdefgh": "".join(r.choices(of, k=n))
    shared = [letter(r.randint(length - 2, 3 * length)) for _ in range(3)] + [letter(5) * length, "a" * 2 * length]
    out = [None, "", "short", "z" * (length - 1), "z" * length, "y" * (length + 1), "yz" * length, letter(7) * 40, letter(31) * 6, letter(length) * 3]
    for _ in range(60):
        x = letter(r.randint(0, 60), "abcdefgh é𝄞")
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            cut = r.randint(0, len(p) // 2)
            x += p[cut : len(p) - r.randint(0, cut)] + letter(r.randint(0, 2 * length), "abc é")
        out.append(x)
    return out


@pytest.mark.parametrize(("length", "group", "bits"), [(40, 1024, 1 << 20), (40, 2, 1 << 20), (60, 3, 8), (5, 1024, 1 << 20)])
def test_repeats_equal_counting_all_strings(spark, length, group, bits):
    """In one block, in many (group), by the map of bits and by the join (bits)."""
    texts = repeating_texts(random.Random(length + group), length)
    texts += [texts[20]] * 7 + ["q" + texts[21]] * 3
    made = [(None if i == 30 else 40 if i == 41 else i, t) for i, t in enumerate(texts)] + [(12, texts[12])]
    df = spark.createDataFrame(made, "id long, text string").selectExpr("id", "xxhash64(text) AS hash", "coalesce(text, '') AS text").repartition(3)
    scratch = Scratch(spark)
    found = {}
    for x in suffix_dedup.repeats(df, length, scratch, group, bits).join(df.drop("text").distinct(), ["hash"], "left_semi").collect():
        found.setdefault((x["id"], x["hash"]), set()).update(range(x["low"], x["high"] + 1))
    hashes = [x["hash"] for x in spark.createDataFrame(made, "id long, text string").selectExpr("xxhash64(text) AS hash").collect()]
    for (i, _), h, want in zip(made, hashes, plain_repeats([t for _, t in made], length), strict=True):
        assert found.get((i, h), set()) == set(want)
    scratch.clear()


def test_removed_bytes_and_what_stays(spark):
    texts = repeating_texts(random.Random(4), 40)
    texts += texts[:30]
    df = spark.createDataFrame([(i % 70 if i % 11 else None, t, 1, b"x", "h") for i, t in enumerate(texts)], "doc_id long, text string, bytes int, kept binary, hash string").repartition(2)
    out = suffix_dedup.remove_repeats(df, length=40)
    assert out.columns == ["doc_id", "text", "hash", "removed", "bytes", "kept"]
    want = []
    for i, (t, starts) in enumerate(zip(texts, plain_repeats(texts, 40), strict=True)):
        raw = (t or "").encode()
        gone = sorted({x for s in starts for x in range(s, s + 40)})
        edges = [(a, b + 1) for a, b in zip([x for x in gone if x - 1 not in set(gone)], [x for x in gone if x + 1 not in set(gone)], strict=True)]
        want.append((i % 70 if i % 11 else None, t, edges, len(raw), bytes(c for j, c in enumerate(raw) if j not in set(gone))))
    got = [(x["doc_id"], x["text"], [tuple(s) for s in x["removed"]], x["bytes"], bytes(x["kept"])) for x in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_long_texts_have_the_anchors_of_their_pieces(monkeypatch):
    """Every start has one anchor, in a text of many pieces too, and equal strings have equal ones."""
    r = np.random.default_rng(2)
    data = r.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    for piece in (1 << 21, 256):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        key = {}
        for keys, text, low, high in suffix_dedup.anchors(data, np.array([0, 1500, 1550, 3000]), 50):
            for k, t, a, b in zip(keys.tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
                for s in range(a, b + 1):
                    assert s not in key and [0, 1500, 1550][t] <= s <= [1500, 1550, 3000][t] - 50
                    key[s] = k
        assert sorted(key) == [*range(1451), 1500, *range(1550, 2951)]
        assert all(key[s] == key[s + 1900] for s in range(100, 451))


def test_every_start_has_an_anchor_in_pieces_of_any_size(monkeypatch):
    """Empty and short texts among others, and texts that go on from piece to piece."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        length, n = int(rng.integers(2, 12)), int(rng.integers(1, 9))
        offsets = np.append(0, np.cumsum(rng.integers(0, 30, n) * (rng.random(n) < 0.7)))
        monkeypatch.setattr(suffix_dedup, "PIECE", int(rng.integers(3, 40)))
        got = [(t, s) for _, *x in suffix_dedup.anchors(rng.integers(97, 100, offsets[-1]).astype(np.uint8), offsets, length) for t, a, b in zip(*map(np.ndarray.tolist, x), strict=True) for s in range(a, b + 1)]
        assert sorted(got) == [(t, s) for t in range(n) for s in range(offsets[t], offsets[t + 1] - length + 1)]
