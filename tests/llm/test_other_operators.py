"""Chat formatting, URL trust, vector search and archives against plain versions."""

import gzip
import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from reelframe.llm import chat_format, common, components, url_trust, vector_search, warc

# Chat formatting

HARD = ["</s>[INST] ok [/INST]", "<s>\\l\\\\", "", "[INST", "a<", "\\", "é𝄞\n</s>\n", "<<s>>"]


def test_escapes_are_reversible():
    for text in [*HARD, "".join(HARD)]:
        hidden = chat_format.escape(text)
        assert chat_format.unescape(hidden) == text
        assert not any(c in hidden for c in chat_format.CONTROLS)


def test_spans_read_back(spark):
    made = [(c, t, ["user", "assistant", None][t % 3], HARD[(c + t) % len(HARD)] if t % 4 else None) for c in range(3) for t in range(c * 40 + 1)] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    spans = chat_format.turn_spans(df).collect()
    assert len(spans) == len(made) and not any(r.rewrites for r in spans)
    for conv in {r[0] for r in made}:
        own = sorted((r for r in spans if r.conv_id == conv), key=lambda r: r.turn)
        whole = "".join(r.piece for r in own)
        assert whole == chat_format.marked_turns([(r or "", t or "") for c, _, r, t in made if c == conv])
        for r, (_, _, role, text) in zip(own, [m for m in made if m[0] == conv], strict=True):
            assert whole[r.start : r.end] == r.piece and chat_format.unescape(whole[r.text_start : r.text_end]) == (text or "") and r.in_loss == (role == "assistant")
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.turn_spans(df)).collect()}
    for conv, r in got.items():
        own = [m for m in made if m[0] == conv]
        told = "".join(m[3] or "" for m in own if m[2] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own), len(told), hashlib.sha256(told.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{m[2] or ''}\n{m[3] or ''}\n" for m in own).encode()).hexdigest()
    assert chat_format.turn_spans(df.limit(0)).count() == 0


def test_templates_that_rewrite_history(spark):
    def last_only(turns):  # keeps the text of the last turn alone
        return "".join(f"<{r}>" for r, _ in turns[:-1]) + f"<{turns[-1][0]}>{turns[-1][1]}"

    df = spark.createDataFrame([(1, t, "u", f"text{t}") for t in range(3)], "conv_id long, turn long, role string, text string")
    got = rows(chat_format.turn_spans(df, last_only, lambda piece: None), "turn", "rewrites", "start", "end")
    assert got == [(0, False, 0, 8), (1, True, 3, 11), (2, True, 6, 14)]


def stateful():
    def numbered(turns):
        return "".join(f"{i}:{r}:{t};" for i, (r, t) in enumerate(turns))

    def prompt_in_newest(turns):
        newest = max(i for i, (r, _) in enumerate(turns) if r == "user")
        return "".join(f"{r}:{turns[0][1] + '|' if i == newest else ''}{t};" for i, (r, t) in enumerate(turns))

    def alternating(turns):
        if any(r != ("user", "assistant")[i % 2] for i, (r, _) in enumerate(turns)):
            raise ValueError("roles must alternate")
        return "".join(f"<{t}>" for _, t in turns)

    def first_late(turns):  # the hundredth turn changes the first
        return "".join(f"<{'late' if len(turns) > 99 and not i else t}>" for i, (_, t) in enumerate(turns))

    return {f.__name__: f for f in (numbered, prompt_in_newest, alternating, first_late)}


@pytest.mark.parametrize("name", ["numbered", "prompt_in_newest", "alternating", "first_late"])
def test_long_conversations_with_stateful_templates(spark, name):
    template = stateful()[name]
    turns = [(("user", "assistant")[t % 2], f"text{t}") for t in range(150)]
    df = spark.createDataFrame([(1, t, *x) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    want, before = [], ""
    for t in range(len(turns)):
        now = template(turns[: t + 1])
        kept = next((i for i, (x, y) in enumerate(zip(before, now)) if x != y), min(len(before), len(now)))
        want.append((t, kept, len(now), not now.startswith(before), now[kept:]))
        before = now
    got = chat_format.turn_spans(df, template, lambda piece: None).orderBy("turn").collect()
    assert [(r.turn, r.start, r.end, r.rewrites, r.piece) for r in got] == want


def test_folds_are_prefix_renderings(spark):
    turns = [(("user", "assistant")[t % 2], f"text{t}") for t in range(200)]
    df = spark.createDataFrame([(c, t, *x) for c in (1, 2) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    fold = chat_format.Fold(lambda: 0, lambda n, role, text: (n + 1, f"{n}:{role}:{text};"))
    columns = ("conv_id", "turn", "role", "start", "end", "rewrites", "piece")
    assert rows(chat_format.turn_spans(df, fold, lambda piece: None), *columns) == rows(chat_format.turn_spans(df, stateful()["numbered"], lambda piece: None), *columns)


# URL trust


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.COM/en/70?x#y", "https://b.example.com/en/1", "ftp://example.net/de/8", "x.net/de/", None, "http://com/en/", "http://host.org?/es/", "a://b://c/d", "http://x.notcom/en/", "https://y.org/es/1#z"]
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_trust.judge(df).collect()}
    want = [("a.example.com", "/en/70", "example.com/en/7"), ("b.example.com", "/en/1", "com/en/"), ("example.net", "/de/8", "example.net/de/8"), ("", "", None), ("", "", None), ("com", "/en/", "com/en/"), ("host.org", "", None), ("b:", "//c/d", None), ("x.notcom", "/en/", None), ("y.org", "/es/1", "org/es/")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    assert [got[i].verdict for i in (0, 1, 2, 3, 5, 9)] == ["allow", "block", "allow", "allow", "block", "block"]
    assert url_trust.judge(df.limit(0)).count() == 0


ROUNDS = 10


def test_propagation_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    links = {(int(a), int(b)): float(n) for a, b, n in zip(rng.integers(0, 12, 40), rng.integers(0, 12, 40), rng.integers(1, 5, 40), strict=True) if a != b}
    seeds = {i: (float(i % 3 == 0), float(i % 4 == 1)) for i in range(12)}

    def rank(way, seed):
        mass = dict(seed)
        out = {a: sum(n for (x, _), n in way.items() if x == a) for a, _ in way}
        for _ in range(ROUNDS):
            new = {i: 0.15 * seed.get(i, 0) for i in range(12)}
            for i, m in mass.items():
                if i not in out:
                    new[i] += 0.85 * m
            for (a, b), n in way.items():
                new[b] += 0.85 * mass.get(a, 0) * n / out[a]
            mass = new
        return mass

    trust = rank(links, {i: s[0] for i, s in seeds.items()})
    distrust = rank({(b, a): n for (a, b), n in links.items()}, {i: s[1] for i, s in seeds.items()})
    got = url_trust.propagate(spark.createDataFrame([(str(a), str(b), n) for (a, b), n in links.items()], "src string, dst string, n double"), spark.createDataFrame([(str(i), *s) for i, s in seeds.items()], "host string, trusted double, blocked double"), tolerance=0, rounds=ROUNDS)
    for r in got.collect():
        assert np.isclose(r.trust, trust[int(r.host)]) and np.isclose(r.distrust, distrust[int(r.host)])


def test_links_to_bad_hosts_spread_distrust(spark):
    page = '<a href="https://bad.evil.com/x">'
    made = [(i, f"http://farm.io/{i}", page * 3) for i in range(4)] + [(9, "http://fine.io/", '<a href="/x"><A HREF=//good.dev>')] + [(20 + i, f"http://bad.evil.com/en/{i}", None) for i in range(9)] + [(50, "http://bad.evil.com/fr/", "")]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_trust.judge(df).collect()}
    assert got[0] == got[50] == "block" and got[9] == "allow"


def test_links_keep_user_and_port(spark):
    made = [(i, f"http://u@shop.dev:8080/{i}", "") for i in range(3)] + [(10 + i, f"http://all.com/en/{i}", '<a href="http://u@Shop.dev:8080/0">') for i in range(3)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    links = rows(url_trust.host_links(url_trust.ruled(pages).select("host", "html")))
    assert links == [("all.com", "u@shop.dev:8080", 3.0)]


def test_rounds_end_when_little_moves(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("a", 4.0, 0.0), ("c", 0.0, 4.0)], "host string, trusted double, blocked double")
    few, many = ({r.host: (r.trust, r.distrust) for r in url_trust.propagate(links, seeds, tolerance=t, rounds=99).collect()} for t in (0.01, 1e-3))
    assert set(few) == set(many) and all(np.allclose(few[h], many[h], atol=0.2) for h in few)
    assert all(sum(x[0] for x in f.values()) == pytest.approx(4, abs=1e-6) for f in (few, many))
    assert np.isclose(sum(x[0] for x in many.values()), 4) and np.isclose(sum(x[1] for x in many.values()), 4)
    assert url_trust.propagate(links, seeds.limit(0)).count() == 0


def test_verdicts_of_small_hosts(spark):
    """Small hosts far from a seed, beside a host with most of the mass; and hosts just at the threshold, as the SQL has them."""
    import duckdb

    from reelframe.llm.queries import ORACLE_SQL

    urls = [("http://big.org/es/1", "")] * 1000 + [("http://bad.com/en/1", "")] * 3
    urls += [(f"http://h{i}.io/", f'<a href="//{f"h{i - 1}.io" if i else "bad.com"}/">') for i in range(9)]
    urls += [(f"http://tie{s}.com/{'en/' if i < s else ''}", "") for s in range(1, 25) for i in range(5 * s)]
    pages = [(i, *x) for i, x in enumerate(urls)]
    got = {r.page_id: r.verdict for r in url_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert got == {r[0]: r[4] for r in db.execute(ORACLE_SQL["op5_url_trust"]).fetchall()}
    assert got[1003 + 8] == "block"  # the last of the chain keeps what reaches it


# Vector search


@pytest.mark.parametrize("lists", [1000, 30])
def test_recall_and_ties(spark, monkeypatch, lists):
    monkeypatch.setattr(vector_search, "LIST", lists)
    monkeypatch.setattr(vector_search, "PART", 64)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((600, 12)) + 3 * rng.standard_normal((8, 12))[rng.integers(0, 8, 600)]).astype(np.float32)
    x[100:160] = x[100]  # copies
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] + [1.0] * 11), (1060, [None] + [1.0] * 11), (1080, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist())] + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in vector_search.search(df, F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        score = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:10]
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert all(np.isclose(s, score[i], rtol=1e-12) for _, i, s in found) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({f[1] for f in found} & set(best))
    assert hit / (10 * len(got)) >= 0.95


def test_recall_on_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    table = e.orderBy("vec_id").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    got = {}
    for r in vector_search.search(e, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        hit += len(found & {int(v) for v in [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:20]})
        assert len(found) == 20
    assert len(got) == sum(ids % 20 == 0) and hit / (20 * len(got)) >= 0.95


def test_double_vectors_and_other_lengths(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((50, 6)) * 1e150  # beyond single precision
    more = [(100, [1.0] * 7), (120, [2.0]), (140, None), (160, [0.0] * 6), (180, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + more, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in vector_search.search(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40}
    for q, found in got.items():
        score = x @ x[q]
        assert [v for _, v, _ in sorted(found)] == [int(i) for i in np.argsort(-score) if i != q][:5]
        assert all(np.isclose(s, score[v], rtol=1e-12) for _, v, s in found)
    assert rows(vector_search.left_out(df), "id", "reason") == sorted([(100, "length"), (120, "length"), (140, "no vector"), (160, "zero"), (180, "not finite"), (None, "no id")], key=repr)


def test_lists_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "LIST", 10)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((4000, 8)) + 9 * rng.standard_normal((100, 8))[rng.integers(0, 100, 4000)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max())) * 1.000001
    index = vector_search.fit(df, len(x), norm, 256)
    assert 300 <= len(index.centroids) <= 500 and len(index.ids) == 256
    near = index.nearest(index.turned(x))
    assert np.bincount(near).max() < 200


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = rows(vector_search.search(df, F.col("id") % 20 == 0), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 0, -1.0)]
    assert vector_search.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


# Archives


def test_archives_read_back(spark):
    long, other = "é" * 600, "b" * 2000
    html = [long, long, None, "", "short", "short", other, long, "x\r\n\r\nWARC/1.1\r\nfake" * 90, other]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\n x", h, "c") for i, h in enumerate(html)] + [(None, None, long, "c")], "page_id long, url string, html string, digest string")
    path = warc.write_archives(df)
    got = warc.read_archives(spark, path).collect()
    assert not [r for r in got if r.kind == "gap"] and len(got) == len(html) + 1
    for r in got:
        i = r.record_id[10:-1]
        body = (html[int(i)] if i else long) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), hashlib.sha1(body.encode()).hexdigest())
        same = [j for j, h in enumerate(html) if h == body]
        want = ("revisit", f"<urn:page:{max(same)}>") if len(body.encode()) >= 1000 and i != str(max(same)) else ("response", None)
        assert (r.kind, r.refers_to) == want
        assert r.payload == (b"" if r.kind == "revisit" else body.encode())
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def record(name, body):
    digest = hashlib.sha1(body).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{name}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_salvage(pack):
    parts = [pack(record(i, bytes([65 + i]) * (50 + i))) for i in range(6)]
    names = lambda data: [x.fields["warc-record-id"] if isinstance(x, warc.Record) else (x.start, x.end) for x in warc.salvage(data)]
    whole = b"".join(parts)
    assert names(whole) == [f"<urn:{i}>" for i in range(6)]
    at = [sum(map(len, parts[:i])) for i in range(7)]
    broken = bytearray(whole)
    broken[at[2] + len(parts[2]) - 20] ^= 1
    assert names(bytes(broken)) == ["<urn:0>", "<urn:1>", (at[2], at[3]), "<urn:3>", "<urn:4>", "<urn:5>"]
    lost = whole[: at[1]] + b"junk" * 9 + whole[at[1] : at[4] + 30]
    assert names(lost) == ["<urn:0>", (at[1], at[1] + 36), "<urn:1>", "<urn:2>", "<urn:3>", (at[4] + 36, len(lost))]
    assert names(b"") == [] and names(b"\x00" * 100) == [(0, 100)]


def test_damaged_archives_of_any_name(spark, tmp_path):
    rng = np.random.default_rng(2)
    parts = [record(i, rng.bytes(3000)) for i in range(6)]
    damaged = bytearray(parts[2])
    damaged[-100] ^= 1
    one = gzip.compress(b"".join([*parts[:2], bytes(damaged), *parts[3:]]))
    short = gzip.compress(b"".join(parts))
    (tmp_path / "more").mkdir()
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "more" / "b.warc.gz").write_bytes(one)
    (tmp_path / "more" / "c.warc.gz").write_bytes(short[: len(short) * 3 // 4])
    (tmp_path / "d.warc.gz").write_bytes(short[: len(short) * 3 // 4] + gzip.compress(parts[5]))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = {}
    for r in warc.read_archives(spark, str(tmp_path)).orderBy("path", "start").collect():
        found.setdefault(r.path.split("/")[-1], []).append(r.record_id or r.kind)
    names = [f"<urn:{i}>" for i in range(6)]
    assert found["a.warc"] == names
    assert sorted(found["b.warc.gz"]) == sorted([*names[:2], "gap", *names[3:]])
    assert sorted(found["c.warc.gz"]) == sorted([*names[:4], "gap"])
    assert sorted(found["d.warc.gz"]) == sorted([*names[:4], "gap", names[5]])
    assert set(found) == {"a.warc", "b.warc.gz", "c.warc.gz", "d.warc.gz"}


def test_salvage_of_damaged_archives_of_pages(spark, tmp_path):
    """A damaged copy of the archives of real pages: all other records come back, and the gaps cover what was damaged."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    whole = {r.record_id: r for r in warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "whole"))).collect()}
    assert len(whole) == pages.count() and not any(r.kind == "gap" for r in whole.values())
    rng = np.random.default_rng(6)
    hurt, spoiled = set(), []
    for n, (name, own) in enumerate(sorted({p: [r for r in whole.values() if r.path == p] for p in {r.path for r in whole.values()}}.items())):
        data = bytearray(open(name.removeprefix("file:"), "rb").read())
        for r in rng.choice(np.arange(len(own)), max(1, len(own) // 9), replace=False):
            at = own[r].end - 20 if own[r].kind != "revisit" else own[r].start + 2
            data[at] ^= 0x40
            hurt.add(own[r].record_id)
            spoiled.append((n, own[r].start, own[r].end))
        (tmp_path / "hurt").mkdir(exist_ok=True)
        (tmp_path / "hurt" / f"{n:03d}.warc").write_bytes(bytes(data))
    back = warc.read_archives(spark, str(tmp_path / "hurt")).collect()
    records = {r.record_id: (r.kind, r.payload_digest, r.payload_bytes, r.refers_to) for r in back if r.kind != "gap"}
    assert records == {k: (r.kind, r.payload_digest, r.payload_bytes, r.refers_to) for k, r in whole.items() if k not in hurt}
    gaps = [(int(r.path.split("/")[-1][:3]), r.start, r.end) for r in back if r.kind == "gap"]
    assert all(r.reason for r in back if r.kind == "gap")
    assert all(any(g[0] == n and g[1] <= start and end <= g[2] for g in gaps) for n, start, end in spoiled)
    assert sum(e - s for _, s, e in gaps) == sum(e - s for _, s, e in spoiled)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "SIZES", (1 << 12, 1 << 14))
    made = [(i, "http://h/", "x" * n + str(i)) for i, n in enumerate([10, 3000] * 20 + [10_000] * 9 + [200_000, 300_000])]
    path = warc.write_archives(spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    sizes = [p.stat().st_size for p in (tmp_path / "a").rglob("part-*")]
    assert max(sizes) < 310_000 and sum(s > 1 << 17 for s in sizes) == 2
    assert warc.read_archives(spark, path).where("kind = 'response'").count() == len(made)
    assert len(list(warc.salvage(gzip.compress(b"\0" * 1000)))) == 1


def test_members_of_any_size_are_read_through_a_window():
    """A record, 128 MB of damage, a record of 3 MB and a thousand small ones, in one member: all are found, in a fraction of that memory."""
    import tracemalloc

    small = b"".join(record(i, b"c" * 500) for i in range(10, 1010))
    data = gzip.compress(record(1, b"a" * 100) + b"\0" * (1 << 27) + record(2, b"x" * (3 << 20)) + small, 1) + record(3, b"b")
    tracemalloc.start()
    names, gaps = [], []
    for x in warc.salvage(data):
        (names if isinstance(x, warc.Record) else gaps).append(x.fields["warc-record-id"] if isinstance(x, warc.Record) else (x.start, x.reason[:30]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names == [f"<urn:{i}>" for i in (1, 2, *range(10, 1010), 3)] and len(gaps) == 1
    assert peak < 60 << 20


def test_a_length_that_is_wrong_holds_nothing_back():
    """A block longer than the rest of its member is damage at once; records after it are found."""
    wrong = record(1, b"a" * 100).replace(b"Content-Length: 1", b"Content-Length: 91", 1)
    data = gzip.compress(wrong + record(2, b"b") + b"WARC/1.0\r\nno head")
    found = list(warc.salvage(data))
    assert [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)] == ["<urn:2>"]
    assert len([x for x in found if isinstance(x, warc.Gap)]) == 2


# Shared helpers


def test_the_shared_folder_is_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())



def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        above[max(p, q)] = min(p, q)
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(root(n) == c for n, c in got.items()) and {a for e in edges for a in e if e[0] != e[1]} == set(got)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_cover_every_row():
    import pyarrow as pa

    column = pa.array(["aa", None, "", "b" * 50, "c", "é"])
    for part in (column, column.slice(2), column.slice(5)):
        back = []
        for first, end, data, offsets in common.slices(part, 8):
            assert first == len(back)
            back += [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(end - first)]
        assert back == [x or "" for x in part.to_pylist()]
