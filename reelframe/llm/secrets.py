"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of random strings.

Two first-order Markov models over the bytes of a run of ``[A-Za-z0-9+/_=-]`` are trained from
labelled samples, one on random strings and one on ordinary identifiers. Their bigram log-likelihood
ratios go into one array literal, indexed by the two characters; a run of ``LEAST`` characters or
more whose summed ratio reaches ``THRESHOLD`` is a finding of kind ``markov``. In other runs, which may be
a secret with the path or key around it, each best stretch of ``LEAST`` characters or more that
reaches it is one, widened to the next ``/``, ``=``, ``_`` or ``-`` on both sides. A run or stretch that is a match
of a fixed pattern as a whole is left to that pattern.

All folds over the findings of a text go in groups of ``GROUP``: an array that grows inside a fold is
copied at each step, so that one fold over many findings would take quadratic time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds in order, their patterns, and what a match needs to count.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(g2) >= 6"),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    "hex": (r"[0-9a-f]+", "length(m) >= 24"),
}
#: For kinds whose matches are maximal runs, the same findings with failing runs left out early.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Characters of a run that the models judge; natural logarithm of the odds from which it is random.
LEAST, THRESHOLD = 20, 12.0
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: A whole string that a fixed pattern finds.
FIXED = r"""^(?:(?i:(?:password|passwd|secret|token|api_?key))=[A-Za-z0-9+/_=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,})$"""
#: Findings of a text that are folded at once; code points of the chunks that a text is redacted by.
GROUP, CHUNK = 64, 4096
#: Labelled samples, at most.
ROWS = 20_000

#: Parts of ordinary identifiers in the built-in labelled sample.
PARTS = (
    "account address amount array article available average balance before between boolean buffer button cache calculate category "
    "character client collection column comment common complete component condition configuration connection container content "
    "context control counter country create current customer database date default delete description destination detail "
    "directory document element enabled encoding entry error event example execute export external factory feature field file "
    "filter folder format function general generate global group handler header height history identifier image import index "
    "information initialize input instance integer interface internal invoice item iterator label language layout length level "
    "library license listener location manager maximum measure member memory message method minimum module monitor name network "
    "number object operation option order output package page parameter parent partition pattern payment people position "
    "previous process product profile project property protocol provider public query question reference register remote report "
    "request resource response result schedule schema search section select server service session setting source standard state "
    "status storage stream string structure subject summary system table target template thread timeout title transaction "
    "transform update user validate value variable vector version visible warning width window worker"
).split()


def labelled_samples(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """(text, secret): half random strings (hex, base64, capitals and digits), half identifiers in the usual spellings."""
    n = len(PARTS)
    ids = spark.range(rows // 2)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    random = ids.select(F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, F.substring(packed, 1, 40)).otherwise(F.upper(F.substring(F.regexp_replace(packed, "[+/=]", ""), 1, 24))).alias("text"), F.lit(1).alias("secret"))
    parts = F.array(*map(F.lit, PARTS))
    pick = lambda k: F.element_at(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int") + 1)
    three = [pick(k) for k in range(4)]
    plain = ids.select(
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *three)).when(F.col("id") % 4 == 1, F.concat(three[0], *(F.initcap(x) for x in three[1:]))).when(F.col("id") % 4 == 2, F.upper(F.concat_ws("_", *three[:3]))).otherwise(F.concat_ws("/", *(F.concat_ws("-", x, y) for x, y in zip(three[:2], three[2:], strict=True)))).alias("text"),
        F.lit(0).alias("secret"),
    )
    return random.union(plain)


def train(samples: DataFrame, smooth: float = 0.5, rows: int = ROWS) -> np.ndarray:
    """128 x 128 log-likelihood ratios, random against ordinary, from ``samples`` (text, secret 0/1).

    Bigrams are counted in Spark over the ``rows`` samples whose texts hash lowest, so at most 2 * 128 * 128
    counts reach the driver. Characters beyond ASCII and nulls do not count. No samples: all zeros.
    """
    few = samples.where("text is not null and secret is not null").orderBy(F.xxhash64("text"), "text").limit(rows)
    chars = few.select("secret", F.expr("transform(split(text, ''), x -> ascii(x))").alias("c"))
    pairs = chars.select("secret", F.explode(F.expr("transform(filter(sequence(0, greatest(size(c) - 2, 0)), i -> size(c) > 1), i -> c[i] * 128 + c[i + 1])")).alias("pair"))
    counts = np.zeros((2, 128 * 128))
    for secret, pair, n in pairs.where("pair >= 0 and pair < 16384").groupBy("secret", "pair").count().collect():
        counts[int(secret != 0), pair] = n
    allowed = np.zeros(128, dtype=bool)
    allowed[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
    counts = counts.reshape(2, 128, 128) + smooth * allowed[:, None] * allowed[None, :]
    log = np.log(np.maximum(counts, 1e-300)) - np.log(np.maximum(counts.sum(axis=2, keepdims=True), 1e-300))
    return np.where(allowed[:, None] & allowed[None, :], log[1] - log[0], 0.0)


def ratio(run: str, table: np.ndarray) -> str:
    """SQL for the summed log-likelihood ratio of the characters of ``run`` (an SQL expression of ASCII text)."""
    literal = f"from_json('{json.dumps(np.round(table, 4).reshape(-1).tolist())}', 'array<double>')"
    return f"aggregate(split({run}, ''), struct(0D as s, -1 as last), (a, x) -> struct(a.s + if(a.last < 0, 0D, {literal}[a.last * 128 + ascii(x)]) as s, ascii(x) as last), a -> a.s)"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def before(items: str, weight: Callable[[str], str], join: Callable[[str, str], str], out: Callable[[str, str, str], str], empty: str, frame: Callable[[str, str], str] | None = None, depth: int = 2) -> str:
    """SQL for the array of ``out(x, at, f)`` over ``items``, where at joins the integer weights of all items before x, from 0 on.

    Items are folded in groups of ``GROUP``, and so, ``depth`` times, are the groups' joined weights. ``frame(at, group)`` is a value for
    each group, known as f inside it. ``empty``: the empty array of the results.
    """
    v = {k: f"{k}{depth}" for k in "iokgxafs"}
    fold = lambda group, start, f: (
        f"aggregate({group}, struct({empty} as out, {start} as at), ({v['a']}, {v['x']}) -> struct(concat({v['a']}.out, array({out(v['x'], v['a'] + '.at', f)})) as out, {join(v['a'] + '.at', weight(v['x']))} as at), {v['a']} -> {v['a']}.out)"
    )
    if not depth:
        return fold(items, "0", "")
    groups = f"transform(sequence(0, greatest(size({v['i']}) - 1, 0) div {GROUP}), {v['k']} -> slice({v['i']}, {v['k']} * {GROUP} + 1, {GROUP}))"
    sums = f"transform({v['o']}, {v['g']} -> aggregate({v['g']}, 0, ({v['a']}, {v['x']}) -> {join(v['a'], weight(v['x']))}))"
    starts = before(sums, lambda x: x, join, lambda x, at, f: at, "cast(array() as array<int>)", depth=depth - 1)
    inner = fold(v["g"], f"{v['s']}[{v['k']}]", v["f"])
    if frame:
        inner = _let(v["f"], frame(f"{v['s']}[{v['k']}]", v["g"]), inner)
    each = f"flatten(transform({v['o']}, ({v['g']}, {v['k']}) -> {inner}))"
    return _let(v["i"], items, _let(v["o"], groups, _let(v["s"], starts, each)))


def stretches(run: str, table: np.ndarray) -> str:
    """SQL for the stretches (start, end) of ``run`` that reach ``THRESHOLD``, as characters inside it.

    Of ``LEAST`` characters or more each: w sums the last LEAST - 1 ratios, b is the best sum that ends before
    them (reset at 0), from bs on. A stretch is over where the sum falls by ``THRESHOLD`` below its best; the next begins there.
    """
    k = LEAST - 1
    literal = f"from_json('{json.dumps(np.round(table, 4).reshape(-1).tolist())}', 'array<double>')"
    state = lambda base, w, b, bs, best, p, e, out, full: f"struct({base} as base, {w} as w, {b} as b, {bs} as bs, {best} as best, {p} as p, {e} as e, {out} as out, {full} as full)"
    now_closed = "array(struct(a.p as start, a.e as end))"
    out, full = f"if(size(a.out) < {GROUP}, concat(a.out, {now_closed}), {now_closed})", f"if(size(a.out) < {GROUP}, a.full, concat(a.full, array(a.out)))"
    last = f"if(j - a.base >= {k}, r[j - {k}], 0D)"
    now = f"struct(a.w + r[j] - {last} as w, greatest(a.b + {last}, 0D) as b, if(j - a.base < {k}, a.base, if(a.b + {last} > 0, a.bs, j - {k} + 1)) as bs)"
    total = f"if(j - a.base >= {k} - 1, t.w + t.b, -1e9D)"
    step = f"""case when a.best >= {THRESHOLD}D and {total} < a.best - {THRESHOLD}D then {state("j + 1", "0D", "0D", "j + 1", "0D", "0", "0", out, full)}
        when {total} > a.best then {state("a.base", "t.w", "t.b", "t.bs", total, "t.bs", "j + 2", "a.out", "a.full")}
        else {state("a.base", "t.w", "t.b", "t.bs", "a.best", "a.p", "a.e", "a.out", "a.full")} end"""
    zero = state("0", "0D", "0D", "0", "0D", "0", "0", "cast(array() as array<struct<start:int,end:int>>)", "cast(array() as array<array<struct<start:int,end:int>>>)")
    finish = f"concat(flatten(a.full), a.out, if(a.best >= {THRESHOLD}D, {now_closed}, cast(array() as array<struct<start:int,end:int>>)))"
    walk = f"aggregate(sequence(0, size(r) - 1), {zero}, (a, j) -> {_let('t', now, step)}, a -> {finish})"
    ratios = _let("c", f"transform(filter(split({run}, ''), y -> y != ''), y -> ascii(y))", f"transform(sequence(0, size(c) - 2), i -> {literal}[c[i] * 128 + c[i + 1]])")
    return _let("r", ratios, walk)


def _located(text: str, pattern: str) -> Column:
    """All leftmost matches as (m, start, end), in code points: the pieces between matches tell where each begins."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    pairs = f"zip_with({found}, split({text}, '{quoted}', -1), (m, gap) -> struct(m, gap))"
    items = f"filter({pairs}, x -> x.m is not null)"
    out = lambda x, at, f: f"struct({x}.m as m, {at} + length({x}.gap) as start, {at} + length({x}.gap) + length({x}.m) as end)"
    return F.expr(before(items, lambda x: f"(length({x}.gap) + length({x}.m))", lambda a, b: f"{a} + {b}", out, "cast(array() as array<struct<m:string,start:int,end:int>>)"))


def scan(docs: DataFrame, table: np.ndarray | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: an array of (kind, start, end, m), sorted by start and then by kind as listed, markov last.

    Offsets are code points, the end exclusive. Null texts count as empty. ``table``: ratios from ``train``; by default the
    built-in labelled sample's. A column ``found`` of ``docs`` is replaced. Every row gives one row.
    """
    if table is None:
        table = train(labelled_samples(docs.sparkSession))
    none = "cast(array() as array<struct<m:string,start:int,end:int>>)"
    rest = [c for c in docs.columns if c != "found"]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))  # no name of the caller's can clash
    parts = []
    for order, (kind, (pattern, needs)) in enumerate(KINDS.items()):
        quick = QUICK.get(kind, pattern)
        out = out.withColumn(f"_{kind}", F.when(F.col("_t").rlike(quick), _located("_t", quick)).otherwise(F.expr(none)))
        g2 = "regexp_extract(x.m, '[:=]\\\\x20*[\"\\']?([A-Za-z0-9+/_.=-]+)$', 1)"
        test = needs.replace("g2", g2).replace("length(m)", "length(x.m)")
        parts.append(f"transform(filter(_{kind}, x -> {test}), x -> struct(x.start as start, {order} as ord, '{kind}' as kind, x.end as end, x.m as m))")
    out = out.withColumn("_base", F.expr(f"concat({', '.join(parts)})")).drop(*(f"_{k}" for k in KINDS))
    out = out.withColumn("_runs", F.when(F.col("_t").rlike(RUN), _located("_t", RUN)).otherwise(F.expr(none)))
    before, after = "element_at(split(substring(x.m, 1, y.start), '[/=_-]', -1), -1)", "element_at(split(substring(x.m, y.end + 1), '[/=_-]', -1), 1)"
    inner = f"transform({stretches('x.m', table)}, y -> struct(y.start - length({before}) as start, y.end + length({after}) as end))"
    bounds = f"if({ratio('x.m', table)} >= {THRESHOLD}, array(struct(0 as start, x.end - x.start as end)), {inner})"
    fixed = FIXED.replace("\\", "\\\\")
    runs = f"filter(_runs, x -> not x.m rlike '{fixed}')"
    more = f"flatten(transform({runs}, x -> transform(array_distinct({bounds}), y -> struct(x.start + y.start as start, {len(KINDS)} as ord, 'markov' as kind, x.start + y.end as end, substring(x.m, y.start + 1, y.end - y.start) as m))))"
    more = f"filter({more}, x -> not x.m rlike '{fixed}')"
    out = out.withColumn("found", F.expr(f"transform(array_sort(concat(_base, {more})), x -> struct(x.kind as kind, x.start as start, x.end as end, x.m as m))"))
    return out.select(*(F.col(f"_row.`{c}`") for c in rest), "found")


def listed(found: str) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.expr(f"array_join(transform({found}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) for every row of ``docs``."""
    found = scan(docs.select("doc_id", "text"), table)
    base = "filter(found, x -> x.kind != 'markov')"
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), count("markov"), F.sha2(listed(base), 256).alias("base_sha256"), listed("found").alias("spans"))


def redact(docs: DataFrame, table: np.ndarray | None = None, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings become one.

    The columns stay as they are; ``n_chars``, where it exists, follows the new text. Rows without a
    finding stay untouched, null texts included.
    """
    found = scan(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), table)
    kept = lambda x, at, f: f"if({x}.start < {at}, '', concat(substring({f}.part, {at} - {f}.at + 1, {x}.start - {at}), '{mark}'))"
    # Pieces come from chunks of the text: each substring of the whole would count code points from its start.
    cut = lambda at, n: f"substring(array_join(slice(chunks, {at} div {CHUNK} + 1, ({at} + {n}) div {CHUNK} - {at} div {CHUNK} + 1), ''), {at} % {CHUNK} + 1, {n})"
    part = lambda at, group: f"struct({at} as at, {cut(at, f'greatest(0, array_max(transform({group}, x -> x.end)) - {at})')} as part)"
    pieces = before("found", lambda x: f"{x}.end", lambda a, b: f"greatest({a}, {b})", kept, "cast(array() as array<string>)", part)
    rest = _let("last", "array_max(transform(found, x -> x.end))", cut("last", "(length(text) - last)"))
    merged = _let("chunks", f"regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0)", f"concat(array_join({pieces}, ''), {rest})")
    hit = F.size("found") > 0
    out = found.withColumn("text", F.when(hit, F.expr(merged)).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.when(hit, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
