"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language_id, lexical, near_dedup, periodic, secrets, sentencepiece_sampling, suffix_dedup, toxicity, url_trust, vector_search, warc
from .common import Scratch, cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities and whether it is rejected."""
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxicity.chain_labels(table(spark, sf_dir, "labels")), toxicity.CATEGORIES)
    marked = toxicity.score(documents(spark, sf_dir, "doc_id", "text"), chain)
    return marked.select("doc_id", *(f"p_{c}" for c in toxicity.CATEGORIES), (F.col("p_toxic") >= toxicity.CUT).alias("toxic"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir, "doc_id", "text"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


_OP8_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE_SQL["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_OP8_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_OP8_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0))),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT DISTINCT p.doc_id, p.i, p.k, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS sh FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document's sampled pieces: how many, a digest of the ids in order, and whether they decode to the text."""
    coded = sentencepiece_sampling.encode(documents(spark, sf_dir, "doc_id", "text"))
    ids = F.array_join(F.coalesce("pieces", F.array().cast("array<int>")), ",")
    return coded.select("doc_id", F.coalesce(F.size(F.coalesce("pieces", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("pieces_sha256"), "lossless")


@query
def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark)
    archives.paths.append(warc.write_archives(table(spark, sf_dir, "pages")))
    found = cut(warc.read_archives(spark, archives.paths[0], payloads=False))
    archives.clear()
    return found.where("kind in ('response', 'revisit')").select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


ORACLE_SQL["op10_warc_salvage"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM m
"""


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digests(chat_format.turn_spans(rows.union(more))).drop("rewrites")


ORACLE_SQL["op2_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(escaped + length(role) + 21) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = language_id.dictionaries(docs.where(~language_id.held_out()))
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(rows, known).drop("text")


@query
def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge(table(spark, sf_dir, "pages"))


#: The same sums in 60 rounds, with a host ``*`` that hands out the seeds in each; the query ends its rounds when little moves.
ORACLE_SQL["op5_url_trust"] = r"""
WITH RECURSIVE a AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(u, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(u, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT p.page_id, p.host, p.path, p.html, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS said FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL),
own AS (SELECT host, count(*) AS n, count_if(said = 'allow') AS trusted, count_if(said = 'block') AS blocked FROM m WHERE host <> '' GROUP BY 1),
x AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/"''?#\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM m),
links AS (SELECT src, dst, count(*) AS n FROM x WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT src AS host FROM links UNION SELECT dst FROM links UNION SELECT host FROM own),
parts AS (SELECT host, string_split(host, '.') AS w FROM hosts),
chain AS (SELECT DISTINCT array_to_string(w[i:], '.') AS low, array_to_string(w[i + 1:], '.') AS up FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) > 2)),
family AS (SELECT low, up, coalesce(own.n, 1) AS n FROM chain LEFT JOIN own ON own.host = low),
l AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM links UNION ALL SELECT low, up, n FROM family UNION ALL SELECT up, low, n FROM family) GROUP BY 1, 2),
ways AS (SELECT true AS good, src AS host, dst AS far, CAST(n AS DOUBLE) AS n FROM l UNION ALL SELECT false, dst, src, n FROM l),
seeds AS (SELECT true AS good, host, CAST(trusted AS DOUBLE) AS seed FROM own WHERE trusted > 0 UNION ALL SELECT false, host, blocked FROM own WHERE blocked > 0),
ends AS (SELECT good, far AS host FROM ways UNION SELECT good, host FROM seeds),
every AS (SELECT * FROM ways UNION ALL SELECT good, host, host, 1 FROM ends WHERE NOT EXISTS (SELECT 1 FROM ways w WHERE w.good = ends.good AND w.host = ends.host)),
t AS MATERIALIZED (SELECT good, host, far, 0.85 * n / sum(n) OVER (PARTITION BY good, host) AS share FROM every UNION ALL SELECT good, '*', host, 0.15 * seed FROM seeds UNION ALL SELECT true, '*', '*', 1 UNION ALL SELECT false, '*', '*', 1),
r AS (SELECT 0 AS i, good, host, seed AS mass FROM seeds UNION ALL SELECT 0, true, '*', 1.0 UNION ALL SELECT 0, false, '*', 1.0
UNION ALL SELECT r.i + 1, t.good, t.far, sum(r.mass * t.share) FROM r JOIN t ON t.good = r.good AND t.host = r.host WHERE r.i < 60 GROUP BY ALL),
bad AS (SELECT own.host FROM own LEFT JOIN r ON r.host = own.host AND r.i = 60 GROUP BY own.host, own.n HAVING coalesce(sum(CASE WHEN r.good THEN -r.mass ELSE r.mass END), 0) / own.n >= 0.2)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""


@query
def op6_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def _planted(doc_id: str, text: str) -> Column:
    """The text with its words from a on repeating with period p, for the tenth of documents that the contract names; else the text."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    a, p, n = a.cast("int"), p.cast("int"), n.cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & F.col(doc_id).isNotNull() & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col(text))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: how many runs, the one with most repetitions, and digests of all runs and of the words that stay."""
    found = periodic.collapse(documents(spark, sf_dir, "doc_id", "text").select("doc_id", _planted("doc_id", "text").alias("text")))
    top = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


ORACLE_SQL["op13_periodic_runs"] = r"""
WITH h AS (SELECT doc_id, text, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS BIGINT) AS h FROM documents),
w AS (SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM h),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM p),
o AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM t),
m AS (SELECT l.doc_id, r.i - l.i AS q, l.i, l.i - row_number() OVER (PARTITION BY l.doc_id, r.i - l.i ORDER BY l.i) AS island FROM o l JOIN o r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i AND 4 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY 1),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM o ANTI JOIN d USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op12_wand_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


_OP12_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE_SQL["op12_wand_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_OP12_TERMS}, []) AS w FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_OP12_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
g AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
t AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS MATERIALIZED (SELECT row, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * g.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, g GROUP BY term, g.n),
s AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST(75 * f.n * g.n AS BIGINT) // CAST(g.l AS BIGINT))))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: bytes, removed bytes, maximal removed runs, and a digest of the bytes that stay."""
    found = suffix_dedup.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.col("bytes").alias("n_bytes"), (F.col("bytes") - F.length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 200 bytes as 400 hexadecimal digits.
ORACLE_SQL["op11_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(length(x) // 2 - 199)) AS i FROM d)),
t AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
m AS (SELECT r, i, i - lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) > 200 AS fresh FROM s SEMI JOIN t USING (h)),
g AS (SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS g FROM m),
p AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
l AS (SELECT r, list(a ORDER BY a) AS low, list(b ORDER BY a) AS high FROM p GROUP BY r),
k AS (SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(len(low), 0) AS n_spans, array_to_string(list_transform(list_zip(list_prepend(0, coalesce(high, [])), list_append(coalesce(low, []), length(x) // 2)), lambda c: substr(x, 2 * c[1] + 1, 2 * (c[2] - c[1]))), '') AS kept FROM d LEFT JOIN l USING (r))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_bytes - length(kept) // 2 AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
