"""Faults that were found once: prefixes that are not rendered, names that clash, chance in labels and batches."""

import numpy as np
from conftest import rows

from reelframe.llm import chat_format, decontaminate, lexical, near_dedup, periodic, queries, secrets, sentencepiece_sampling, suffix_dedup, toxicity
from reelframe.llm.common import slices


def test_the_query_renders_every_prefix_whole(spark, monkeypatch):
    """The default template is given 1, 2, ... turns of each conversation, and what it would rewrite is seen."""
    assert not hasattr(chat_format.marked_turns, "turn_local")
    df = spark.createDataFrame([(c, t, "user", f"text {t}") for c in (1, 2) for t in range(70)], "conv_id long, turn long, role string, text string")
    batches = df.orderBy("conv_id", "turn").toArrow().to_batches()
    seen = []

    def counted(turns):
        seen.append(len(turns))
        return chat_format.marked_turns(turns)

    out = list(chat_format._spans(iter(batches), counted, chat_format.read_back, ("assistant",)))
    assert seen == [*range(1, 71), *range(1, 71)] and sum(b.num_rows for b in out) == 140

    def rewriting(turns):
        return chat_format.marked_turns([(r, t + ("" if i == len(turns) - 1 else "!")) for i, (r, t) in enumerate(turns)])

    real, calls = chat_format.turn_spans, []
    monkeypatch.setattr(chat_format, "turn_spans", lambda conversations, template=chat_format.marked_turns: calls.append(template) or real(conversations, rewriting))
    queries.QUERIES["op2_chat_format"](spark, "/root/testdata/sf0.001").collect()
    assert calls == [chat_format.marked_turns]  # the query gives no other template than the default one, as a black box
    assert real(df, rewriting).where("rewrites").count() == 138


def test_no_name_of_the_callers_clashes(spark):
    names = "_t _runs _base _assign _access _hex _row row found spans items _id _mark _spans mark n_words gram size p_toxic p_poor seen length _key key _bucket low high hash id digest part parts runs collapsed removed bytes kept term docs counts ids shard score rank item".split()
    text = "password=abcdefgh and some more words to make a longer text of it"
    df = spark.createDataFrame([(i, text if i < 3 else None, 5, *[f"v{i}"] * len(names)) for i in range(4)], f"doc_id long, text string, n_chars long, {', '.join(f'{n} string' for n in names)}")
    benchmark = spark.createDataFrame([(1, "other words " * 6)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(3)], "doc_id long, poor int, toxic int")
    chain = toxicity.train(df, labels, toxicity.CATEGORIES)
    for out in (secrets.redact(df), decontaminate.remove(df, benchmark), decontaminate.remove(df, benchmark, "spans"), toxicity.reject_toxic(df, chain)):
        assert out.columns == df.columns
        kept = rows(out.select("doc_id", *names))
        assert kept == rows(df.join(out.select("doc_id"), "doc_id", "left_semi").select("doc_id", *names)) and kept
    for out, added in ((secrets.scan(df), ["found"]), (periodic.collapse(df), ["runs", "collapsed"]), (suffix_dedup.remove_repeats(df), ["removed", "bytes", "kept"]), (sentencepiece_sampling.encode(df), ["pieces", "lossless", "_key"]), (toxicity.score(df, chain), ["p_poor", "p_toxic"])):
        mine = [n for n in names if n not in added]
        assert rows(out.select("doc_id", *mine)) == rows(df.select("doc_id", *mine))
    assert near_dedup.near_duplicates(df).count() == 4 and near_dedup.keep_one(df).count() == 2
    assert secrets.report(df).count() == 4 and lexical.search(df, benchmark).count() >= 0


def test_repeated_labels_count_if_any_says_so(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} " * 5) for i in range(60)], "doc_id long, text string")
    labels = [(i, 0, 0) for i in range(60)] + [(i, 1, i % 2) for i in range(20)]
    a, b = (toxicity.train(df, spark.createDataFrame(x, "doc_id long, poor int, toxic int").repartition(n), toxicity.CATEGORIES) for x, n in ((labels, 1), (labels[::-1], 5)))
    once = [(i, int(i < 20), int(i < 20 and i % 2)) for i in range(60)]
    c = toxicity.train(df, spark.createDataFrame(once, "doc_id long, poor int, toxic int"), toxicity.CATEGORIES)
    got = [rows(toxicity.score(df, x).select("doc_id", "p_poor", "p_toxic")) for x in (a, b, c)]
    assert got[0] == got[1] == got[2]


def test_thresholds_do_not_depend_on_the_batch(spark):
    """Each text's node thresholds alone equal those within a batch, to the bit."""
    import pyarrow as pa

    texts = [r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").where("length(text) > 50").orderBy("doc_id").limit(40).collect()]
    pieces = sentencepiece_sampling.load(sentencepiece_sampling.MODEL, sentencepiece_sampling.ALPHA)

    def lattice(texts):
        _, _, data, offsets = next(slices(pa.array(texts), 1 << 30))
        return sentencepiece_sampling.Lattice(data, offsets, pieces)

    def thresholds(found, part):
        low, high = int(found.begin[part]) + 1, int(found.end[part]) + 1
        out = []
        for node in range(low, high):
            edge = int(found.first[node])
            while np.isfinite(found.forward[node]):  # a node inside a character has no pieces
                out.append((node - low, int(found.ids[edge]), int(found.upto[edge])))
                if found.upto[edge] >= 1 << 62:
                    break
                edge += 1
        return out

    together = lattice(texts)
    for i in (0, 17, 39):
        assert thresholds(together, i) == thresholds(lattice([texts[i]]), 0)


def test_nothing_is_left_but_what_results_are_made_from(spark):
    """Tables that an operator kept go with its result."""
    import gc
    import time
    from pathlib import Path
    from urllib.parse import urlparse

    from reelframe.llm.common import shared_dir
    from reelframe.llm.components import components

    folder = Path(urlparse(shared_dir(spark)).path)

    def there():
        return {str(x) for x in folder.glob("**/rdd-*")} | {str(x) for x in folder.iterdir() if x.name.split("-")[0] in ("anchors", "repeats", "terms", "postings", "archives", "labelled")}

    def settled(low):
        for _ in range(60):
            gc.collect()
            spark._jvm.System.gc()
            if len(there() - before) <= low:
                return True
            time.sleep(0.5)
        return False

    before = there()
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    texts = spark.createDataFrame([(i, "the same words again and again in a text that is long enough to repeat " * 4) for i in range(4)], "doc_id long, text string")
    cleaned = suffix_dedup.remove_repeats(texts)
    found = lexical.search(texts, texts.selectExpr("doc_id as item_id", "text"))
    assert chain.count() == 61 and cleaned.count() == 4 and found.count() == 16
    assert there() > before and all("/rdd-" in x for x in there() - before)  # scratch tables went at once
    del chain, cleaned, found
    assert settled(1)
