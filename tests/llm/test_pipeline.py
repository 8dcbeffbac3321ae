"""The pipeline against plain versions of its stages, and the entry module without the subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_hits, plain_spans

from reelframe.llm import common, toxicity

ROOT = Path(__file__).resolve().parents[2]
SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    kept = {}
    current = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = common.cut(stage(spark, current, SF))
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in current.collect()}
    everything = {r.doc_id: r.text for r in d.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    first, second, third, fourth = kept.values()
    toxic = {r.doc_id for r in labels if r.toxic}
    assert len(toxic - set(first)) > 0.7 * len(toxic) and len({r.doc_id for r in labels if not r.toxic} - set(first)) <= 2
    assert all(everything[i] == t for i, t in first.items())
    assert set(second) == {c for _, c in brute_components(first).values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(third) == {i for i, h in brute_hits(second, items).items() if not h[4]}
    assert set(fourth) == set(third) and not any(plain_spans(t) for t in fourth.values())
    assert all(fourth[i] == third[i] for i in third if not plain_spans(third[i]) and "<SECRET>" not in fourth[i])
    last = corpus_pipeline.STAGES[-1][1](spark, current, SF).collect()
    assert {r.doc_id for r in last} == set(fourth) and all(r.lossless for r in last)
    assert toxicity.CUT < 0.5


def test_run_is_the_stages_one_after_the_other(spark):
    current = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = common.cut(stage(spark, current, SMALL))
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == current.columns
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.collect()), key=repr)
    assert plain(got) == plain(current) and got.count() > 50


def test_run_over_odd_tables(spark, tmp_path):
    """Empty tables, null texts and ids, repeated rows and an extra column go through all stages."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("pieces", F.lit("clash"))
    tables = {"documents": docs, "labels": spark.read.parquet(f"{SMALL}/labels.parquet"), "benchmark": spark.read.parquet(f"{SMALL}/benchmark.parquet")}
    for name, df in tables.items():
        df.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    few = docs.orderBy("doc_id").limit(20)
    odd = few.union(few.limit(3)).union(few.limit(2).withColumn("text", F.lit(None).cast("string"))).union(few.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    tables["labels"].limit(0).write.parquet(f"{tmp_path}/odd/labels.parquet")
    tables["benchmark"].write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert got and all(r.lossless for r in got)
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert len(named) == len(set(named))


def test_entry_without_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'agg01_bandwidth' in q and not [n for n in q if n.startswith('op')]; print(len(q), len(e.oracle_sql()))"
    for name in ("reelframe", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "reelframe").mkdir()
    for p in (ROOT / "reelframe").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "reelframe" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
