"""The pipeline on planted cases, and each stage's decisions against its operator."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from resonarium.llm import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    pools = {"en": ["the", "thing", "ation", "with", "hand", "over"], "de": ["und", "sch", "keit", "über", "zung", "ein"]}
    text = lambda g, n: " ".join(rng.choice(pools[g]) + rng.choice(pools[g]) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de", 80), "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    bench = [(k, text("en", 30)) for k in range(3)]
    rows += [(100, rows[3][1], "en", "s0"), (101, "1234 -- 99", "en", "s0"), (102, None, "de", "s1"), (103, "x " + bench[0][1] + " y", "en", "s2"), (104, text("en", 2000), "en", "s2")]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    all_ids = ids(docs)
    a = corpus_pipeline.language(spark, docs, folder)
    assert all_ids - ids(a) == {101, 102}
    b = corpus_pipeline.near_duplicates(spark, a, folder)
    assert ids(a) - ids(b) == {100}
    c = corpus_pipeline.decontamination(spark, b, folder)
    assert ids(b) - ids(c) == {103}
    d = corpus_pipeline.mix(spark, c, folder)
    assert ids(d) <= ids(c) and all(x.columns == docs.columns for x in (a, b, c, d))
    e = corpus_pipeline.shards(spark, d, folder)
    assert e.select(*docs.columns).exceptAll(d).count() == 0 and e.count() == d.count()
    assert corpus_pipeline.run(spark, folder).count() == e.count()


def test_stages_take_empty_tables_and_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    odd = docs.where("doc_id < 6").unionByName(docs.where("doc_id < 2")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    for table in (docs.where("false"), odd):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, folder)
            assert set(table.columns) <= set(now.columns)
        now.count()


def test_null_and_repeated_ids_are_judged_by_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (3, 5, 7, 103)")
    no_id = F.lit(None).cast("long")
    copy = docs.where("doc_id = 3").withColumn("doc_id", no_id)
    shared = docs.where("doc_id = 5").withColumn("doc_id", F.lit(7).cast("long"))  # 7 twice, with different texts
    a = corpus_pipeline.near_duplicates(spark, docs.where("doc_id != 5").unionByName(copy).unionByName(shared), folder)
    assert sorted((r["doc_id"] for r in a.collect()), key=str) == [103, 3, 7, 7]
    dirty = docs.where("doc_id = 103")
    b = corpus_pipeline.decontamination(spark, docs.unionByName(dirty.withColumn("doc_id", no_id)).unionByName(dirty.withColumn("doc_id", F.lit(3).cast("long"))), folder)
    assert sorted(r["doc_id"] for r in b.collect()) == [3, 5, 7]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "shards"]
    assert len(registry.QUERIES) == 13 and set(registry.SQL) <= set(registry.QUERIES)


def test_extra_columns_of_any_name_travel_along(spark, folder):
    names = ["_lang", "_score", "_nth", "mix_size", "_mix_key", "shard", "_path", "lang_pred", "fp", "component_id", "_pipeline_row"]
    now = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 8").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    table = now
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.columns[: len(table.columns)] == table.columns
    assert now.columns[len(table.columns) :] == ["shard_", "shard_rows", "shard_bytes"]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in now.collect() for n in names)
