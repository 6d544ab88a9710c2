"""Writers that meet, and records that leave out what usually tells them apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from resonarium.llm import sharding, warc

RECORD = "record_id long, kind string, url string, ts long, headers map<string,string>, digest string, body string"


def test_expire_between_a_write_and_its_commit(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    mine, other = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    mine.append(docs.where("doc_id < 40"))
    commit = mine.commit

    def late(shards, base):
        other.expire()
        return commit(shards, base)

    mine.commit = late
    mine.append(docs.where("doc_id >= 40"), rows_each=7)
    mine.compact(target=10_000_000, fanout=2)
    assert mine.read().count() == other.read().count() == 100
    other.expire()
    assert other.read().count() == 100 and len(list((tmp_path / "s" / "data").rglob("*.parquet"))) == len(other.manifest())
    assert not list((tmp_path / "s" / "pending").glob("[!.]*"))


def test_files_that_vanish_are_not_committed(spark, tmp_path):
    docs = spark.range(10).select(F.col("id").alias("doc_id"))
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    store.append(docs)
    written = store._written

    def lost(path):
        out = written(path)
        other.expire(abandoned=-1)  # takes every mark for one of a dead writer
        return out

    store._written = lost
    with pytest.raises(sharding.Expired):
        store.append(docs)
    assert store.read().count() == 10 and store.versions() == [1]


def test_responses_without_an_id(spark):
    rows = [
        (None, "response", "http://x.org/a", 10, {"etag": '"a"'}, None, "body a"),
        (None, "response", "http://x.org/b", 10, {"etag": '"b"'}, None, "body b"),
        (None, "response", "http://x.org/a", 20, {"etag": '"c"'}, "d", "body c"),
        (1, "revisit", "http://x.org/a", 15, {"etag": '"a"'}, None, None),
        (2, "revisit", "http://x.org/b", 15, {"etag": '"b"'}, None, None),
        (3, "revisit", "http://x.org/a", 25, {"etag": '"c"'}, None, None),
        (None, "revisit", "http://x.org/b", 30, {"etag": '"z"'}, None, None),
        (None, "revisit", "http://x.org/b", 5, {}, None, None),
        (None, "revisit", None, 5, {}, None, None),
    ]
    got = sorted((r["record_id"] or 0, r["status"], r["body"] or "") for r in warc.resolve(spark.createDataFrame(rows, RECORD)).collect())
    assert got == [(0, "mismatch", ""), (0, "unresolved", ""), (0, "unresolved", ""), (1, "resolved", "body a"), (2, "resolved", "body b"), (3, "resolved", "body c")]


def test_many_records_of_one_time(spark):
    rows = [(k, "response" if k % 5 == 0 else "revisit", "http://x.org/", 7, {"etag": f'"{k // 5}"'}, None, f"b{k}" if k % 5 == 0 else None) for k in range(4000)]
    rows += [(None, "response", "http://x.org/", 7, {"etag": '"none"'}, None, "bn"), (5000, "revisit", "http://x.org/", 3, {}, None, None), (5001, "revisit", "http://x.org/", 9, {"etag": '"799"'}, None, None)]
    table = spark.createDataFrame(rows, RECORD)
    cuts = warc.time_cuts(table, 64)
    assert warc.sliced(table, cuts).where("ts = 7").select("slice").distinct().count() > 100
    got = {r["record_id"]: (r["status"], r["body"]) for r in warc.resolve(table, 64).collect()}
    want = {k: ("resolved", f"b{k // 5 * 5}") for k in range(4000) if k % 5} | {5000: ("unresolved", None), 5001: ("resolved", "b3995")}
    assert got == want
