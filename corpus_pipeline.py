"""A pipeline for training text: language, near-duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents,
which are written as Parquet and read again in between. Stages keep documents
that nothing speaks against: only the decision named at a stage takes rows out.

The second and third stage write every row with a number of its own and join
their decisions by it, so null and repeated doc_ids are judged like any other.
Of near copies the row of the smallest doc_id stays, null last. Extra columns
travel along, whatever their names: stages see them under names of no operator.
Where one is called like a column that the last stage adds, the added one gets
underscores at its end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm import decontaminate, langid, mixing, sharding, simhash
from resonarium.session import Scratch

#: Documents whose language is `und`, or whose distance leaves a lower score than this, are rejected.
LEAST_SCORE = 0.25
ROW = "_pipeline_row"


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def plain_names(stage: Callable) -> Callable:
    """The stage with the documents' further columns under other names while it works."""

    @wraps(stage)
    def run_it(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = {c: c if c in OWN else f"extra{k}" for k, c in enumerate(docs.columns)}
        back = {v: k for k, v in inner.items()}
        out = stage(spark, docs.toDF(*inner.values()), sf_dir)
        return out.toDF(*(back[c] for c in out.columns))

    return run_it


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs, written with a number for each row, so that recomputed tasks see the same ones."""
    return Scratch(spark, name).save(docs.withColumn(ROW, F.monotonically_increasing_id()))


@plain_names
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out("doc_id"))
    judged = langid.predict(docs, langid.profiles(train), names_out=("_lang", "_score"))
    return judged.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


@plain_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(spark, docs, "copies")
    found = simhash.classes(rows, ROW).select(F.col("id").alias(ROW), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", F.xxhash64(*docs.columns).alias("h"), ROW)
    ranked = rows.select(ROW, place.alias("place")).join(found, ROW)
    stays = ranked.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col(f"place.{ROW}").alias(ROW))
    return rows.join(stays, ROW, "left_semi").select(*docs.columns)


@plain_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(spark, docs, "judged")
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW)
    bad = found.where("contaminated").select(F.col("id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(*docs.columns)


@plain_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs, mixing.assign(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs).read()


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: Profiles, fingerprints, positional search and file layout are beyond SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
