"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a pseudo-random key from its id. Within a source the order
of keys is the order of the mix; its range is split into buckets of equal
width, whose word counts are summed and prefix-summed, so a source of any size
is spread over thousands of ranges. Only the one bucket in which a source's
budget ends is sorted. What goes back to the documents is one row a source:
how many whole epochs it runs and the exact place of its cut.

Defined results: a null text has size 0; null is a source of its own, ordered
last; targets stop at `most_epochs` times their source's size; documents alike
in id and size (repeated rows) that share the place of the cut split what is
left evenly, rounding down; a source without words takes none; further columns
are kept by `assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resonarium.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: Hex digits of the key that number the ranges of a source: 16**3 ranges.
RANGE_DIGITS = 3
#: Sources up to which their table of cuts is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(ident: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))


def targets(sources: DataFrame, weights: list[float], share: float, most_epochs: int) -> DataFrame:
    """Adds target: min(most_epochs x size, level x weight), where the level makes targets sum to share x all sizes."""
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w.cast("double"))
    rows = rows.withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    rows = rows.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = F.col("cap") * (F.col("weights") - F.col("gone")) <= F.col("weight") * (F.col("total") - F.col("caps"))
    rows = rows.withColumn("capped", capped)
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.col("weights") - F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(every)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * left / free)).select("source", "source_size", "target")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (3, 1, 2), share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken added: the words the mix takes of each row, repeats counted."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    named = docs.select("*", size_of(F.col(text_col)).alias("mix_size"), key_of(F.col(id_col)).alias("_mix_key"))
    sized = scratch.save(named.select(F.col(source_col).alias("source"), F.col("mix_size").alias("size"), F.col("_mix_key").alias("key")))
    ranges = scratch.save(sized.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("words")))
    aims = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), [float(x) for x in weights], share, most_epochs)
    budget = F.floor("target").cast("long")
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    aims = scratch.save(aims.withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cut_range = prefix.join(aims, prefix["source"].eqNullSafe(aims["source"])).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words")))
    cut_range = cut_range.select(prefix["source"].alias("s"), "range", (F.col("rest") - F.col("before")).alias("left"))
    inner = sized.join(cut_range, sized["source"].eqNullSafe(F.col("s")) & (F.substring("key", 1, RANGE_DIGITS) == F.col("range")))
    inner = inner.groupBy("source", "key", "size").agg(F.count("*").alias("alike"), F.first("left").alias("left")).withColumn("words", F.col("alike") * F.col("size"))
    inner = inner.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = inner.where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words")))
    cut = cut.select(F.col("source").alias("s"), F.struct("key", "size").alias("cut"), F.floor((F.col("left") - F.col("before")) / F.col("alike")).cast("long").alias("part"))
    cuts = scratch.save(aims.join(cut, aims["source"].eqNullSafe(F.col("s")), "left").select(F.col("source").alias("_mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("epochs").alias("_mix_epochs"), F.col("cut").alias("_mix_cut"), F.col("part").alias("_mix_part")))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    own = F.struct(F.col("_mix_key").alias("key"), F.col("mix_size").alias("size"))
    more = F.when(F.col("_mix_cut").isNull(), 0).when(own < F.col("_mix_cut"), F.col("mix_size")).when(own == F.col("_mix_cut"), F.col("_mix_part")).otherwise(0)
    joined = named.join(cuts, named[source_col].eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("mix_taken", F.col("_mix_epochs") * F.col("mix_size") + more).select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken")


def emit(docs: DataFrame, assigned: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: whole copies for whole epochs, and the first words of a text that is cut.

    Documents of which nothing is taken are gone; those of size 0 take nothing.
    """
    size, taken = F.col("mix_size"), F.col("mix_taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = assigned.where(taken > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    words = taken - (F.col("_copy") - 1) * size
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    rows = rows.withColumn("_text", F.when(words < size, cut).otherwise(F.col(text_col)))
    return rows.select(*(F.col("_text").alias(c) if c == text_col else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return assign(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || COALESCE(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (SUM(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, SUM(weight) OVER () AS weights FROM w),
p AS (SELECT *, COALESCE(SUM(cap) OVER o, 0) AS caps, COALESCE(SUM(weight) OVER o, 0) AS gone FROM c WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, cap * (weights - gone) <= weight * (total - caps) AS capped FROM p),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (total - SUM(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / (weights - SUM(CASE WHEN capped THEN weight ELSE 0 END) OVER ()) END AS target FROM q),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
g AS (SELECT source, k, size, COUNT(*) AS alike FROM d GROUP BY source, k, size),
r AS (SELECT *, COALESCE(SUM(alike * size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (b.epochs * d.size + LEAST(d.size, GREATEST(0, floor(target)::BIGINT - b.epochs * b.source_size - r.before) // r.alike))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.k = r.k AND d.size = r.size
"""
