"""How filters interact: what each removes in every order, and its Shapley share, from one polynomial a part.

Every document gets a mask of the filters it fails. A part's masks are counted
(at most 2**n rows), and the counts give its removal polynomial, the multilinear
extension of "how many documents does a set of filters remove":

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i))
         = sum over sets T of c(T) * product over i in T of x_i,
    c(T) = (-1)**(|T| + 1) * (number of documents whose mask holds T).

* R at a corner (0 or 1 for each filter) is what that set of filters removes, so
  survivors after each step of each order are differences of corner values.
* A filter's Shapley value is the integral over t from 0 to 1 of dR/dx_i at
  (t, ..., t): the sum over T with i of c(T) / |T|. It is kept exact, as a whole
  numerator over lcm(1..n), and scaled by n!, which is the sum over all orders.

The texts are read once and never shuffled. What is shuffled is a row of a digest
and flags for each document, then one for each distinct text and part; equal
texts are added up before they meet, so a text that a third of all documents
hold is a few rows a task.

Defined results: a null text is empty, a null part is the empty string; repeated
rows count each; a null doc_id has no label and no smaller doc_id, and is
smaller than none; of several labels of a document any counts; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows without an id are dealt by their text instead: as many places as this.
PLACES = 4096
MOST_FILTERS = 8


def measures(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "words": F.size(words).cast("long"),
        "distinct": F.size(F.array_distinct(words)).cast("long"),
        "capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "points": F.length(text).cast("long"),
        "symbols": text.rlike(r"[#$%&*|]"),
    }


def standard(m) -> dict[str, Column]:
    """Filters by letter, true where a document fails; m: columns of measures by name."""
    return {
        "A": m("words") < 100,
        "B": 100 * m("distinct") < 80 * m("words"),
        "C": 100 * m("capitals") > 10 * m("points"),
        "D": m("symbols"),
    }


def bits(flags: list[Column]) -> Column:
    out = F.lit(0)
    for k, f in enumerate(flags):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, filters=standard, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, str]:
    """Rows (part, mask, n, good, toxic), and the letters of the mask's bits, lowest first.

    copies: the letter of the filter that fails texts which a smaller id holds too; None for no such filter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("text_key"), *(c.alias(k) for k, c in measures(F.col("t")).items()))
    own = filters(F.col)
    place = F.when(F.col("id").isNull(), 1 + F.pmod(F.hash("text_key", "part"), F.lit(PLACES))).otherwise(0)
    rows = rows.select("id", "part", "text_key", bits(list(own.values())).alias("mask"), place.alias("place"))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"), F.lit(0).alias("place"))
    told = told.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(told, ["id", "place"], "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    kind = ["part", "mask", "good", "toxic"]
    if copies is None:
        done = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    else:
        # rows alike in all and in their id first: that count comes along with the least id of each distinct text
        alike = rows.groupBy("id", "place", "text_key", *kind).agg(F.count("*").alias("n"))
        least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
        texts = alike.groupBy("text_key", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
        texts = texts.withColumn("first", F.min("least.id").over(Window.partitionBy("text_key")))  # a row for each part and label
        passes = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
        each = F.array(F.struct(F.col("mask"), passes.alias("n")), F.struct((F.col("mask") + (1 << len(own))).alias("mask"), (F.col("n") - passes).alias("n")))
        done = texts.select("part", "good", "toxic", F.inline(each)).where("n > 0")
    weigh = lambda c: F.sum(F.col("n") * F.col(c)).cast("long").alias(c)
    return done.groupBy("part", "mask").agg(F.sum("n").cast("long").alias("n"), weigh("good"), weigh("toxic")), "".join(own) + (copies or "")


def polynomials(counts: DataFrame, n_filters: int) -> DataFrame:
    """Rows (part, total, n, good, toxic): coefficients c(T) of each part's polynomial, T from 1 to 2**n - 1."""
    zero, full = F.lit(0).cast("long"), (1 << n_filters) - 1
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"), F.sum("n").cast("long").alias("total"))

    def coefficients(what: str) -> Column:
        held = lambda t: F.aggregate("masks", zero, lambda s, m: s + F.when(m["mask"].bitwiseAND(t) == t, m[what]).otherwise(zero))
        return F.transform(F.sequence(F.lit(1), F.lit(full)), lambda t: F.when(F.bit_count(t) % 2 == 1, held(t)).otherwise(-held(t))).alias(what)

    return rows.select("part", "total", *map(coefficients, ("n", "good", "toxic")))


def corners(coefficients: Column, n_filters: int) -> Column:
    """R at every corner, by set number + 1."""
    zero, full = F.lit(0).cast("long"), (1 << n_filters) - 1
    term = lambda s: lambda v, t: v + F.when(t.bitwiseAND(s) == t, F.element_at(coefficients, t)).otherwise(zero)
    return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(full)), zero, term(s)))


def shapley(coefficients: Column, n_filters: int) -> Column:
    """Each filter's Shapley value times n!, from the exact numerator over lcm(1..n)."""
    zero, common = F.lit(0).cast("long"), math.lcm(*range(1, n_filters + 1))
    share = lambda t: (F.lit(common) / F.bit_count(t)).cast("long")  # noqa: E731  a whole number: |T| divides the lcm
    part = lambda i: F.aggregate(
        F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), zero, lambda v, t: v + F.when(t.bitwiseAND(F.lit(1 << i)) != 0, F.element_at(coefficients, t) * share(t)).otherwise(zero)
    )
    return F.array(*(part(i) * (math.factorial(n_filters) // common) for i in range(n_filters)))


def report(counts: DataFrame, letters: str) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order."""
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"needs 1 to {MOST_FILTERS} filters of different letters")
    steps = []
    for order in permutations(letters):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << letters.index(letter)
            steps.append({"filter_order": "".join(order), "step": k + 1, "number": letters.index(letter), "bit": bit, "before": before, "after": before | bit})
            before |= bit
    schema = "array<struct<filter_order:string,step:int,number:int,bit:int,before:int,after:int>>"
    rows = polynomials(counts, n)
    rows = rows.select("part", "total", *(corners(F.col(c), n).alias(f"r_{c}") for c in ("n", "good", "toxic")), shapley(F.col("n"), n).alias("shares"))
    rows = rows.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), schema)))
    at = lambda c, s: F.element_at(f"r_{c}", s + 1)
    gone = lambda c: at(c, F.col("after")) - at(c, F.col("before"))
    full = F.lit((1 << n) - 1)
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - at("n", F.col("after"))).alias("kept"),
        gone("n").alias("removed"),
        (at("n", F.col("bit")) - gone("n")).alias("redundant"),
        (at("n", full) - at("n", full - F.col("bit"))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("number") + 1).alias("shapley"),
    )


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return report(*mask_counts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS s,
  COALESCE(MIN(d.doc_id) OVER (PARTITION BY t) < d.doc_id, FALSE) AS e, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * s::INT + 16 * e::INT AS mask, COUNT(*) AS n, SUM(good::INT) AS good, SUM(toxic::INT) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [p.bit, q.bit, r.bit, u.bit, v.bit] AS path, p.letter || q.letter || r.letter || u.letter || v.letter AS filter_order
  FROM x p, x q, x r, x u, x v WHERE p.bit + q.bit + r.bit + u.bit + v.bit = 31 AND p.bit | q.bit | r.bit | u.bit | v.bit = 31),
k AS (SELECT filter_order, step, path[step] AS bit, COALESCE(list_sum(path[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
  SUM(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  SUM(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN n ELSE 0 END)::BIGINT AS removed,
  SUM(CASE WHEN mask & before != 0 AND mask & bit != 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  SUM(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  SUM(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  SUM(CASE WHEN mask & before = 0 AND mask & bit != 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (SUM(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
