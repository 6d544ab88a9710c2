"""Permutation tests whose permutations are never held: a keyed bijection of row numbers says where each row goes.

Row numbers below n are permuted by a Feistel network on the next even number of
bits, walked on until the result is below n again. A replicate's permutation is
thus a function of (seed, replicate, row), so a permuted pairing is a projection
and an exchange: rows of y go to the block of x rows that they are paired with,
for all replicates at once, and each block adds to the replicates' sums of
products. Nothing is as long as the table but the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions.resampling import rng_of
from resonarium.operators.fusion import block_sizes
from resonarium.operators.packed import gram, lists, map_groups
from resonarium.session import Scratch, ship

PRIME, ROUNDS = 2_147_483_647, 8
#: Rows of x that meet their partners in one task at a time.
BLOCK = 1024
#: Replicates that are dealt at a time.
BATCH = 64


def numbered(rows: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """rows with i, from 0 in order of the id, written; ties in no particular but fixed order."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.save(rows.repartitionByRange(parts, id_col).sortWithinPartitions(id_col).withColumn("_m", F.monotonically_increasing_id()))
    place, part = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_m", 33)
    counts = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = counts.select("_p", before.alias("_before"))
    joined = dealt.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return scratch.save(joined.withColumn("i", (F.col("_before") + place).cast("long")).drop("_p", "_m", "_before"))


def half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def key_of(seed: int, rep: int, step: int) -> int:
    first = (seed * 1_000_003 + rep * ROUNDS + step + 1) * 48_271 % PRIME
    return first * 69_621 % PRIME


def moved(i: np.ndarray, n: int, seed: int, rep: int) -> np.ndarray:
    """Where the rows i of n go in a replicate; n below 2**61."""
    b = half_bits(n)
    mask, out, todo = np.int64((1 << b) - 1), i.astype(np.int64).copy(), np.arange(len(i))
    keys = [np.int64(key_of(seed, rep, step)) for step in range(ROUNDS)]
    while len(todo):
        left, right = out[todo] >> b, out[todo] & mask
        for k in keys:
            t = (right + k) % PRIME
            left, right = right, left ^ (((t * t % PRIME) >> 5) & mask)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n]
    return out


def drawn(seed: int):
    """The permutations of numpy's generator: places(n, rep), a task row each; 8 bytes for each row of the table."""

    def places(n: int, rep: int) -> np.ndarray:
        to = np.arange(n)
        to[rng_of(seed, rep).permutation(n)] = np.arange(n)
        return to

    return places


def _dealt(rows: DataFrame, n: int, reps: range, places) -> DataFrame:
    """Rows (block, rep, to, y) under permutations that a task draws whole: their pieces meet the rows that they place."""
    spark = rows.sparkSession

    def draw(batches):
        for b in batches:
            for rep in b.column(0).to_pylist():
                to = places(n, rep) if rep >= 0 else np.arange(n)
                for first in range(0, n, BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([first // BLOCK]), pa.array([rep], pa.int32()), pa.array([to[first : first + BLOCK]], pa.list_(pa.int64()))], names=["own", "rep", "to"])

    def deal(batches):
        for b in batches:
            for r in range(b.num_rows):
                y, to = np.asarray(b.column(0)[r].values, float), np.asarray(b.column(2)[r].values)
                values = pa.FixedSizeListArray.from_arrays(pa.array(y), len(y) // len(to)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(to // BLOCK), pa.array(np.full(len(to), b.column(1)[r].as_py(), np.int32)), pa.array(to), values], names=["block", "rep", "to", "y"])

    pieces = spark.range(reps.start, reps.stop, 1, len(reps)).mapInArrow(draw, "own long, rep int, to array<long>")
    own = rows.groupBy(F.floor(F.col("i") / BLOCK).alias("own")).agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("s")).select("own", F.flatten("s.y").alias("y"))
    return own.hint("merge").join(pieces, "own").select("y", "rep", "to").mapInArrow(deal, "block long, rep int, to long, y array<double>")


def permuted_rv(df: DataFrame, x: str, y: str, id_col: str = "obs_id", permutations: int = 199, seed: int = 0, places=None) -> DataFrame:
    """Rows (rep, rv): the RV coefficient as observed (rep -1) and with the rows of y permuted, `permutations` times.

    places(n, rep), where given, says where the rows go instead of the keyed bijections. Only the sums of products of x with y change; the others are made once. Ids
    must not be null, and blocks must be of equal sizes in all rows.
    """
    if permutations < 1:
        raise ValueError("at least one permutation is needed")
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "permuted")
    p, q = block_sizes(df, [x, y])
    rows = numbered(df.select(F.col(id_col).alias("_id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")), "_id", scratch)
    g, s, n = gram(rows.select(F.concat("x", "y").alias("z")), "z")
    mean = s / n
    g = g - np.outer(s, s) / n
    scale = float(np.sqrt((g[:p, :p] ** 2).sum() * (g[p:, p:] ** 2).sum()))
    blocks = rows.groupBy(F.floor(F.col("i") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    blocks = blocks.select("block", F.flatten("s.x").alias("x"))
    made = None
    for first in range(-1, permutations, BATCH):
        reps = range(first, min(permutations, first + BATCH))

        def deal(batches, reps=reps):
            for b in batches:
                if not b.num_rows:
                    continue
                i = np.asarray(b.column(0))
                for rep in reps:
                    to = i if rep < 0 else moved(i, n, seed, rep)
                    yield pa.RecordBatch.from_arrays([pa.array(to // BLOCK), pa.array(np.full(len(i), rep, np.int32)), pa.array(to), b.column(1)], names=["block", "rep", "to", "y"])

        sent = rows.select("i", "y").mapInArrow(deal, "block long, rep int, to long, y array<double>") if places is None else _dealt(rows, n, reps, places)
        sent = sent.repartition("block")  # the one exchange: grouping and join go by it
        sent = sent.groupBy("block", "rep").agg(F.array_sort(F.collect_list(F.struct("to", "y"))).alias("s")).select("block", "rep", F.flatten("s.y").alias("y"))
        met = blocks.hint("merge").join(sent, "block").select("rep", "x", "y")  # blocks are the whole table: never sent to the driver as a broadcast

        def products(batches):
            from pyspark import TaskContext

            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for r in range(b.num_rows):
                    a, c = (np.asarray(b.column(k)[r].values, float) for k in (1, 2))
                    rep = b.column(0)[r].as_py()
                    sums[rep] = sums.get(rep, 0) + (a.reshape(-1, p) - mean[:p]).T @ (c.reshape(-1, q) - mean[p:])
            if sums:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([part] * len(sums), pa.int32()), lists(sums.values())], names=["rep", "part", "g"])

        found = met.mapInArrow(products, "rep int, part int, g array<double>")
        made = found if made is None else made.unionByName(found)
    from resonarium.operators.directed import summed

    total = summed(made, ["rep"], "g")
    return map_groups(total, lambda g, **_: [{"rv": float((g**2).sum() / scale) if scale > 0 else None}], "rv double", ["rep"], [])


def rv_test(df: DataFrame, x: str, y: str, id_col: str = "obs_id", permutations: int = 199, seed: int = 0, places=None) -> DataFrame:
    """One row (rv, p_value, permutations): how often a permuted pairing reaches the observed one, itself counted."""
    rows = permuted_rv(df, x, y, id_col, permutations, seed, places)
    one = rows.agg(F.max(F.when(F.col("rep") < 0, F.col("rv"))).alias("rv"), F.array_sort(F.collect_list(F.when(F.col("rep") >= 0, F.col("rv")))).alias("null"))
    return one.select("rv", ((F.size(F.filter("null", lambda v: v >= F.col("rv"))) + 1) / (F.size("null") + 1)).alias("p_value"), F.size("null").alias("permutations"))
