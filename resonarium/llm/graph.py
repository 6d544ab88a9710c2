"""Connected components of an edge table, by alternating star contraction.

Each round joins every edge with the least neighbour of one end, so a node of
any degree costs one row of minima and its edges are spread over tasks. Rounds
are written to the shared folder, which cuts lineage. Nothing is collected but
two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonarium.session import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of an edge; root is the least node of its component.

    Nulls at either end and loops are ignored. Raises if it has not settled
    after `most_rounds` rounds (the count needed grows as the logarithm of the
    longest path).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = scratch.save(e)
    seen = None
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())  # edges are distinct; a sum of hashes overflows at a million
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        done, e = e, scratch.save(small)
        scratch.drop(done)
        scratch.drop(large)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
