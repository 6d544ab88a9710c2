"""SimHash near-dedup: 64-bit fingerprints, then tiled exact comparison.

Fingerprints are compared exactly in square tiles with exclusive-or and bit
counts. Distinct fingerprints are sorted by the population counts of the whole
word and of its eight bytes and cut into tiles; each tile keeps the range of
every count. Two fingerprints within radius r differ by at most r summed over
the eight byte counts, so a pair of tiles whose ranges are farther apart than
that is skipped and no link is lost.

Defined results: a null or wordless text has fingerprint zero and is linked
like any other; repeated rows give repeated rows; a null doc_id takes part, is
never the smallest id of a component, and component_id is null only where a
component has null ids alone; further columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm import kernels as K
from resonarium.llm.graph import components
from resonarium.session import Scratch, ship

SEED = 42


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; fewer words give one run, none give none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] hashes; a bit is set where over half have it."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    at = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
    for b in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(1), at)
        out[full] |= (2 * ones > counts[full].astype(np.uint64)).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (id, fp): fp is the signed 64-bit fingerprint of the whole text."""
    ship(docs.sparkSession)

    def run(batches):
        for b in K.batch_slices(batches, "text", 2_000_000):
            data, offsets = K.buffers(b.column(1))
            raw = data.tobytes()
            each = [shingle_hashes(raw[offsets[i] : offsets[i + 1]], size) for i in range(b.num_rows)]
            fp = majority(np.concatenate(each), np.array([len(x) for x in each], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


#: Population counts by which tiles are told apart: the eight bytes of a fingerprint.
PARTS = 8


def _counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, PARTS))


def tiles(fps: DataFrame, tile: int = 2048) -> DataFrame:
    """Cuts a table of distinct (fp) into rows (tile, lo, hi, low, high, fps): ranges of the total and of each part's count."""

    def run(batches):
        from pyspark import TaskContext

        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        a = np.concatenate(got).view(np.uint64) if got else np.zeros(0, np.uint64)
        c = _counts(a)
        total = c.sum(1)
        order = np.lexsort([*(c[:, k] for k in range(PARTS - 1, -1, -1)), total])
        a, c, total = a[order], c[order], total[order]
        task = TaskContext.get().partitionId() << 32
        for k, i in enumerate(range(0, len(a), tile)):
            j = min(len(a), i + tile)
            box = [c[i:j].min(0).tolist(), c[i:j].max(0).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task + k]), pa.array([int(total[i])], pa.int32()), pa.array([int(total[j - 1])], pa.int32()), pa.array([box[0]], pa.list_(pa.int32())), pa.array([box[1]], pa.list_(pa.int32())), pa.array([a[i:j].tobytes()], pa.binary())],
                names=["tile", "lo", "hi", "low", "high", "fps"],
            )

    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = fps.repartitionByRange(n, F.bit_count("fp"), F.bit_count(F.shiftright("fp", 32)), "fp").select("fp")
    return dealt.mapInArrow(run, "tile long, lo int, hi int, low array<int>, high array<int>, fps binary")


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links that joins just what all links within radius between a and b join."""
    found = []
    for i in range(0, len(a), 256):
        near = np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius
        if same:
            near[np.arange(near.shape[0]), np.arange(i, i + near.shape[0])] = False
        x, y = np.nonzero(near)
        found.append(np.stack([x + i, y]))
    x, y = np.concatenate(found, axis=1)
    if not len(x):
        return a[:0], b[:0]
    nodes, index = np.unique(np.concatenate([a[x], b[y]]), return_inverse=True)
    u, v = index[: len(x)], index[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def links(fps: DataFrame, scratch: Scratch, radius: int = 3, tile: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join just what all pairs within `radius` bits join."""
    t = scratch.save(tiles(fps, tile))
    head = t.select("tile", "lo", "hi", "low", "high")
    left = head.select(F.col("tile").alias("t1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.col("lo").alias("lo1"), F.explode(F.sequence("lo", F.col("hi") + radius)).alias("pop"))
    right = head.select(F.col("tile").alias("t2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("lo").alias("lo2"), F.explode(F.sequence("lo", "hi")).alias("pop"))
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("low1", "high1"), F.arrays_zip("low2", "high2"), lambda p, q: F.greatest(F.lit(0), p["low1"] - q["high2"], q["low2"] - p["high1"])), F.lit(0), lambda s, x: s + x
    )
    ahead = (F.col("lo1") < F.col("lo2")) | ((F.col("lo1") == F.col("lo2")) & (F.col("t1") <= F.col("t2")))
    pairs = left.join(right, "pop").where(ahead & (gap <= radius)).select("t1", "t2").distinct()
    both = pairs.join(t.select(F.col("tile").alias("t1"), F.col("fps").alias("x")), "t1").join(t.select(F.col("tile").alias("t2"), F.col("fps").alias("y")), "t2")

    def run(batches):
        for b in batches:
            for t1, t2, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                u, v = tile_links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), t1 == t2, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.select("t1", "t2", "x", "y").repartition(n).mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, size: int = 3, tile: int = 2048) -> DataFrame:
    """Rows (id, fp, component_id) for every row of docs."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col, size))
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), scratch, radius, tile), scratch).withColumnsRenamed({"node": "fp"})
    named = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
