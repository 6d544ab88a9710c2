"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Vectors of one label are hashed into `tables` tables by the signs of their
products with `bits` fixed random directions each. Vectors that share a bucket
of any table are compared exactly; a pair is counted only in the first table
they share, so counts are exact. At cosine c a table brings a pair together
with probability (1 - arccos(c)/pi)**bits; the default 36 tables of 16 bits
miss a pair of cosine 0.98 with probability 2e-7, and nearer pairs less often.

Equal vectors are one before hashing. Only buckets of two or more get vectors.
A bucket of more than `cell` distinct vectors is cut into parts, and every pair
of parts is a task's cell of its own. Cells send counts and a forest of links,
never all pairs.

Defined results: rows with a null label, or a vector that is null, empty, zero
or holds null or non-finite components, link with nothing; vectors of different
length neither; a null vec_id links with nothing and keeps a null component;
repeated rows are separate vectors that link; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonarium.llm.graph import components
from resonarium.session import Scratch, ship

THRESHOLD, BITS, TABLES, CELL = 0.98, 16, 36, 1024
_PLANES: dict[tuple, np.ndarray] = {}


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    key = (dim, bits, tables)
    if key not in _PLANES:
        _PLANES[key] = np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, bits * tables))
    return _PLANES[key]


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers (vectors x tables)."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.uint16)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest components near 1: exact, and norms neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def packed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Rows (id, label, vec): the vector's doubles as bytes, null where it can link with nothing."""
    ship(vectors.sparkSession)
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(F.col(vec_col), lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(good, F.col(vec_col).cast("array<double>")).alias("vec"))

    def run(batches):
        for b in batches:
            col = b.column(2)
            col = pa.concat_arrays([col])
            values, offsets = np.asarray(col.values), np.asarray(col.offsets)
            null = np.asarray(col.is_null())
            vec = [None if null[i] else values[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vec, pa.binary())], names=["id", "label", "vec"])

    return rows.mapInArrow(run, "id long, label string, vec binary")


def keyed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """Rows (node, tab, bucket) for every table."""

    def run(batches):
        for b in batches:
            raw, nodes, labels = b.column(0).to_pylist(), np.asarray(b.column(1)), b.column(2)
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(raw[i] for i in which), np.float64).reshape(len(which), -1)
                x = scaled(x)
                keys = signatures(x / np.linalg.norm(x, axis=1)[:, None], bits, tables)
                n = len(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[which], tables)), labels.take(pa.array(np.repeat(which, tables))), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel().astype(np.int32)), pa.array(np.full(n * tables, size // 8, np.int32))],
                    names=["node", "label", "tab", "bucket", "dim"],
                )

    return reps.select("vec", "node", "label").mapInArrow(run, "node long, label string, tab int, bucket int, dim int")


def compare(a: list, b: list, same: bool, tab: int, threshold: float, bits: int, tables: int):
    """Links between two lists of (node, n, vec): linked nodes with the number of vectors each gains, and a forest of links."""
    x, y = (scaled(np.frombuffer(b"".join(v for _, _, v in side), np.float64).reshape(len(side), -1)) for side in (a, b))
    cos = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    near = cos >= threshold
    if same:
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(near)
    if tab and len(i):  # counted already if an earlier table brings them together
        ia, ib = np.unique(i), np.unique(j)
        kx = signatures(x[ia] / np.linalg.norm(x[ia], axis=1)[:, None], bits, tables)[:, :tab]
        ky = signatures(y[ib] / np.linalg.norm(y[ib], axis=1)[:, None], bits, tables)[:, :tab]
        px, py, new = np.searchsorted(ia, i), np.searchsorted(ib, j), np.ones(len(i), bool)
        for s in range(0, len(i), 200_000):
            new[s : s + 200_000] = ~(kx[px[s : s + 200_000]] == ky[py[s : s + 200_000]]).any(1)
        i, j = i[new], j[new]
    if not len(i):
        return None
    na, nb = np.array([v[1] for v in a], np.int64), np.array([v[1] for v in b], np.int64)
    gain_a, gain_b = np.bincount(i, nb[j], len(a)).astype(np.int64), np.bincount(j, na[i], len(b)).astype(np.int64)
    ids_a, ids_b = np.array([v[0] for v in a], np.int64), np.array([v[0] for v in b], np.int64)
    u, v = forest(ids_a[i], ids_b[j])
    return np.concatenate([ids_a[gain_a > 0], ids_b[gain_b > 0]]), np.concatenate([gain_a[gain_a > 0], gain_b[gain_b > 0]]), u, v


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A subset of star links that joins just what the links (u, v) join."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    p, q, root = index[: len(u)], index[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        for k in (p, q, root[p], root[q]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of `vectors`."""
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.save(packed(vectors, id_col, vec_col, label_col))
    reps = scratch.save(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.xxhash64("label", "vec")))
    keys = scratch.save(keyed(reps, bits, tables))
    place = ["label", "dim", "tab", "bucket"]
    many = keys.groupBy(*place).agg(F.count("*").alias("held")).where("held > 1")
    cells = keys.join(many, place).withColumn("parts", F.ceil(F.col("held") / cell).cast("int"))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts", "held")
    full = cells.join(reps.select("node", "n", "vec"), "node").select(F.xxhash64(*place, "i", "j").alias("cell"), *place, "i", "j", "part", "node", "n", "vec")

    def run(batches):
        held, now = [], None
        out: list[list] = [[], [], [], []]

        def done():
            if not held:
                return
            tab, i, j = held[0][3], held[0][5], held[0][6]
            a = [h[8:] for h in held if h[7] == i]
            b = a if i == j else [h[8:] for h in held if h[7] == j]
            if a and b and (i != j or len(a) > 1):
                got = compare(a, b, i == j, tab, threshold, bits, tables)
                if got:
                    for o, g in zip(out, got):
                        o.append(g)

        def flush():
            if out[0]:
                node, gain, u, v = (np.concatenate(o) for o in out)
                for o in out:
                    o.clear()
                uniq, inverse = np.unique(node, return_inverse=True)
                gain = np.bincount(inverse, gain).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([uniq, u])), pa.array(np.concatenate([gain, np.zeros(len(u), np.int64)])), pa.array([None] * len(uniq) + v.tolist(), pa.int64())], names=["a", "gain", "b"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if now != row[:7]:
                    done()
                    held, now = [], row[:7]
                held.append(row)
            if sum(len(x) for x in out[0]) > 100_000:
                yield from flush()
        done()
        yield from flush()

    order = ["cell", *place, "i", "j"]
    dealt = full.repartition(n_parts, "cell").sortWithinPartitions(*order)
    found = scratch.save(dealt.mapInArrow(run, "a long, gain long, b long"))
    gains = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("gain").alias("gain"))
    roots = components(found.where("b is not null").select("a", "b"), scratch)
    named = reps.join(gains, "node", "left").join(roots, "node", "left").select("label", "vec", "n", "least", F.coalesce("gain", F.lit(0)).alias("gain"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("label").alias("_l"), F.col("vec").alias("_v"), (F.col("gain") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, (F.col("label") == F.col("_l")) & (F.col("vec") == F.col("_v")), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


#: Every pair of one label by cosine, then all that links reach from each vector.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98e0 ELSE false END),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
own AS (SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY 1),
held AS (SELECT a AS vec_id, COUNT(*) AS n_links FROM link GROUP BY 1)
SELECT own.vec_id, COALESCE(n_links, 0) AS n_links, component_id, own.vec_id = component_id AS kept FROM own LEFT JOIN held ON held.vec_id = own.vec_id
"""
