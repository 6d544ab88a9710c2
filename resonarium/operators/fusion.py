"""Fusion of feature blocks that share observations.

Blocks are a DataFrame with an id and one array column a block. Sums of
products are gathered in one pass (p x p numbers); solves happen on the driver;
scores are one more pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonarium.functions import fusion as M
from resonarium.functions import paired
from resonarium.functions.resampling import rng_of
from resonarium.operators.packed import centred, gram, lists, local_frame, map_rows, project
from resonarium.session import ship


def block_sizes(df: DataFrame, blocks: list[str]) -> list[int]:
    """Features of each block; all rows must agree and none may be null."""
    if len(blocks) < 2:
        raise ValueError("two blocks or more are needed")
    row = df.agg(*(F.min(F.coalesce(F.size(b), F.lit(-1))).alias(f"lo{k}") for k, b in enumerate(blocks)), *(F.max(F.size(b)).alias(f"hi{k}") for k, b in enumerate(blocks))).first()
    sizes = [row[f"hi{k}"] for k in range(len(blocks))]
    if any(row[f"lo{k}"] != row[f"hi{k}"] for k in range(len(blocks))):
        raise ValueError("all rows need the same features in every block")
    return sizes


def _joined(df: DataFrame, blocks: list[str], id_col: str) -> DataFrame:
    return df.select(id_col, F.concat(*blocks).cast("array<double>").alias("_x"))


def moments(df: DataFrame, blocks: list[str], id_col: str) -> tuple[DataFrame, list[int], np.ndarray, np.ndarray, int]:
    """Rows (id, _x), block sizes, sums of products about the means, means, count."""
    sizes, rows = block_sizes(df, blocks), _joined(df, blocks, id_col)
    g, s, n = gram(rows, "_x")
    return rows, sizes, centred(g, s, n), s / max(1, n), n


def jive(df: DataFrame, blocks: list[str], id_col: str = "obs_id", rank_joint: int = 1, rank_individual=1, scale: bool = True, max_iter: int = 1000, tol: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(scores, shares): joint scores (id, scores) and each block's joint, individual and residual share."""
    rows, sizes, g, mean, _ = moments(df, blocks, id_col)
    got = M.jive(g, sizes, rank_joint, rank_individual, scale, max_iter, tol)
    shares = [{"block": b, "joint": j, "individual": i, "residual": r, "iterations": got["iterations"]} for b, j, i, r in zip(blocks, got["joint_share"], got["individual_share"], got["residual_share"])]
    return project(rows, "_x", mean, got["S"]).drop("_x"), local_frame(df.sparkSession, shares, "block string, joint double, individual double, residual double, iterations int")


def jive_parts(df: DataFrame, blocks: list[str], id_col: str = "obs_id", **how) -> DataFrame:
    """Rows (id, joint, individual): the parts themselves, features of all blocks in turn."""
    rows, sizes, g, mean, _ = moments(df, blocks, id_col)
    got = M.jive(g, sizes, **how)
    return project(project(rows, "_x", mean, got["J"], "joint"), "_x", mean, got["A"], "individual").drop("_x")


def multiple_factor_analysis(df: DataFrame, blocks: list[str], id_col: str = "obs_id", ncomp: int = 2, scale_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, factors): rows (id, scores), and for each factor eigenvalue, explained share and contributions by block."""
    rows, sizes, g, mean, n = moments(df, blocks, id_col)
    sd = np.sqrt(np.diag(g) / (n - 1)) if scale_columns else np.ones(len(g))
    got = M.mfa(g / np.outer(sd, sd), sizes, ncomp)
    out = [{"factor": k + 1, "eigenvalue": got["eigenvalues"][k], "explained": got["explained"][k], "contributions": got["contributions"][:, k]} for k in range(len(got["eigenvalues"]))]
    return project(rows, "_x", mean, got["weights"] / sd[:, None]).drop("_x"), local_frame(df.sparkSession, out, "factor int, eigenvalue double, explained double, contributions array<double>")


def cca(df: DataFrame, x: str, y: str, id_col: str = "obs_id", ncomp: int | None = None, lambda_x: float = 0, lambda_y: float = 0) -> tuple[DataFrame, DataFrame]:
    """(scores, pairs): rows (id, xscores, yscores), and (pair, cor)."""
    rows, (p, q), g, mean, n = moments(df, [x, y], id_col)
    got = M.cca(g / (n - 1), p, n, ncomp, lambda_x, lambda_y)
    k = len(got["cor"])
    scores = project(project(rows, "_x", mean, np.vstack([got["xcoef"], np.zeros((q, k))]), "xscores"), "_x", mean, np.vstack([np.zeros((p, k)), got["ycoef"]]), "yscores").drop("_x")
    return scores, local_frame(df.sparkSession, [{"pair": i + 1, "cor": c} for i, c in enumerate(got["cor"])], "pair int, cor double")


def pls_blocks(df: DataFrame, x: str, y: str, id_col: str = "obs_id", ncomp: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores, components): rows (id, xscores, yscores), and (component, covariance, correlation)."""
    rows, (p, q), g, mean, n = moments(df, [x, y], id_col)
    got = M.pls(g, p, n, ncomp)
    k = len(got["covariance"])
    scores = project(project(rows, "_x", mean, np.vstack([got["xrotation"].T, np.zeros((q, k))]), "xscores"), "_x", mean, np.vstack([np.zeros((p, k)), got["yrotation"].T]), "yscores").drop("_x")
    return scores, local_frame(df.sparkSession, [{"component": i + 1, "covariance": got["covariance"][i], "correlation": got["correlation"][i]} for i in range(k)], "component int, covariance double, correlation double")


def coupled_nmf(df: DataFrame, x: str, y: str, rank: int, id_col: str = "obs_id", max_iter: int = 500, tol: float = 1e-7, n_restart: int = 5, seed: int = 0) -> DataFrame:
    """One row for each start (restart, vaf_x, vaf_y, vaf, resid, iterations, ids, shared), best first.

    A start is a task that holds both blocks; for blocks beyond a task's memory use coupled_nmf_rows.
    """
    both = df.agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")))).alias("r"))
    both = both.select(F.col("r.id").alias("ids"), F.flatten("r.x").alias("xs"), F.flatten("r.y").alias("ys"), F.explode(F.sequence(F.lit(0), F.lit(n_restart - 1))).alias("restart"))

    def kernel(ids, xs, ys, restart):
        n = len(ids)
        got = M.coupled_nmf(np.reshape(xs, (n, -1)), np.reshape(ys, (n, -1)), rank, rng_of(seed, restart), max_iter, tol)
        return {"vaf_x": got["vaf_x"], "vaf_y": got["vaf_y"], "vaf": got["vaf"], "resid": got["resid"], "iterations": got["iterations"], "shared": got["W"].ravel()}

    return map_rows(both.repartition(n_restart, "restart"), kernel, "vaf_x double, vaf_y double, vaf double, resid double, iterations int, shared array<double>", ["restart"]).orderBy("resid", "restart")


def coupled_nmf_rows(df: DataFrame, x: str, y: str, rank: int, id_col: str = "obs_id", max_iter: int = 100, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows (id, w), Hx, Hy) with the rows of W left distributed: each iteration is one pass that updates W and sums W'X, W'Y, W'W."""
    from resonarium.session import Scratch

    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nmf")
    p, q = block_sizes(df, [x, y])
    rng, eps = rng_of(seed, 0), 1e-10
    hx, hy = rng.random((rank, p)), rng.random((rank, q))
    w0 = F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda k: (F.pmod(F.xxhash64(F.col(id_col), k, F.lit(seed)), F.lit(2**30)).cast("double") + 1) / 2**30)
    rows = df.select(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), w0.alias("w"))
    schema = "id " + rows.schema["id"].dataType.simpleString() + ", x array<double>, y array<double>, w array<double>"
    stack = lambda c: np.stack([np.asarray(v.values, float) for v in c])
    for it in range(max_iter):

        def update(batches, hx=hx, hy=hy):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    xs, ys, w = (stack(b.column(k)) for k in (1, 2, 3))
                    w = w * (xs @ hx.T + ys @ hy.T) / (w @ (hx @ hx.T + hy @ hy.T) + eps)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["id", "x", "y", "w"])

        new = scratch.save(rows.mapInArrow(update, schema))
        if it:
            scratch.drop(rows)
        rows = new
        g, _, _ = gram(rows.select(F.concat("w", "x", "y").alias("z")), "z")
        ww, wx, wy = g[:rank, :rank], g[:rank, rank : rank + p], g[:rank, rank + p :]
        hx, hy = hx * wx / (ww @ hx + eps), hy * wy / (ww @ hy + eps)
    return rows.select("id", "w"), hx, hy


def rv_coefficient(df: DataFrame, x: str, y: str, id_col: str = "obs_id", center: bool = True) -> DataFrame:
    """One row (rv, n)."""
    sizes, rows = block_sizes(df, [x, y]), _joined(df, [x, y], id_col)
    g, s, n = gram(rows, "_x")
    g = centred(g, s, n) if center else g
    p = sizes[0]
    rv = (g[:p, p:] ** 2).sum() / np.sqrt((g[:p, :p] ** 2).sum() * (g[p:, p:] ** 2).sum())
    return local_frame(df.sparkSession, [{"rv": rv, "n": n}], "rv double, n long")


#: Rows a side of the pieces of a distance matrix that are held at once; least and most rows of a part of the observations, and parts wanted.
SIDE, LEAST_PART, MOST_PART, PARTS = 512, 2048, 32768, 16
#: Squared distances below this share of the largest squared norms are made anew from the differences, as sums of products cancel there.
NEAR = 1e-6


def _filler(a: np.ndarray, b: np.ndarray, metric: str):
    """fill(i, j, out) writes the distances of the rows a[i] and b[j]."""
    if metric != "euclidean":
        x, y = (v - v.mean(1, keepdims=True) for v in (a, b))
        x, y = (v / np.sqrt((v**2).sum(1, keepdims=True)) for v in (x, y))
        left, right = np.column_stack([-x, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([y, np.ones(len(y))]).T)
        return lambda i, j, out: np.matmul(left[i], right[:, j], out=out)
    middle = a.mean(0)
    x, y = a - middle, b - middle
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    left, right = np.column_stack([-2 * x, nx, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), ny]).T)

    def fill(i, j, out):
        np.matmul(left[i], right[:, j], out=out)
        near = out <= NEAR * (nx[i].max() + ny[j].max())
        if near.any():
            u, v = np.nonzero(near)
            out[u, v] = ((a[i][u] - b[j][v]) ** 2).sum(1)
        np.sqrt(out, out=out)

    return fill


def _pieces(left: list[np.ndarray], right: list[np.ndarray], same: bool, metric: str):
    """(i, j, distances a block) of pieces of SIDE x SIDE; of the same rows on both sides those on and below the diagonal. Arrays hold until the next piece."""
    if not len(left[0]) or not len(right[0]):
        return
    with np.errstate(all="ignore"):
        fill = [_filler(a, b, metric) for a, b in zip(left, right)]
        room = [np.empty(SIDE * SIDE) for _ in fill]
        for i in range(0, len(left[0]), SIDE):
            for j in range(0, i + 1 if same else len(right[0]), SIDE):
                at, to = slice(i, min(i + SIDE, len(left[0]))), slice(j, min(j + SIDE, len(right[0])))
                shape = at.stop - i, to.stop - j
                d = [r[: shape[0] * shape[1]].reshape(shape) for r in room]
                for f, out in zip(fill, d):
                    f(at, to, out)
                yield at, to, d


def _tiles(df: DataFrame, blocks: list[str], id_col: str, kernel, schema: str, metric: str = "euclidean", tile: int | None = None) -> DataFrame:
    """Rows of the tables that kernel(number, ids of rows, ids of columns, same, pieces) gives for each tile of the blocks' distance matrices.

    Observations are dealt into parts of `tile` rows; each two parts meet in one
    task, once, and a part meets itself (same), its rows in order of id. All
    distances are computed, piece by piece, but only what the kernel makes of
    them leaves its task. Each row travels once for each part.
    """
    n = df.count()
    parts = max(1, -(-n // tile) if tile else max(min(-(-n // LEAST_PART), PARTS), -(-n // MOST_PART)))
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    rows = df.select(part.alias("part"), F.col(id_col).cast("long").alias("id"), *(F.col(b).cast("array<double>").alias(f"b{k}") for k, b in enumerate(blocks)))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.select(F.least("part", "other").alias("l"), F.greatest("part", "other").alias("r"), (F.col("other") < F.col("part")).alias("far"), "id", *(f"b{k}" for k in range(len(blocks))))
    ship(df.sparkSession)

    def run(table):
        ids, far = np.asarray(table.column("id")), np.asarray(table.column("far"))
        order = np.argsort(ids, kind="stable")
        l, r = table.column("l")[0].as_py(), table.column("r")[0].as_py()
        at, to = order[~far[order]], order[far[order]]
        if l == r:
            to = at
        m = [np.asarray(table.column(f"b{k}").combine_chunks().flatten(), float).reshape(len(ids), -1) for k in range(len(blocks))]
        left = [x[at] for x in m]
        return kernel(l * parts + r, ids[at], ids[to], l == r, _pieces(left, left if l == r else [x[to] for x in m], l == r, metric))

    return met.repartition(parts * (parts + 1) // 2, "l", "r").groupBy("l", "r").applyInArrow(run, schema)


def _below(ids_l: np.ndarray, ids_r: np.ndarray, same: bool, at: slice, to: slice, d: list[np.ndarray]) -> list[np.ndarray]:
    """The piece's distances of pairs that are to be counted, each unordered pair of different ids once."""
    if not same or ids_l[at.start] > ids_r[to.stop - 1]:
        return [x.ravel() for x in d]
    below = ids_l[at, None] > ids_r[None, to]
    return [x[below] for x in d]


def distance_correlation(df: DataFrame, x: str, y: str, id_col: str = "obs_id", tile: int | None = None) -> DataFrame:
    """One row (dcor, dcov, n). Double centring needs row means and cross sums only: mean AB = mean ab - 2 mean(a_i b_i) + mean a mean b.

    A tile leaves two sums for each of its rows and three for itself, which its first row carries.
    """
    names = ["a", "b", "ab", "aa", "bb"]

    def kernel(number, ids_l, ids_r, same, pieces):
        rows, cols, whole = np.zeros((2, len(ids_l))), np.zeros((2, len(ids_r))), np.zeros(3)
        for at, to, (a, b) in pieces:
            both = not same or at != to
            for k, d in enumerate((a, b)):
                rows[k, at] += d.sum(1)
                if both:
                    cols[k, to] += d.sum(0)
            whole += (1 + both) * np.array([np.vdot(a, b), np.vdot(a, a), np.vdot(b, b)])
        if same:
            ids, sums, m = ids_l, rows + cols, np.full(len(ids_l), len(ids_l))
        else:
            ids, sums, m = np.concatenate([ids_l, ids_r]), np.hstack([rows, cols]), np.repeat([len(ids_r), len(ids_l)], [len(ids_l), len(ids_r)])
        first = np.zeros((3, len(ids)))
        first[:, 0] = whole
        return pa.table(dict(zip(["i", "m", *names], [ids, m, *sums, *first])))

    rows = _tiles(df, [x, y], id_col, kernel, "i long, m long, " + ", ".join(f"{c} double" for c in names), tile=tile)
    by_row = rows.groupBy("i").agg(F.sum("m").alias("m"), *(F.sum(c).alias(c) for c in names))
    mean = lambda v: F.sum(v) / F.sum("m")
    t = by_row.agg(F.count("*").alias("n"), *(mean(c).alias(c) for c in names), *(mean(F.col(u) * F.col(v) / F.col("m")).alias(f"r{u}{v}") for u, v in ("ab", "aa", "bb")))
    cov = lambda m, r, u, v: F.greatest(F.lit(0.0), F.col(m) - 2 * F.col(r) + F.col(u) * F.col(v))
    t = t.select("n", F.sqrt(cov("ab", "rab", "a", "b")).alias("dcov"), F.sqrt(F.sqrt(cov("aa", "raa", "a", "a")) * F.sqrt(cov("bb", "rbb", "b", "b"))).alias("den"))
    return t.select(F.when(F.col("den") > 0, F.least(F.lit(1.0), F.col("dcov") / F.col("den"))).otherwise(0.0).alias("dcor"), "dcov", "n")


def association_p(df: DataFrame, x: str, y: str, which: str = "rv", id_col: str = "obs_id", permutations: int = 199, seed: int = 0) -> DataFrame:
    """One row (statistic, p_value): rows of y permuted. which: rv, dcor, or rsa (Mantel, Spearman).

    For rv a task row draws the numbers of a permutation and no task holds all
    rows; for the others a permutation's task row holds both blocks.
    """
    if which == "rv":
        from resonarium.operators.permutations import drawn, rv_test

        return rv_test(df, x, y, id_col, permutations, seed, drawn(seed)).select(F.col("rv").alias("statistic"), "p_value")
    both = df.agg(F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")))).alias("r"))
    both = both.select(F.size("r").alias("n"), F.flatten("r.x").alias("xs"), F.flatten("r.y").alias("ys"), F.explode(F.sequence(F.lit(-1), F.lit(permutations - 1))).alias("rep"))

    def distances(m):
        return np.sqrt(np.maximum(((m[:, None, :] - m[None, :, :]) ** 2).sum(2), 0))

    def ranked(v):
        u, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(count) - (count - 1) / 2)[inverse]

    def kernel(n, xs, ys, rep):
        a, b = np.reshape(xs, (n, -1)), np.reshape(ys, (n, -1))
        if rep >= 0:
            b = b[rng_of(seed, rep).permutation(n)]
        if which == "dcor":
            u, v = distances(a), distances(b)
            u, v = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (u, v))
            den = np.sqrt(np.sqrt((u * u).mean()) * np.sqrt((v * v).mean()))
            stat = np.sqrt(max((u * v).mean(), 0)) / den if den > 0 else 0.0
        else:
            low = np.tril_indices(n, -1)
            stat = np.corrcoef(ranked(distances(a)[low]), ranked(distances(b)[low]))[0, 1]
        return {"stat": stat}

    rows = map_rows(both.repartition(permutations + 1, "rep"), kernel, "stat double", ["rep"])
    from resonarium.operators.inference import surrogate_summary

    return surrogate_summary(rows.withColumn("k", F.lit(0)), ["k"]).select(F.col("observed").alias("statistic"), "p_value")


def average_ranks(df: DataFrame, column: str, slices: int = 1024) -> DataFrame:
    """Rows (column, rank): ranks of distinct values, ties averaged. Values are cut into equal slices of their range, so no task sorts them all."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    width = ((span["hi"] or 0.0) - (span["lo"] or 0.0)) / slices or 1.0
    counts = df.groupBy(column).agg(F.count("*").alias("m")).withColumn("slice", F.floor((F.col(column) - (span["lo"] or 0.0)) / width))
    below = counts.groupBy("slice").agg(F.sum("m").alias("n")).withColumn("below", F.sum("n").over(Window.orderBy("slice")) - F.col("n"))
    inside = F.sum("m").over(Window.partitionBy("slice").orderBy(column))
    return counts.join(below.select("slice", "below"), "slice").select(column, (F.col("below") + inside - (F.col("m") - 1) / 2).alias("rank"))


def representational_similarity(df: DataFrame, blocks: list[str], id_col: str = "obs_id", method: str = "euclidean", compare: str = "spearman") -> DataFrame:
    """Rows (block_x, block_y, similarity) of the blocks' distance matrices, below the diagonal."""
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i + 1, len(blocks))]
    if compare == "pearson":
        one = _similar_by_tiles(df, blocks, pairs, id_col, method)
    elif compare == "spearman":
        found = [_ranks_alike(df, blocks[i], blocks[j], id_col, method).select(F.lit(blocks[i]).alias("block_x"), F.lit(blocks[j]).alias("block_y"), "similarity") for i, j in pairs]
        return reduce(DataFrame.unionByName, found)
    else:
        raise ValueError(f"unknown comparison {compare!r}")
    return one.select(F.explode(F.array(*(F.struct(F.lit(blocks[i]).alias("block_x"), F.lit(blocks[j]).alias("block_y"), F.col(f"s{i}_{j}").alias("similarity")) for i, j in pairs))).alias("z")).select("z.*")


#: Pairs that one task makes and sorts at once, at most; tasks that count pairs; bytes of both blocks up to which they are broadcast, beyond they are shuffled to each task.
SLICE_PAIRS, COUNTERS, MOST_BROADCAST = 1 << 25, 48, 64 << 20


def _met_whole(df: DataFrame, x: str, y: str, id_col: str, metric: str, width: int, tasks: int, kernel, schema: str) -> DataFrame:
    """Rows of the tables that kernel(number, ids, x, y) gives for each of the tasks, all of which have all observations, in one order; no pairs travel."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), *(F.col(b).cast("array<double>").alias(c) for b, c in ((x, "x"), (y, "y"))))
    ship(df.sparkSession)

    def packed(batches):
        for b in batches:
            if b.num_rows:
                two = []
                for k in (1, 2):
                    if b.column(k).null_count or len(set(b.column(k).value_lengths().to_pylist())) > 1:
                        raise ValueError("all rows need the same features in every block")
                    two.append(np.asarray(b.column(k).flatten(), float).tobytes())
                yield pa.RecordBatch.from_pydict({"i": [np.asarray(b.column(0)).tobytes()], "x": two[:1], "y": two[1:]})

    def run(table):
        read = lambda c, kind: np.concatenate([np.frombuffer(z.as_buffer(), kind) for z in table.column(c)])
        ids = read("i", np.int64)
        two = [read(c, float).reshape(len(ids), -1) for c in "xy"]
        order = np.lexsort([*two[1].T, *two[0].T, ids])
        return kernel(table.column("id")[0].as_py(), ids[order], *(paired.ready(z[order], metric) for z in two))

    whole = rows.mapInArrow(packed, "i binary, x binary, y binary")
    whole = F.broadcast(whole) if width <= MOST_BROADCAST else whole
    return df.sparkSession.range(0, tasks, 1, max(1, tasks)).crossJoin(whole).groupBy("id").applyInArrow(run, schema)


def _ranks_alike(df: DataFrame, x: str, y: str, id_col: str, metric: str) -> DataFrame:
    """One row (similarity): Spearman's of the two blocks' distances below the diagonal. Undefined distances count as equal and largest.

    Pairs are never kept or sent: a task holds the observations, makes the
    pairs of one range of the distances of a block and sorts them, so their
    ranks are exact. Beside such a rank stands the middle rank of the pair's
    slice in the other block, of up to 65,534 slices whose pairs are counted
    before; with r = middle + rest, sum rr' = sum r middle' + sum middle r' -
    sum middle middle' + sum rest rest'. The last sum is left out. It is 0 as
    long as slices are single distances (65,535 distinct ones or fewer), else by
    Cauchy and Schwarz no more than about 3e-10 of the coefficient's scale.
    """
    n, p, q = df.where(F.col(id_col).isNotNull()).agg(F.count("*"), F.coalesce(F.max(F.size(x)), F.lit(0)), F.coalesce(F.max(F.size(y)), F.lit(0))).first()
    met = lambda tasks, kernel, schema: _met_whole(df, x, y, id_col, metric, n * (p + q + 1) * 8, tasks, kernel, schema)
    blobs = lambda arrays: pa.array([a.tobytes() for a in arrays], pa.binary())

    def bounded(number, ids, a, b):
        return pa.table({"k": [0, 1], "v": blobs(paired.bounds_of(a, b, ids, metric))})

    bounds = [np.zeros(0), np.zeros(0)]
    for r in met(1, bounded, "k long, v binary").collect():
        bounds[r["k"]] = np.frombuffer(r["v"])
    tasks = max(1, min(COUNTERS, n * n // (1 << 20)))

    def counted(number, ids, a, b):
        return pa.table({"k": [0, 1], "v": blobs(paired.counted(a, b, ids, metric, bounds, number, tasks))})

    def added(table):
        return pa.table({"k": table.column("k")[:1], "v": blobs([sum(np.frombuffer(z.as_buffer(), np.int64) for z in table.column("v"))])})

    counts = [np.zeros(2 * len(b) + 1, np.int64) for b in bounds]
    for r in met(tasks, counted, "k long, v binary").groupBy("k").applyInArrow(added, "k long, v binary").collect():
        counts[r["k"]] = np.frombuffer(r["v"], np.int64)
    if paired.left_out(counts) > 1e-9:
        raise ArithmeticError("slices of the distances are too large")
    most = min(SLICE_PAIRS, max(1 << 21, n * n // 64))
    pieces = [(k, *r) for k in range(2) for r in paired.ranges(counts[k], most)]

    def summed(number, ids, a, b):
        k, *piece = pieces[number]
        rr, rm, mm = paired.products(*((b, a) if k else (a, b)), ids, metric, bounds[::-1] if k else bounds, counts[::-1] if k else counts, *piece)
        return pa.table({"ab": [rm if k else rm - mm], "aa": [0.0 if k else rr], "bb": [rr if k else 0.0]})

    sums = met(len(pieces), summed, "ab double, aa double, bb double").agg(*(F.sum(c).alias(c) for c in ("ab", "aa", "bb")))
    return sums.select(F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")).alias("similarity"))


def _similar_by_tiles(df: DataFrame, blocks: list[str], pairs, id_col: str, metric: str) -> DataFrame:
    """One row of correlations of the distances below the diagonal. A tile leaves its count, means and products about these; pieces and tiles are put together exactly."""
    m = len(blocks)

    def kernel(number, ids_l, ids_r, same, pieces):
        n, mean, p = 0, np.zeros(m), np.zeros((m, m))
        for at, to, d in pieces:
            v = _below(ids_l, ids_r, same, at, to, d)
            k = len(v[0])
            if k:
                here = np.array([x.sum() / k for x in v])
                for x, c in zip(v, here):
                    x -= c
                apart = here - mean
                for i in range(m):
                    for j in range(i, m):
                        p[i, j] += v[i] @ v[j] + apart[i] * apart[j] * n * k / (n + k)
                n, mean = n + k, mean + apart * k / (n + k)
        p = np.triu(p) + np.triu(p, 1).T
        return pa.table({"n": pa.array([n] if n else [], pa.int64()), "mean": lists([mean] if n else []), "p": lists([p] if n else [])})

    rows = _tiles(df, blocks, id_col, kernel, "n long, mean array<double>, p array<double>", metric)
    total, at = F.sum("n"), lambda k: F.sum(F.col("n") * F.get("mean", F.lit(k)))
    between = lambda i, j: F.sum(F.get("p", F.lit(i * m + j)) + F.col("n") * F.get("mean", F.lit(i)) * F.get("mean", F.lit(j))) - at(i) * at(j) / total
    return rows.agg(*(F.try_divide(between(i, j), F.sqrt(F.greatest(F.lit(0.0), between(i, i) * between(j, j)))).alias(f"s{i}_{j}") for i, j in pairs))


def deviation_index(features: DataFrame, reference: DataFrame, column: str, blocks: dict[str, tuple[int, int]] | None = None, id_col: str = "obs_id", ve: float = 0.95, mean_index: float = 100, sd_index: float = 10) -> DataFrame:
    """Rows (id, part, index, distance): part 'all' and each block (a range of features, from 0, end exclusive).

    Distance from the reference's mean in standardized principal directions,
    its logarithm scaled by those of the reference itself.
    """
    ref = reference.select(F.col(column).cast("array<double>").alias("_x"))
    g, s, n = gram(ref, "_x")
    cov, mean = centred(g, s, n) / (n - 1), s / n
    parts = {"all": (0, len(mean))} | (blocks or {})
    out = None
    for name, (a, b) in parts.items():
        v, sd = M.deviation_model(cov[a:b, a:b], n, ve)
        w = np.zeros((len(mean), v.shape[1]))
        w[a:b] = v / sd
        dist = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda t, z: t + z * z))
        stats = project(ref, "_x", mean, w).select(F.log(dist + 1e-9).alias("l")).agg(F.avg("l").alias("m"), F.stddev_samp("l").alias("s"))
        stats = stats.select("m", F.when(F.col("s") < 1e-9, 1.0).otherwise(F.col("s")).alias("s"))
        rows = project(features.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("_x")), "_x", mean, w).select("id", dist.alias("distance"))
        rows = rows.crossJoin(F.broadcast(stats)).select("id", F.lit(name).alias("part"), (mean_index - sd_index * (F.log(F.col("distance") + 1e-9) - F.col("m")) / F.col("s")).alias("index"), "distance")
        out = rows if out is None else out.unionByName(rows)
    return out


def fuse_blocks(df: DataFrame, blocks: list[str], id_col: str = "obs_id", method: str = "zscore") -> tuple[DataFrame, DataFrame]:
    """(rows (id, fused), (block, start, end)); places from 1, both ends included."""
    rows, sizes, g, mean, n = moments(df, blocks, id_col)
    at = M.cut(sizes)
    if method == "zscore":
        scale = np.sqrt(np.diag(g) / (n - 1))
    elif method == "mfa":
        scale = np.concatenate([np.full(m, np.sqrt(M.psd_eigh(g[s, s])[0][0])) for m, s in zip(sizes, at)])
    elif method == "frobenius":
        scale = np.concatenate([np.full(m, np.sqrt(np.trace(g[s, s]))) for m, s in zip(sizes, at)])
    else:
        raise ValueError(f"unknown method {method!r}")
    with np.errstate(divide="ignore"):
        fused = project(rows, "_x", mean, np.diag(1 / scale), "fused").drop("_x")
    return fused, local_frame(df.sparkSession, [{"block": b, "start": s.start + 1, "end": s.stop} for b, s in zip(blocks, at)], "block string, start int, end int")


def cross_block_factor(df: DataFrame, blocks: list[str], nfactors: int, id_col: str = "obs_id", load_threshold: float = 0.4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loadings (block, feature, loadings), factors (factor, shared), scores (id, scores)); shared: two blocks or more load on it."""
    rows, sizes, g, mean, n = moments(df, blocks, id_col)
    sd = np.sqrt(np.diag(g))
    corr = g / np.outer(sd, sd)
    load, _ = M.factor_analysis(corr, nfactors)
    names = [(b, k + 1) for b, m in zip(blocks, sizes) for k in range(m)]
    shared = [len({names[i][0] for i in np.flatnonzero(np.abs(load[:, j]) >= load_threshold)}) >= 2 for j in range(nfactors)]
    spark = df.sparkSession
    weights = np.linalg.solve(corr, load) / (sd / np.sqrt(n - 1))[:, None]
    return (
        local_frame(spark, [{"block": b, "feature": k, "loadings": load[i]} for i, (b, k) in enumerate(names)], "block string, feature int, loadings array<double>"),
        local_frame(spark, [{"factor": j + 1, "shared": bool(s)} for j, s in enumerate(shared)], "factor int, shared boolean"),
        project(rows, "_x", mean, weights).drop("_x"),
    )
