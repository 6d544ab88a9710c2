"""Leave-one-site-out generalization: all folds from one pass (gaussian), or one pass an iteration (binomial)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resonarium.operators.packed import correlation, local_frame
from resonarium.session import ship

EPS = 1e-12


def complete(df: DataFrame, outcome: str, site: str, features: list[str], positive=None) -> DataFrame:
    """Rows (site, y, x) without nulls or NaN; y is 1 for the positive class where one is given."""
    y = F.col(outcome).cast("double") if positive is None else F.when(F.col(outcome).isNotNull(), (F.col(outcome) == positive).cast("double"))
    rows = df.select(F.col(site).cast("string").alias("site"), y.alias("y"), *(F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)))
    for c in ["y", *(f"f{k}" for k in range(len(features)))]:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c))
    return rows.where("site is not null").select("site", "y", F.array(*(f"f{k}" for k in range(len(features)))).alias("x"))


def site_grams(rows: DataFrame) -> dict[str, np.ndarray]:
    """For each site sums of products of (1, y, features): (p + 2) squared numbers a site."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            site = np.array(b.column(0).to_pylist(), object)
            z = np.column_stack([np.ones(b.num_rows), np.asarray(b.column(1)), np.stack([np.asarray(v.values, float) for v in b.column(2)])])
            for s in set(site):
                m = z[site == s]
                total[s] = total.get(s, 0) + m.T @ m
        for s, g in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s] * g.size), pa.array(np.arange(g.size)), pa.array(g.ravel())], names=["site", "k", "v"])

    got: dict[str, list] = {}
    for r in rows.mapInArrow(run, "site string, k long, v double").groupBy("site", "k").agg(F.sum("v").alias("v")).collect():
        got.setdefault(r["site"], []).append((r["k"], r["v"]))
    out = {}
    for s, cells in sorted(got.items()):
        size = int(round(np.sqrt(len(cells))))
        out[s] = np.array([v for _, v in sorted(cells)]).reshape(size, size)
    return out


def fold_scales(grams: dict[str, np.ndarray], scale: bool) -> dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each left-out site: training rows, feature means and deviations (0 becomes 1), and its sums of products."""
    total, out = sum(grams.values()), {}
    for s, g in grams.items():
        t = total - g
        n = int(round(t[0, 0]))
        mean = t[0, 2:] / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(t)[2:] - n * mean**2, 0) / max(n - 1, 1))
        if not scale:
            mean, sd = mean * 0, np.ones_like(sd)
        out[s] = (n, mean, np.where(sd > EPS, sd, 1), t)
    return out


def gaussian_fits(grams: dict[str, np.ndarray], scale: bool) -> dict[str, np.ndarray]:
    """Intercept and slopes on the raw features, by site left out."""
    out = {}
    for s, (n, mean, sd, t) in fold_scales(grams, scale).items():
        k = [0, *range(2, len(t))]
        a = np.diag(np.concatenate([[1.0], 1 / sd]))
        a[1:, 0] = -mean / sd  # rows: standardized features as combinations of (1, features)
        b = np.linalg.lstsq(a @ t[np.ix_(k, k)] @ a.T, a @ t[k, 1], rcond=None)[0]
        out[s] = a.T @ b
    return out


def logistic_fits(rows: DataFrame, grams: dict[str, np.ndarray], scale: bool, most: int = 25, tol: float = 1e-8) -> dict[str, np.ndarray]:
    """Logistic fits of all folds together: an iteration is one pass in which each row adds to every fold but its own."""
    ship(rows.sparkSession)
    sites = sorted(grams)
    scales = fold_scales(grams, scale)
    p = len(grams[sites[0]]) - 1
    means, sds = np.array([scales[s][1] for s in sites]), np.array([scales[s][2] for s in sites])
    beta = np.zeros((len(sites), p))
    for _ in range(most):

        def run(batches, beta=beta):
            import pyarrow as pa

            total = np.zeros((len(sites), p * p + p))
            for b in batches:
                if not b.num_rows:
                    continue
                site, y = np.array(b.column(0).to_pylist(), object), np.asarray(b.column(1))
                x = np.stack([np.asarray(v.values, float) for v in b.column(2)])
                for k, s in enumerate(sites):
                    m = site != s
                    z = np.column_stack([np.ones(m.sum()), (x[m] - means[k]) / sds[k]])
                    mu = 1 / (1 + np.exp(-np.clip(z @ beta[k], -500, 500)))
                    total[k, : p * p] += ((z * np.maximum(mu * (1 - mu), EPS)[:, None]).T @ z).ravel()
                    total[k, p * p :] += z.T @ (y[m] - mu)
            k = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], names=["k", "v"])

        sums = np.zeros(len(sites) * (p * p + p))
        for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r["k"]] = r["v"]
        sums = sums.reshape(len(sites), -1)
        step = np.array([np.linalg.lstsq(s[: p * p].reshape(p, p), s[p * p :], rcond=None)[0] for s in sums])
        beta = beta + np.clip(step, -10, 10)
        if np.abs(step).max() < tol:
            break
    out = {}
    for k, s in enumerate(sites):
        slopes = beta[k, 1:] / sds[k]
        out[s] = np.concatenate([[beta[k, 0] - (slopes * means[k]).sum()], slopes])
    return out


def auc(rows: DataFrame, keys: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """Rows (keys, auc): rank-sum with average ranks; null where a class is missing.

    Equal scores are counted first, so the running sum holds one row for each distinct score.
    """
    counts = rows.groupBy(*keys, score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = counts.withColumn("w", F.col("pos") * (below + F.col("neg") / 2)).groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return won.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("w") / (F.col("pos") * F.col("neg"))).alias("auc"))


def predictions(rows: DataFrame, fits: dict[str, np.ndarray], trained: dict[str, int], least: int) -> DataFrame:
    """rows with raw, the left-out model's linear prediction; sites with too few training rows are gone."""
    ok = [s for s in fits if trained[s] >= least]
    if not ok:
        return rows.where(F.lit(False)).withColumn("raw", F.lit(None).cast("double"))
    table = local_frame(rows.sparkSession, [{"site": s, "b": fits[s]} for s in ok], "site string, b array<double>")
    raw = F.aggregate(F.zip_with(F.slice("b", F.lit(2), F.size("b")), "x", lambda u, v: u * v), F.get("b", F.lit(0)), lambda s, v: s + v)
    return rows.join(F.broadcast(table), "site").select(*rows.columns, raw.alias("raw"))


def lodo(df: DataFrame, outcome: str, site: str, features: list[str], family: str = "gaussian", positive=None, threshold: float = 0.5, min_train_rows: int = 20, scale_features: bool = True) -> DataFrame:
    """Rows (site, n_train, n_test, status, metrics); metrics are null for skipped sites.

    gaussian: rmse, mae, r2 (squared correlation, null where a side is
    constant). binomial: accuracy, sensitivity, specificity,
    balanced_accuracy, auc. `overall` averages the sites that ran.
    """
    if family not in ("gaussian", "binomial"):
        raise ValueError(f"unknown family {family!r}")
    if family == "binomial" and positive is None:
        raise ValueError("binomial needs the positive class")
    rows = complete(df, outcome, site, features, positive if family == "binomial" else None)
    grams = site_grams(rows)
    if len(grams) < 2:
        raise ValueError("two sites or more are needed")
    trained = {s: v[0] for s, v in fold_scales(grams, scale_features).items()}
    fits = gaussian_fits(grams, scale_features) if family == "gaussian" else logistic_fits(rows, grams, scale_features)
    told = predictions(rows, fits, trained, min_train_rows)
    base = local_frame(df.sparkSession, [{"site": s, "n_train": trained[s], "n_test": int(round(g[0, 0])), "status": "ok" if trained[s] >= min_train_rows else "skipped"} for s, g in grams.items()], "site string, n_train long, n_test long, status string")
    if family == "gaussian":
        err = F.col("y") - F.col("raw")
        flat = (F.coalesce(F.stddev_samp("y"), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_samp("raw"), F.lit(0.0)) == 0)
        m = told.groupBy("site").agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.when(~flat, F.pow(correlation("y", "raw"), 2)).alias("r2"))
    else:
        told = told.withColumn("p", 1 / (1 + F.exp(-F.col("raw")))).withColumn("hit", (F.col("p") >= threshold).cast("double"))
        pos, neg = F.col("y") == 1, F.col("y") == 0
        m = told.groupBy("site").agg(F.avg((F.col("hit") == F.col("y")).cast("double")).alias("accuracy"), F.avg(F.when(pos, F.col("hit"))).alias("sensitivity"), F.avg(F.when(neg, 1 - F.col("hit"))).alias("specificity"))
        m = m.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2).join(auc(told, ["site"]), "site")
    return base.join(m, "site", "left")


def overall(by_site: DataFrame) -> DataFrame:
    """Means of all metrics over the sites that ran."""
    metrics = [c for c in by_site.columns if c not in ("site", "n_train", "n_test", "status")]
    return by_site.where("status = 'ok'").agg(F.count("*").alias("n_sites"), *(F.avg(c).alias(c) for c in metrics))
