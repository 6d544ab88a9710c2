"""Moving between tall samples and packed signals, and running array kernels over rows.

Tall samples have (recording, channel, idx, value). A packed signal is one row
with its values in order of idx. Kernels run in Arrow batches, one row at a
time inside, so pairs, replicates, segments and bands are what is spread over
the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from resonarium.session import ship


def _value(column: pa.Array, i: int):
    if not column[i].is_valid:
        return None
    if pa.types.is_list(column.type) and (pa.types.is_floating(column.type.value_type) or pa.types.is_integer(column.type.value_type)):
        return np.asarray(column[i].values, float)
    return column[i].as_py()


def map_rows(df: DataFrame, kernel: Callable[..., dict | Iterable[dict] | None], schema: str, keep: list[str] = (), rows_each: int = 512) -> DataFrame:
    """Calls kernel(**row) for each row; its result (a dict, several, or None) becomes rows of `keep` + schema.

    A ValueError raised by a kernel becomes a row with status = its message if
    the schema has a status column, and ends the job otherwise.
    """
    ship(df.sparkSession)
    named = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(schema).fields)
    arrow, columns, has_status = to_arrow_schema(named), df.columns, "status" in T.StructType.fromDDL(schema).names

    def plain(v):
        if isinstance(v, np.ndarray):
            return v.tolist()
        return v.item() if isinstance(v, np.generic) else v

    def run(batches):
        for b in batches:
            out: list[dict] = []
            for i in range(b.num_rows):
                row = {c: _value(b.column(k), i) for k, c in enumerate(columns)}
                try:
                    got = kernel(**row)
                except ValueError as e:
                    if not has_status:
                        raise
                    got = {"status": str(e)}
                for r in [got] if isinstance(got, dict) else got or ():
                    if has_status:
                        r = {"status": "ok"} | r
                    out.append({c: plain(row[c]) for c in keep} | {k: plain(v) for k, v in r.items()})
                if len(out) >= rows_each:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, named)


def pack(samples: DataFrame, keys: list[str] = ("recording", "channel"), idx: str = "idx", value: str = "value", name: str = "x") -> DataFrame:
    """One row a signal, values in order."""
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v")))).alias("_s"))
    return rows.select(*keys, F.col("_s.v").alias(name))


def unpack(packed: DataFrame, name: str = "x", idx: str = "idx", value: str = "value") -> DataFrame:
    return packed.select(*(c for c in packed.columns if c != name), F.posexplode(name).alias(idx, value))


def ordered_pairs(signals: DataFrame, columns: list[str], within: list[str] = ("recording",), both: bool = False) -> DataFrame:
    """Pairs of channels of one recording: columns with suffix _x and _y; each unordered pair once unless `both`."""
    left = signals.select(*within, F.col("channel").alias("channel_x"), *(F.col(c).alias(f"{c}_x") for c in columns))
    right = signals.select(*within, F.col("channel").alias("channel_y"), *(F.col(c).alias(f"{c}_y") for c in columns))
    return left.join(right, list(within)).where("channel_x != channel_y" if both else "channel_x < channel_y")


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson's correlation, null where a side is constant (corr itself ends the job there in ANSI mode)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def gram(rows: DataFrame, features: str, extra: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products, sums and count of an array column: one partial matrix a task, then p*p sums."""
    ship(rows.sparkSession)

    def run(batches):
        total, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v.values, float) for v in b.column(0)])
            x = np.column_stack([x, np.ones(len(x))])
            total = x.T @ x if total is None else total + x.T @ x
            n += len(x)
        if total is not None:
            k = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], names=["k", "v"])

    got = rows.select(features).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    size = int(round(np.sqrt(len(got))))
    m = np.zeros(size * size)
    for r in got:
        m[r["k"]] = r["v"]
    m = m.reshape(size, size)
    return m[:-1, :-1], m[-1, :-1], int(round(m[-1, -1])) if size else 0


def centred(g: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Sums of products about the means."""
    return g - np.outer(s, s) / n


def project(rows: DataFrame, features: str, offset: np.ndarray, weights: np.ndarray, name: str = "scores") -> DataFrame:
    """Adds an array column (features - offset) @ weights."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {name} array<double>"
    at = rows.columns.index(features)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v.values, float) for v in b.column(at)])
            y = (x - offset) @ weights
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return rows.mapInArrow(run, schema)


def local_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small result (Gram-sized) as a DataFrame."""
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else v
    names = T.StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(plain(r.get(c)) for c in names) for r in rows], schema)


def lists(arrays) -> pa.Array:
    """Arrays of doubles as a list column, without going through Python numbers."""
    arrays = [np.asarray(a, float).ravel() for a in arrays]
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0), *arrays])))


def map_groups(df: DataFrame, kernel: Callable[[dict, dict], list[dict] | None], schema: str, keep: list[str], arrays: list[str], rows_each: int = 32) -> DataFrame:
    """Calls kernel(row) with plain values, columns of doubles as numpy arrays; its dicts become rows of keep + schema.

    Like map_rows, for rows of long arrays: those named in `arrays` leave as
    numpy arrays too, so no number is made a Python object.
    """
    ship(df.sparkSession)
    named = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(schema).fields)
    arrow, columns = to_arrow_schema(named), df.columns

    def batch(out: list[dict]) -> pa.RecordBatch:
        cols = []
        for f in arrow:
            values = [r[f.name] for r in out]
            cols.append(lists(values).cast(f.type) if f.name in arrays else pa.array(values, f.type))
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        out: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: _value(b.column(k), i) for k, c in enumerate(columns)}
                for r in kernel(**row) or ():
                    out.append({c: row[c] for c in keep} | r)
                    if len(out) >= rows_each:
                        yield batch(out)
                        out = []
        if out:
            yield batch(out)

    return df.mapInArrow(run, named)
