"""Session helpers: making the package importable on executors, and scratch tables.

Nothing here depends on a driver-local folder being visible to executors: code
travels through ``addPyFile`` and intermediate tables go to the shared folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, names in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join(os.path.basename(top), os.path.relpath(p, top)))
    path = os.path.join(tempfile.mkdtemp(), "resonarium_code.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; in local mode a temporary one where the session names none.

    On a cluster a folder of the driver's own would be read by executors that
    cannot see it, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    made = spark.sparkContext.getConf().get("spark.resonarium.scratch")
    if made is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        made = _OWN.setdefault(key, "file://" + tempfile.mkdtemp(prefix="resonarium-"))
    return made


_OWN: dict[str, str] = {}


class Scratch:
    """Written tables that cut lineage; ``drop`` removes one, the rest go at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def save_by(self, df: DataFrame, key: str, deal: bool = False) -> DataFrame:
        """Like save, in buckets of `key`, so that joins by this one column don't shuffle the table. deal: rows are shuffled by bucket before, so that a bucket is one file."""
        self.n += 1
        path, name = f"{self.root}/{self.n}", f"scratch_{uuid.uuid4().hex}"
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df = df.repartition(buckets, key) if deal else df
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)], self._tables = path, [*getattr(self, "_tables", []), name]
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def path_of(self, df: DataFrame) -> str:
        return self.paths[id(df)]

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            self._delete(path)
            self._keep = [x for x in self._keep if x is not df]

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for name in getattr(self, "_tables", []):
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self._delete(self.root)
        except Exception:  # the session has ended already; nothing left to clean with
            pass
