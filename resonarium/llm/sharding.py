"""Sharding: small immutable shards, size-tiered compaction, versioned manifests.

Arrivals are written as they come, as small files that never change. Files of
similar size form a tier; a tier of enough files is merged into files of the
target size. Each change of the set of files is one new manifest: it is written
beside the others and renamed to its version number, which fails if another
writer took that number, so readers see either the old set or the new one.
Merging needs no shuffle: the files of a tier are packed into reads of the
target size and each read writes one file. Writes that are not committed yet are
marked, so that removing what no manifest lists leaves them alone.

Manifests list files, so what the driver holds grows with the number of shards
(at 128 MB a shard some 8 thousand entries a TB), not with the rows.

Defined results: rows of any content are kept as they are, repeated ones too;
an empty arrival commits a version without new files; an arrival whose files
were removed before its commit raises Expired and commits nothing; where the rows have a
column of the name of one that `read` adds, the added one gets underscores at
its end until its name is free.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resonarium.session import Scratch

TARGET, FANOUT, ARRIVAL_ROWS = 64_000_000, 4, 2_000
#: Seconds after which the mark of a pending write counts as left by a writer that died.
ABANDONED = 7 * 86_400.0
#: Shards up to which the table of shards is broadcast when it is joined to rows.
BROADCAST_SHARDS = 100_000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


def free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Expired(RuntimeError):
    """Files of an arrival were removed before it was committed; nothing was committed, and the arrival can be appended again."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        """Shards of a version, the newest if none is given."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return []
        stream = self._fs().open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        told = json.loads(text)
        if self.schema is None:
            self.schema = T.StructType.fromJson(told["schema"])
        return [Shard(**x) for x in told["shards"]]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Makes version base + 1 of exactly these shards, or raises Conflict."""
        now = base + 1
        temp, final = (self._path(f"{self.root}/manifest/{n}") for n in (f".{uuid.uuid4().hex}", f"v{now:08d}.json"))
        out = self._fs().create(temp, False)
        out.write(bytearray(json.dumps({"version": now, "schema": self.schema.jsonValue(), "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs().getUri(), self._conf).rename(temp, final, rename)
        except Exception as e:
            self._fs().delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {now} exists") from e
            raise
        return now

    def _written(self, path: str) -> list[Shard]:
        """What a finished write left: one entry for each file that has rows."""
        files = self.spark.read.schema(self.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return sorted((Shard(r["path"], r["bytes"], r["rows"]) for r in files.collect()), key=lambda s: s.path)

    def append(self, df: DataFrame, rows_each: int = ARRIVAL_ROWS) -> int:
        """Writes one arrival as small shards and commits them."""
        if self.schema is None:
            self.manifest()
        if self.schema is None:
            self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        with self._pending("a") as path:
            df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields)).write.option("maxRecordsPerFile", rows_each).option("compression", "zstd").parquet(path)
            new = self._written(path)
            while True:
                base = (self.versions() or [0])[-1]
                gone = [s.path for s in new if not self._fs().exists(self._path(s.path))]
                if gone:
                    raise Expired(f"{len(gone)} files were removed before they were committed, {gone[0]} among them")
                try:
                    return self.commit(self.manifest(base) + new, base)
                except Conflict:
                    continue

    @staticmethod
    def tier(size: int, target: int, fanout: int) -> int:
        """0 for files of at least half the target; each further tier is `fanout` times smaller."""
        return 0 if size * 2 >= target else 1 + int(math.log(target / 2 / max(1, size), fanout))

    def plan(self, target: int = TARGET, fanout: int = FANOUT) -> dict[int, list[Shard]]:
        """Tiers to be merged now: those below the target with at least `fanout` files."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.manifest():
            tiers.setdefault(self.tier(s.bytes, target, fanout), []).append(s)
        return {k: v for k, v in sorted(tiers.items(), reverse=True) if k and len(v) >= fanout}

    @contextmanager
    def _pending(self, kind: str):
        """A new data folder under a mark, which keeps `expire` off it until what is done here is committed or given up."""
        name = f"{kind}-{uuid.uuid4().hex}"
        mark = self._path(f"{self.root}/pending/{name}")
        self._fs().create(mark, False).close()
        try:
            yield f"{self.root}/data/{name}"
        finally:
            self._fs().delete(mark, False)

    def _merged(self, shards: list[Shard], target: int, path: str) -> list[Shard]:
        own = self.spark.newSession()
        for k, v in (("spark.sql.files.maxPartitionBytes", target), ("spark.sql.files.openCostInBytes", 0), ("spark.sql.files.minPartitionNum", 1)):
            own.conf.set(k, str(v))
        own.read.schema(self.schema).parquet(*(s.path for s in shards)).write.option("compression", "zstd").parquet(path)
        return self._written(path)

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int:
        """Merges tiers until none is full; returns the version. A round is one commit and leaves fewer files.

        A tier whose files are packed as well as it goes is left alone, and the next one is looked at.
        """
        settled: set[frozenset[str]] = set()
        while True:
            base = (self.versions() or [0])[-1]
            before = self.manifest(base)
            due = [v for v in self.plan(target, fanout).values() if frozenset(s.path for s in v) not in settled]
            if not due:
                return base
            old, gone = due[0], frozenset(s.path for s in due[0])
            with self._pending("m") as path:
                new = self._merged(old, target, path)
                if len(new) >= len(old):
                    settled.add(gone)
                    self._remove(new)
                    continue
                try:
                    self.commit([s for s in before if s.path not in gone] + new, base)
                except Conflict:
                    self._remove(new)  # an arrival came first; the next round plans anew

    def _remove(self, shards: list[Shard]) -> None:
        for s in shards:
            self._fs().delete(self._path(s.path), False)

    def expire(self, keep: int = 1, abandoned: float = ABANDONED) -> None:
        """Removes manifests but the newest `keep`, and data files that none of those lists and no pending write has made.

        Folders are listed first, then the marks of pending writes, then the
        manifests: a folder without a mark is committed by then, or never will be.
        Marks older than `abandoned` seconds are of writers that died.
        """
        data, marks = self._path(f"{self.root}/data"), self._path(f"{self.root}/pending")
        folders = list(self._fs().listStatus(data)) if self._fs().exists(data) else []
        before = (time.time() - abandoned) * 1000
        pending = {m.getPath().getName() for m in self._fs().listStatus(marks) if m.getModificationTime() > before} if self._fs().exists(marks) else set()
        kept = self.versions()[-keep:]
        live = {self._path(s.path).toUri().getPath() for v in kept for s in self.manifest(v)}
        for v in self.versions()[:-keep]:
            self._fs().delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        for folder in folders:
            if folder.getPath().getName() in pending:
                continue
            inside = self._fs().listStatus(folder.getPath())
            stale = [f for f in inside if f.getPath().toUri().getPath() not in live]
            if len(stale) == len(inside):
                self._fs().delete(folder.getPath(), True)
            else:
                for f in stale:
                    self._fs().delete(f.getPath(), False)

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version, with shard (its number in the manifest), shard_rows and shard_bytes."""
        shards = self.manifest(version)
        own = self.schema.fieldNames()
        path, *added = (free(c, own) for c in ("_path", "shard", "shard_rows", "shard_bytes"))
        told = self.spark.createDataFrame([(s.path, k, s.rows, s.bytes) for k, s in enumerate(shards)], "p string, k int, r long, b long").toDF(path, *added)
        if len(shards) <= BROADCAST_SHARDS:
            told = F.broadcast(told)
        if not shards:
            return self.spark.createDataFrame([], self.schema).withColumns({c: F.lit(None).cast(t) for c, t in zip(added, ("int", "long", "long"))})
        rows = self.spark.read.schema(self.schema).parquet(*(s.path for s in shards))
        return rows.withColumn(path, rows.metadataColumn("_metadata")["file_path"]).join(told, path).select(*(F.col(f"`{c}`") for c in (*own, *added)))


def shard(docs: DataFrame, arrivals: int = 4, id_col: str = "doc_id", target: int = TARGET, fanout: int = FANOUT) -> ShardStore:
    """A store of docs, taken in as `arrivals` arrivals by hash of the id, compacted and without stale files."""
    spark = docs.sparkSession
    store = ShardStore(spark, Scratch(spark, "shards").root)  # goes when the session ends
    part = F.pmod(F.xxhash64(id_col), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(part == k))
    store.compact(target, fanout)
    store.expire()
    return store


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return store.read().select("doc_id", "shard", "shard_rows", "shard_bytes", F.sha2("text", 256).alias("text_sha256"))
