"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of Parquet files and a folder of manifest versions. append()
writes arrivals as small files, one a task, and commits them. compact() takes the
tiers of similar size that hold enough runs, merges each into files of about the
target size and commits the result; it repeats until no tier is full. Nothing is
shuffled for a merge: the runs are read with splits of the target size, so Spark
packs whole runs into one task, and every task writes one file.

Files are never changed. A version is a Parquet folder of the files it adds and
removes (every SNAPSHOT_EVERY-th one lists all files), written beside the others
and renamed into place; the rename fails if the version exists, so of two writers
one commits and the other starts again from the new version. That needs a store
whose rename is atomic and refuses an existing target, as HDFS and local file
systems do; on an object store the folder of manifests has to lie on one that
has conditional writes behind its rename. Readers take the greatest version and
read the files it names.

A writer marks its folder as staged before it writes and takes the mark away
after its commit. vacuum() leaves staged folders, the last versions and those
younger than a grace, so it harms neither appends under way nor readers; a writer
that dies leaves a mark, which holds for ABANDONED seconds.

Only DataFrame operations and Parquet touch the rows. The driver handles file
names and one manifest row for each file it merges.

Defined results: rows are kept as they are, whatever nulls, repeats, very long
texts or extra columns they have; arrivals with different columns are read and
merged under all of them, null where a row has none; runs of equal size are
merged in the order of their names; an empty append commits a version without
new files; reading a store without files needs a schema and gives no rows.
"""

from __future__ import annotations

import contextlib
import math
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path

#: The tier of runs that no merge can take further.
FULL = 1000
MANIFEST = "file string, bytes long, n_rows long, tier int, added_in long"
DELTA = MANIFEST + ", removed boolean, version long"
SNAPSHOT_EVERY = 16
#: Seconds after which a staged folder counts as left by a dead writer.
ABANDONED = 7 * 86_400


class CommitConflict(Exception):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, ratio: int = 4, fan_in: int = 4):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.least_bytes, self.ratio, self.fan_in = target_bytes, least_bytes, ratio, fan_in

    def _list(self, folder: str) -> list:
        fs, p = hadoop_path(self.spark, f"{self.path}/{folder}")
        return list(fs.listStatus(p)) if fs.exists(p) else []

    # Versions

    def _versions(self) -> dict[int, object]:
        names = {s.getPath().getName(): s for s in self._list("manifest")}
        return {int(n[1:]): s for n, s in names.items() if n[0] == "v" and n[1:].isdigit()}

    def version(self) -> int:
        return max(self._versions(), default=0)

    @staticmethod
    def _snapshot(version: int) -> int:
        """The version that lists all files, or 0, from which a version is read."""
        return version - version % SNAPSHOT_EVERY

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        own = [f"{self.path}/manifest/v{v}" for v in range(max(1, self._snapshot(version)), version + 1)]
        last = F.max(F.struct("version", "removed", "bytes", "n_rows", "tier", "added_in")).alias("m")
        rows = self.spark.read.schema(DELTA).parquet(*own).groupBy("file").agg(last).where("not m.removed")
        return rows.select("file", "m.bytes", "m.n_rows", "m.tier", "m.added_in")

    def _commit(self, base: int, added: DataFrame, removed: DataFrame | None = None) -> int:
        """Publishes the version after base, or raises CommitConflict; a file in both is added."""
        now = base + 1
        if removed is not None:
            removed = removed.join(added.select("file"), "file", "left_anti")
        if now % SNAPSHOT_EVERY:
            rows = added.withColumn("removed", F.lit(False))
            if removed is not None:
                rows = rows.unionByName(removed.withColumn("removed", F.lit(True)))
        else:
            rows = self.manifest(base).join(added.select("file"), "file", "left_anti")
            if removed is not None:
                rows = rows.join(removed.select("file"), "file", "left_anti")
            rows = rows.unionByName(added).withColumn("removed", F.lit(False))
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifest")
        fs.mkdirs(folder)
        made = f"{self.path}/manifest/_new-{uuid.uuid4().hex}"
        rows.withColumn("version", F.lit(now).cast("long")).coalesce(1).write.parquet(made)
        _, source = hadoop_path(self.spark, made)
        _, target = hadoop_path(self.spark, f"{self.path}/manifest/v{now}")
        # FileSystem.rename would move the folder into an existing one; this rename fails there.
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, none)
        except Exception as e:
            fs.delete(source, True)
            if fs.exists(target):
                raise CommitConflict(f"version {now} exists") from e
            raise
        return now

    # Files

    def _tier(self):
        steps = F.log(F.greatest(F.col("bytes"), F.lit(self.least_bytes)) / self.least_bytes) / math.log(self.ratio)
        return F.floor(steps + 1e-9).cast("int")

    def _written(self, folder: str, added_in: int) -> DataFrame:
        """Manifest rows of the files of one write; reads footers and no column."""
        files = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return files.agg(F.count("*").alias("n_rows")).select("file", "bytes", "n_rows", self._tier().alias("tier"), F.lit(added_in).cast("long").alias("added_in"))

    @contextlib.contextmanager
    def _staged(self, base: int) -> Iterator[str]:
        """The name of a new data folder that vacuum() leaves alone inside."""
        name = f"{base + 1}-{uuid.uuid4().hex}"
        fs, mark = hadoop_path(self.spark, f"{self.path}/staged/{name}")
        fs.create(mark, False).close()
        yield name
        fs.delete(mark, False)

    def append(self, df: DataFrame) -> int:
        """Writes df as new shards and commits them; returns the version."""
        base = self.version()
        with self._staged(base) as name:
            folder = f"{self.path}/data/{name}"
            df.write.option("compression", "zstd").parquet(folder)
            new = self._written(folder, base + 1)
            while True:
                try:
                    return self._commit(base, new)
                except CommitConflict:
                    base = self.version()

    def compact(self) -> int:
        """Merges full tiers until there is none; returns the version."""
        while True:
            base = self.version()
            now = self.manifest(base)
            tiers = now.where((F.col("bytes") < self.target_bytes) & (F.col("tier") < FULL)).groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan_in)
            tiers = [r["tier"] for r in tiers.orderBy("tier").collect()]
            if not tiers:
                return base
            tier = tiers[0]
            runs = now.where((F.col("tier") == tier) & (F.col("bytes") < self.target_bytes))
            files = [r["file"] for r in runs.select("file").orderBy("file").collect()]
            packed = self.spark.newSession()
            size = int(runs.agg(F.sum("bytes")).first()[0])
            # Files of even size, none over the target by more than one run.
            split = math.ceil(size / max(1, round(size / self.target_bytes))) if size > self.target_bytes else size
            packed.conf.set("spark.sql.files.maxPartitionBytes", str(split + 1))
            packed.conf.set("spark.sql.files.openCostInBytes", "0")
            packed.conf.set("spark.sql.files.minPartitionNum", "1")
            with self._staged(base) as name:
                folder = f"{self.path}/data/{name}"
                packed.read.option("mergeSchema", "true").parquet(*files).write.option("compression", "zstd").parquet(folder)
                new = self._written(folder, base + 1)
                if new.count() >= len(files):
                    # Runs too large to go together stay as they are and count as full.
                    new = runs.withColumn("tier", F.lit(FULL))
                # After a conflict the runs may be merged already: the next round looks again.
                with contextlib.suppress(CommitConflict):
                    self._commit(base, new, runs)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """All rows of a version, with _metadata of the files."""
        files = [r["file"] for r in self.manifest(version).select("file").collect()]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("mergeSchema", "true").parquet(*files)

    def vacuum(self, keep_versions: int = 2, grace_seconds: float = 86_400) -> None:
        """Deletes older versions, and the files that no kept version names and no writer has staged.

        The last keep_versions and all versions and files younger than the grace are kept.
        """
        now = time.time()
        age = lambda s: now - s.getModificationTime() / 1000
        # In this order: a file seen here was staged before, and its mark goes only after a version names it.
        files = [(folder.getPath().getName(), f) for folder in self._list("data") for f in self._list(f"data/{folder.getPath().getName()}")]
        staged = {s.getPath().getName() for s in self._list("staged") if age(s) < ABANDONED}
        versions = self._versions()
        last = max(versions, default=0)
        kept = [v for v, s in versions.items() if v > last - keep_versions or age(s) < grace_seconds]
        named: set[str] = set()
        for v in kept:
            named |= {"/".join(r["file"].rsplit("/", 2)[-2:]) for r in self.manifest(v).select("file").toLocalIterator()}
        fs, _ = hadoop_path(self.spark, self.path)
        for folder, f in files:
            if folder not in staged and f"{folder}/{f.getPath().getName()}" not in named and (age(f) >= grace_seconds or f.getPath().getName()[0] in "._"):
                fs.delete(f.getPath(), False)
        least = self._snapshot(min(kept, default=0))
        for v, s in versions.items():
            if v not in kept and v < least:
                fs.delete(s.getPath(), True)


def shard_documents(store: ShardStore, docs: DataFrame, grace_seconds: float = 86_400) -> DataFrame:
    """Appends docs, compacts, and returns every row's doc_id with the shard it lies in."""
    store.append(docs)
    version = store.compact()
    store.vacuum(1, grace_seconds)
    shards = store.manifest(version).select("file", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"), F.col("tier"))
    if shards.isEmpty():
        return store.spark.createDataFrame([], "doc_id long, shard long, shard_rows long, shard_bytes long, tier int, version long")
    rows = store.read(version)
    return (
        rows.select("doc_id", F.col("_metadata.file_path").alias("file"))
        .join(shards, "file")
        .select("doc_id", F.xxhash64("file").alias("shard"), "shard_rows", "shard_bytes", "tier", F.lit(version).cast("long").alias("version"))
    )
