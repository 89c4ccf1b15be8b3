"""Scratch tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    A temporary folder stands in only where the setting is absent and the
    session is a single local process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="twinaxis-")
    return _LOCAL_ROOT[app]


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any store that Spark can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of the driver's bookkeeping, None without one."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file: readers see the old text or the new one."""
    fs, p = hadoop_path(spark, path)
    _, made = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(made, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(made, p, options)


_SCOPES: list[list[Scratch]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the scratch tables made inside; results must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for s in _SCOPES.pop():
            s.close()


class Scratch:
    """Named Parquet tables in the shared folder.

    Writing a table and reading it again cuts the lineage, so the loss of an
    executor costs the tasks it ran and never the steps before the table. The
    tables live until close(), the end of the scope() they were made in, or at
    the latest the end of the driver, which results that still read them share.
    """

    def __init__(self, spark: SparkSession, purpose: str, path: str | None = None):
        """Tables under a path of the caller's own stay until they are dropped."""
        self.spark = spark
        self.path = path.rstrip("/") if path else f"{shared_root(spark)}/twinaxis/{purpose}-{uuid.uuid4().hex}"
        if not path:
            fs, p = hadoop_path(spark, self.path)
            fs.mkdirs(p)
            fs.deleteOnExit(p)
            if _SCOPES:
                _SCOPES[-1].append(self)

    def save(self, df: DataFrame, name: str = "t", compression: str = "zstd") -> DataFrame:
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._twinaxis_at = at
        return out

    def open(self, name: str) -> DataFrame:
        """A table of this folder by name_of()."""
        out = self.spark.read.parquet(f"{self.path}/{name}")
        out._twinaxis_at = f"{self.path}/{name}"
        return out

    @staticmethod
    def name_of(table: DataFrame) -> str:
        return table._twinaxis_at.rsplit("/", 1)[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step and no result reads."""
        for t in tables:
            fs, p = hadoop_path(self.spark, t._twinaxis_at)
            fs.delete(p, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        kept = {self.name_of(t) for t in tables}
        fs, p = hadoop_path(self.spark, self.path)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in kept:
                fs.delete(s.getPath(), True)

    def close(self) -> None:
        fs, p = hadoop_path(self.spark, self.path)
        fs.delete(p, True)
