"""A leaf store: an append-only folder of Parquet segments and a tail in memory.

A segment is a folder named by a random id, written beside the others and
renamed into place. Superseded datoms are never dropped; compaction merges
segments of similar size and removes full-row repeats among them, so a datom is
rewritten once a tier and a large segment is left alone by small ones. Merged
segments are marked as gone and deleted after a grace, for the sake of readers.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NoBound, NoSnapshot
from ..model import DATOMS, TxId
from ..operators.carried import deduplicate, entities, history, referrers, shape_of
from ..operators.temporal import Snapshot, visible
from ..scratch import hadoop_path

#: Encoded bytes of a datom beside its names and its value.
FIXED_BYTES = 74


@dataclass(frozen=True)
class Policy:
    """When the tail is sealed and the segments are compacted; ages in the unit of tx.wall."""

    max_bytes: int = 0
    max_age: int = 0
    max_segments: int = 8

    def should_seal(self, size: int, oldest: int | None, now: int) -> bool:
        if not self.max_bytes and not self.max_age:
            raise NoBound("a policy needs a bound of bytes or of age")
        if oldest is None:
            return False
        return bool(self.max_bytes and size >= self.max_bytes) or bool(self.max_age and now - oldest >= self.max_age)

    def should_compact(self, segments: int) -> bool:
        return segments >= self.max_segments


def exposure(datoms: DataFrame) -> DataFrame:
    """One row: datoms, their encoded bytes and the oldest wall clock; what a loss of the tail would cost."""
    size = FIXED_BYTES + F.octet_length("entity") + F.octet_length("attribute") + F.octet_length("value")
    return datoms.agg(F.count("*").alias("datoms"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("bytes"), F.min("tx.wall").alias("oldest"))


class LeafStore:
    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd", ratio: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.path, self.compression = spark, path.rstrip("/"), compression
        self.ratio, self.least_bytes = ratio, least_bytes
        self.tail: list[tuple] = []

    def exposed(self) -> tuple[int, int | None]:
        """(bytes, oldest wall clock) of the tail."""
        sizes = [FIXED_BYTES + sum(len(x.encode()) for x in r[1:4]) for r in self.tail]
        return sum(sizes), min((r[8][0] for r in self.tail), default=None)

    def append(self, rows: list[tuple]) -> None:
        """Adds rows of DATOMS to the tail; durable after seal()."""
        self.tail += rows

    def segments(self) -> list[str]:
        fs, p = hadoop_path(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p)}
        return sorted(path for name, path in names.items() if name.startswith("seg-") and f"gone-{name}" not in names)

    def _publish(self, df: DataFrame) -> None:
        fs, folder = hadoop_path(self.spark, self.path)
        fs.mkdirs(folder)
        name = uuid.uuid4().hex
        made = f"{self.path}/_new-{name}"
        # Entities lie together, so row groups have narrow ranges of names.
        df.sortWithinPartitions("entity", "attribute").write.option("compression", self.compression).parquet(made)
        _, source = hadoop_path(self.spark, made)
        _, target = hadoop_path(self.spark, f"{self.path}/seg-{name}")
        if not fs.rename(source, target):
            raise OSError(f"could not publish {target}")

    def seal(self) -> None:
        if self.tail:
            self._publish(self.spark.createDataFrame(self.tail, DATOMS).coalesce(1))
            self.tail = []

    def _spread(self, datoms: DataFrame) -> DataFrame:
        """Ranges of entities; the history of a single one may span several."""
        return datoms.repartitionByRange("entity", "attribute", "tx")

    def write(self, datoms: DataFrame) -> None:
        """Publishes a whole DataFrame of datoms as a segment."""
        self._publish(self._spread(datoms))

    def tiers(self) -> dict[int, list[str]]:
        """Segments by size: each tier's are up to ratio times as large as the one's below."""
        out: dict[int, list[str]] = {}
        for path in self.segments():
            fs, p = hadoop_path(self.spark, path)
            size = max(self.least_bytes, fs.getContentSummary(p).getLength())
            out.setdefault(int(math.log(size / self.least_bytes, self.ratio) + 1e-9), []).append(path)
        return out

    def sweep(self, grace_seconds: float = 86_400) -> None:
        """Deletes the segments that were merged longer ago than the grace."""
        fs, p = hadoop_path(self.spark, self.path)
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.startswith("gone-") and time.time() - s.getModificationTime() / 1000 >= grace_seconds:
                _, old = hadoop_path(self.spark, f"{self.path}/{name.removeprefix('gone-')}")
                fs.delete(old, True)
                fs.delete(s.getPath(), False)

    def compact(self, least: int = 2, grace_seconds: float = 86_400) -> bool:
        """Merges the segments of each tier that holds at least so many, smallest tier first;
        readers see the old segments, the new one, or both, which is the same datoms."""
        merged = False
        while full := [paths for _, paths in sorted(self.tiers().items()) if len(paths) >= least]:
            self._publish(self._spread(deduplicate(self._read(full[0]))))
            for path in full[0]:
                fs, mark = hadoop_path(self.spark, f"{self.path}/gone-{path.rsplit('/', 1)[-1]}")
                fs.create(mark, True).close()
            merged = True
        self.sweep(grace_seconds)
        return merged

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], DATOMS)
        return self.spark.read.schema(DATOMS).parquet(*paths)

    def raw(self) -> DataFrame:
        """Segments and tail as they are."""
        out = self._read(self.segments())
        return out.unionByName(self.spark.createDataFrame(self.tail, DATOMS)) if self.tail else out

    def datoms(self) -> DataFrame:
        """Segments and tail, each datom once."""
        return deduplicate(self.raw())

    def load(self, entity: str, at: Snapshot) -> DataFrame:
        if at.known is not None and at.known == TxId(0):
            raise NoSnapshot("the zero transaction names no snapshot")
        return visible(deduplicate(self.raw().where(F.col("entity") == entity)), at)

    def history(self, entity: str) -> DataFrame:
        return history(self.raw(), entity)

    def entities(self) -> DataFrame:
        return entities(self.raw())

    def referrers(self, target: str, at: Snapshot) -> DataFrame:
        return referrers(self.raw(), target, at)

    def attributes(self, entity: str, at: Snapshot) -> DataFrame:
        return shape_of(self.datoms().where(F.col("entity") == entity), at)

    def last(self) -> TxId | None:
        """The greatest transaction id stored."""
        t = self.raw().agg(F.max("tx").alias("t")).first()["t"]
        return TxId(t["wall"], t["logical"], bytes(t["leaf_prefix"]), t["leaf_depth"], t["seq"]) if t else None
