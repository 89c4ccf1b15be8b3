"""Log tailing with Structured Streaming: at-least-once delivery to idempotent sinks.

The log is a folder of Parquet files of datoms, each file a published run of
entries. The stream's checkpoint is the cursor. A batch that is delivered again
after a crash replaces itself; a datom that comes again in another batch lies at
or below the high-water mark of its transaction ids and is looked up there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DATOMS, TxId
from ..operators.search import postings
from ..scratch import read_text, write_text


def tail(spark: SparkSession, log: str, files_per_batch: int = 100) -> DataFrame:
    """The log as a streaming DataFrame of datoms."""
    return spark.readStream.schema(DATOMS).option("maxFilesPerTrigger", files_per_batch).parquet(log)


def deliver(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Delivers everything after the cursor to the sink, then returns; the cursor moves
    past a batch only when the sink has returned."""
    query = log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def published(entries: DataFrame, bound: TxId | None) -> DataFrame:
    """Entries up to a bound of recording; later ones are skipped, they do not end the read."""
    return entries if bound is None else entries.where(F.col("tx") <= bound.column())


class PostingsIndex:
    """A postings table built by a stream. Each batch is a folder named by its number, so a
    batch that comes again replaces itself; datoms that come again in another batch are left out.

    marks.json has the range of wall clocks of each batch. A batch above the high-water mark of
    all others is new and is written without a look; only batches whose ranges meet are joined.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def marks(self) -> dict[int, tuple[int, int]]:
        text = read_text(self.spark, f"{self.path}/marks.json")
        return {int(k): tuple(v) for k, v in json.loads(text).items()} if text else {}

    def consume(self, batch: DataFrame, number: int) -> None:
        keys = ["entity", "attribute", "value", "is_reference", "valid_from", "valid_to", "assert", "tx", "tenant"]
        batch = batch.dropDuplicates(keys)
        own = batch.agg(F.min("tx.wall").alias("low"), F.max("tx.wall").alias("high")).first()
        if own["low"] is None:
            return
        marks = self.marks()
        meets = [k for k, (low, high) in marks.items() if k != number and low <= own["high"] and high >= own["low"]]
        for k in meets:
            done = self.spark.read.schema(DATOMS).parquet(f"{self.path}/batch={k}")
            batch = batch.join(done.select(*keys), keys, "left_anti")
        batch.select(*DATOMS.names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        # The mark comes last: after a crash between the two the batch comes again and replaces itself.
        write_text(self.spark, f"{self.path}/marks.json", json.dumps({**marks, number: (own["low"], own["high"])}))

    def datoms(self) -> DataFrame:
        marks = self.marks()
        own = [f"{self.path}/batch={k}" for k in marks]
        return self.spark.read.schema(DATOMS).parquet(*own) if own else self.spark.createDataFrame([], DATOMS)

    def postings(self) -> DataFrame:
        return postings(self.datoms())

    def cursor(self) -> TxId | None:
        t = self.datoms().agg(F.max("tx").alias("t")).first()["t"]
        return TxId(t["wall"], t["logical"], bytes(t["leaf_prefix"]), t["leaf_depth"], t["seq"]) if t else None
