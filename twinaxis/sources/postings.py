"""A stored search index: blocks of postings by term and the facts they belong to.

One table holds a run of rows for each block of datoms, sorted by term. The row
of a term lists the slots (places in the block) of the facts that have it and how
often each does (n). The row of the empty term, which no text has, holds the
facts: the datoms without their values, with the number of their terms; they
decide what is carried at an instant and sum up to the total. A query's terms
reach the scan and skip all other pages; no search reads a text again.

A block is made by the task that reads its datoms, in memory of bounded size, so
building shuffles and spills nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import analyze
from ..model import DATOMS
from ..operators.search import FACTS

FACT = T.StructType([T.StructField(f, DATOMS[f].dataType) for f in FACTS] + [T.StructField("n", T.LongType())])
BLOCKS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("slots", T.ArrayType(T.IntegerType())),
        T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("facts", T.ArrayType(FACT)),
    ]
)
#: A block is closed before it holds more; a text of more terms is a block of its own.
BLOCK_TERMS, BLOCK_FACTS = 1 << 21, 1 << 14


def _rows(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block of (fact, t): its facts, then its terms in order."""
    facts, texts = (pa.concat_arrays([b.column(c) for b in held]) for c in ("fact", "t"))
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(facts)

    def batch(term: pa.Array, slots: pa.Array | None, n: pa.Array | None, facts: pa.Array | None) -> pa.RecordBatch:
        own = [term, pa.array(np.full(len(term), block)), slots, n, facts]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), fact_lists.type]
        return pa.RecordBatch.from_arrays([pa.nulls(len(term), k) if x is None else x for x, k in zip(own, kinds, strict=True)], BLOCKS.names)

    fields = [f.name for f in facts.type]
    numbered = pa.StructArray.from_arrays([*facts.flatten(), pa.array(lengths)], [*fields, "n"])
    fact_lists = pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), numbered)
    yield batch(pa.array([""]), None, None, fact_lists)
    words = texts.flatten().dictionary_encode()
    if not len(words):
        return
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # One number an occurrence; equal ones are the occurrences of a term in a fact.
    each = rank[words.indices.to_numpy()] * width + np.repeat(np.arange(width), lengths)
    each.sort()
    first = np.flatnonzero(np.diff(each, prepend=-1))
    n = np.diff(first, append=len(each)).astype(np.int32)
    term, slot = np.divmod(each[first], width)
    starts = pa.array(np.searchsorted(term, np.arange(len(order) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (slot.astype(np.int32), n)]
    yield batch(words.dictionary.take(pa.array(order)), *lists, None)


def _blocks(terms: int, facts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, rows, words = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                fit = min(int(np.searchsorted(ends, before + terms - words, "right")) - at, facts - rows)
                if fit <= 0 and held:
                    yield from _rows(block, held)
                    block, held, rows, words = block + 1, [], 0, 0
                    continue
                fit = max(fit, 1)
                held.append(batch.slice(at, fit))
                at += fit
                rows, words = rows + fit, words + int(ends[at - 1] - before)
        if held:
            yield from _rows(block, held)

    return run


class SearchIndex:
    """The index of one tenant's datoms under a folder."""

    #: Of the stored tables; an index of another layout is not used.
    LAYOUT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Totals that were asked for, by attributes and snapshot; the index does not change.
        self.totals: dict[tuple, int] = {}

    @classmethod
    def build(cls, spark: SparkSession, datoms: DataFrame, path: str, block_terms: int = BLOCK_TERMS, block_facts: int = BLOCK_FACTS) -> SearchIndex:
        """Indexes datoms that hold no repeats."""
        index = cls(spark, path)
        tokens = F.when(F.col("assert") & ~F.col("is_reference"), analyze(F.col("value")))
        rows = datoms.select(F.struct(*FACTS).alias("fact"), tokens.alias("t"))
        rows.mapInArrow(_blocks(block_terms, block_facts), BLOCKS).write.option("compression", "zstd").parquet(f"{index.path}/blocks")
        return index

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.path}/blocks")

    @property
    def facts(self) -> DataFrame:
        """(block, slot) and the facts there."""
        return self.blocks.where("term = ''").select("block", F.posexplode("facts").alias("slot", "f")).select("block", "slot", "f.*")

    @property
    def places(self) -> DataFrame:
        """(term, block, slot, n): how often the fact at a place has a term."""
        return self.blocks.select("term", "block", F.explode(F.arrays_zip("slots", "n")).alias("p")).select("term", "block", F.col("p.slots").alias("slot"), "p.n")

    @property
    def postings(self) -> DataFrame:
        """(term, entity, attribute, tx, ord, n): how often a term occurs in an asserted literal."""
        own = ["entity", "attribute", "tx", "ord"]
        return self.places.join(self.facts.select("block", "slot", *own), ["block", "slot"]).select("term", *own, "n")
