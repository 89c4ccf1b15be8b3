"""Reversible line dedup: sharded cuckoo filters before exact reference tables.

A line's key is the line stripped of 0x20 and 0x09-0x0D at both ends, with A-Z
lower-cased; keys of fewer than ten code points never count. The index holds

- references: one row (key, doc_id) for each row of a document that has a line;
- counts: (key, n, first, last), the references of a key counted, in one run of
  rows for each insertion: the exact table;
- filters: one cuckoo filter a shard with every key that is referenced. When the
  keys outgrow the shards, their number doubles and the filters are built again
  from the counts, so a shard stays of bounded size however the index grows.

To insert documents, their keys are counted with map-side combine and go, one
row a key, to their shards. A key that comes once and is not in the filter is
certainly new, so only the others, the candidates, are looked up in the counts
of earlier insertions; old references are not read again. Deleting documents
takes their references out, counts the rest anew and takes the keys that nobody
references any more out of the filters, which leaves the index as if they had
never come (up to chance candidates, which the exact counts refuse).

The state is a small file that names the tables of the index; it is replaced
after each change, so an index under a path can be opened again. One writer at
a time may change an index.

Defined results: null and empty texts are one empty line; a null id holds no
references and its rows lose no line; rows that repeat an id are one document
(n_docs counts rows); columns named n_lines and n_dropped are replaced, all
others pass unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, read_text, write_text
from .cuckoo import CuckooFilter

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CODE_POINTS = 10
KEYS_PER_SHARD = 250_000
GONE = "__line_dedup_gone"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def references(docs: DataFrame) -> DataFrame:
    """(key, doc_id): the MD5 of each distinct key of each row that is long enough."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= LEAST_CODE_POINTS))
    return (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(keys).alias("k"))
        .select(F.unhex(F.md5("k")).alias("key"), "doc_id")
    )


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2].copy() if len(keys) else np.zeros(0, np.uint64)


def _insert(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.from_bytes(filters["filter"].iat[0]) if len(filters) else CuckooFilter(len(keys))
    h = _hashes(keys["key"])
    seen = f.contains(h)
    f.insert(h[~seen])
    shard = (keys if len(keys) else filters)["shard"].iat[0]
    keys = keys.reset_index(drop=True)
    again = keys["key"][seen | (keys["n"].to_numpy() > 1)]
    rows = {"shard": shard, "key": [None, *again], "seen": [False, *seen[again.index]], "filter": [f.to_bytes(), *[None] * len(again)]}
    return pd.DataFrame(rows)


def _add(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.from_bytes(filters["filter"].iat[0])
    f.insert(_hashes(keys["key"]))
    return pd.DataFrame({"shard": filters["shard"], "filter": [f.to_bytes()]})


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter(len(keys))
    f.insert(_hashes(keys["key"]))
    return pd.DataFrame({"shard": keys["shard"][:1], "filter": [f.to_bytes()]})


def _delete(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.from_bytes(filters["filter"].iat[0])
    if len(keys):
        f.delete(_hashes(keys["key"]))
    return pd.DataFrame({"shard": filters["shard"], "filter": [f.to_bytes()]})


FILTERS = "shard int, filter binary"


def counted(refs: DataFrame) -> DataFrame:
    """(key, n, first, last): a common key meets its group as one row a task."""
    return refs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


class LineIndex:
    """References, counts, candidate keys and filters, as tables in the shared folder.

    Under a path the index stays and LineIndex(spark, path=path) opens it again;
    without one it is scratch.
    """

    def __init__(self, spark: SparkSession, keys_per_shard: int = KEYS_PER_SHARD, path: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "lines", path)
        self.keys_per_shard, self.shards, self.n_keys = keys_per_shard, 0, 0
        self.tables: dict[str, list[DataFrame]] = {"refs": [], "counts": [], "candidates": [], "filters": []}
        state = read_text(spark, f"{self.scratch.path}/state.json") if path else None
        if state:
            state = json.loads(state)
            self.keys_per_shard, self.shards, self.n_keys = state["keys_per_shard"], state["shards"], state["n_keys"]
            self.tables = {k: [self.scratch.open(t) for t in names] for k, names in state["tables"].items()}

    def _stored(self) -> None:
        state = {"keys_per_shard": self.keys_per_shard, "shards": self.shards, "n_keys": self.n_keys}
        state["tables"] = {k: [self.scratch.name_of(t) for t in tables] for k, tables in self.tables.items()}
        write_text(self.spark, f"{self.scratch.path}/state.json", json.dumps(state))

    def _union(self, kind: str) -> DataFrame | None:
        out = None
        for t in self.tables[kind]:
            out = t if out is None else out.unionByName(t)
        return out

    @property
    def refs(self) -> DataFrame:
        return self._union("refs")

    @property
    def filters(self) -> DataFrame:
        return self._union("filters") if self.tables["filters"] else self.spark.createDataFrame([], FILTERS)

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    def _grow(self, more: int) -> None:
        """Makes room for more keys: doubles the shards until none holds too many."""
        need = max(1, self.shards)
        while need * self.keys_per_shard < self.n_keys + more:
            need *= 2
        if need > self.shards:
            self.shards = need
            old = self._union("counts")
            if old is not None:
                keys = old.select("key").distinct().select(self._shard(), "key")
                self.tables["filters"] = [self.scratch.save(keys.groupBy("shard").applyInPandas(_build, FILTERS), "filters")]

    def insert(self, docs: DataFrame) -> DataFrame:
        """Adds documents; returns their references."""
        save = self.scratch.save
        new = save(references(docs), "references", "lz4")
        counts = save(counted(new), "counts", "lz4")
        batch = counts.count()
        self._grow(batch)
        by_shard = counts.select(self._shard(), "key", "n")
        out = self.filters.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInPandas(_insert, "shard int, key binary, seen boolean, filter binary")
        out = save(out, "shards", "lz4")
        filters = out.where("filter is not null").select("shard", "filter")
        old = self._union("counts")
        fresh = batch
        if old is not None:
            # Seen by chance: the filter must hold these keys too, or a later delete would take out another's print.
            seen = out.where("seen").select("key")
            chance = seen.join(old, "key", "left_anti").select(self._shard(), "key")
            fresh -= seen.count() - chance.count()
            filters = filters.groupBy("shard").cogroup(chance.groupBy("shard")).applyInPandas(_add, FILTERS)
        self.tables["filters"] = [save(filters, "filters")]
        self.tables["candidates"].append(save(out.where("key is not null").select("key"), "candidates", "lz4"))
        self.scratch.drop(out)
        self.tables["refs"].append(new)
        self.tables["counts"].append(counts)
        self.n_keys += fresh
        self._stored()
        return new

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents with these ids (doc_id) out."""
        if not self.shards:
            return
        save, refs = self.scratch.save, self.refs
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        before = self._union("counts").select("key").distinct()
        left = save(refs.join(ids, "doc_id", "left_anti").select("key", "doc_id"), "references")
        counts = save(counted(left), "counts", "lz4")
        free = before.join(counts, "key", "left_anti").select(self._shard(), "key")
        filters = save(self.filters.groupBy("shard").cogroup(free.groupBy("shard")).applyInPandas(_delete, FILTERS), "filters")
        candidates = save(self._union("candidates").distinct().join(counts, "key", "left_semi"), "candidates", "lz4")
        self.tables = {"refs": [left], "counts": [counts], "candidates": [candidates], "filters": [filters]}
        self.n_keys = counts.count()
        self._stored()

    def repeated(self) -> DataFrame:
        """(key, n_docs, first_doc) of the keys that at least two documents hold."""
        if not self.shards:
            return self.spark.createDataFrame([], "key binary, n_docs long, first_doc long")
        # One row a key and insertion on both sides: no key is hot here.
        held = self._union("counts").join(self._union("candidates").distinct() if len(self.tables["candidates"]) > 1 else self._union("candidates"), "key", "left_semi")
        if len(self.tables["counts"]) > 1:
            held = held.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        return held.where("first <> last").select("key", F.col("n").alias("n_docs"), F.col("first").alias("first_doc"))


def _drop(schema: T.StructType):
    names = [f.name for f in schema.fields]

    def one(text: str | None, gone: list[bytes] | None) -> tuple[str, int, int]:
        text = text or ""
        if not gone:
            return text, text.count("\n") + 1, 0
        gone, lines = set(gone), text.split("\n")
        kept = [x for x in lines if hashlib.md5(x.strip(STRIPPED).encode().lower(), usedforsecurity=False).digest() not in gone]
        return "\n".join(kept), len(lines), len(lines) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                done = [one(t, g) for t, g in zip(b.column("text").to_pylist(), b.column(GONE).to_pylist(), strict=True)]
                cols = {c: b.column(c) for c in b.schema.names}
                cols |= {"text": pa.array([x[0] for x in done], b.schema.field("text").type)}
                cols |= {"n_lines": pa.array([x[1] for x in done], pa.int64()), "n_dropped": pa.array([x[2] for x in done], pa.int64())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return run


def drop_lines(docs: DataFrame, refs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines and n_dropped."""
    gone = refs.join(repeated.select("key", "first_doc"), "key").where("doc_id <> first_doc")
    gone = gone.groupBy("doc_id").agg(F.collect_set("key").alias(GONE)).withColumnRenamed("doc_id", "__line_dedup_id")
    docs = docs.drop("n_lines", "n_dropped")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    rows = docs.join(gone, F.col("doc_id") == F.col("__line_dedup_id"), "left").drop("__line_dedup_id")
    return rows.mapInArrow(_drop(schema), schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """Inserts docs (doc_id, text, ...) into the index and returns them without repeated lines."""
    held = index or LineIndex(spark)
    refs = held.insert(docs)
    repeated = held.scratch.save(held.repeated(), "repeated")
    if index is None:
        held.scratch.keep_only(refs, repeated)
    return drop_lines(docs, refs, repeated)
