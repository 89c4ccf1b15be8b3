"""Near-duplicate documents by an LSH forest of sorted MinHash orders.

Each text's 128 MinHash values form 16 trees of eight 16-bit labels. A tree is
the order of all texts by their labels; texts that share a long prefix of
labels stand side by side. Candidates are the neighbours with a common prefix
of at least three labels: all pairs of a region (the texts that share the
prefix) while it is small, one label deeper where it is not, and the next two
neighbours whatever the region's size. A 128-bit sketch sorts out most chance
neighbours; the rest is confirmed on full shingle sets.

Only classes are asked for, so candidates are confirmed in three rounds: each
text with its best neighbour, then the best candidate between any two classes,
then every candidate that still joins two classes. A candidate inside one class
needs no confirmation. Texts with the same word sequence count as one from the
start.

Neighbours leave out pairs of a region over 16 texts and pairs parted by the edge
of a range partition. The texts of such regions are crowded; their pairs in
different classes go through an exact set-similarity join: shingles in one order
of rising frequency, pairs that share a shingle of their prefixes early enough
to reach the similarity. No pair at the similarity is lost there.

Defined results: null, empty and blank texts have no shingles and link with
nothing; with fewer than five words the whole sequence is one shingle; rows
with a null id are returned, kept, and link with nothing; repeated ids give a
row each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components
from .textops import sequence_keys, shingle_sets, text_chunks, words

TREES, DEPTH, LEAST_DEPTH, REGION = 16, 8, 3, 16
VALUES = TREES * DEPTH
#: Of 128 sketch bits, each alike with probability (1 + J) / 2: fewer than one pair in 10**7 at 0.75 falls below (tested).
LEAST_BITS = 88
#: Ids of candidate texts are broadcast up to this count (16 MB), joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Leading bits of a shingle whose count orders the shingles of crowded texts (a table of 2 MB).
ORDER_BITS = 18

_rng = np.random.default_rng(20)
_A = (_rng.integers(1, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values of a set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[at : at + 4096, None] * _A + _B).min(axis=0), out=low)
    return low


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = np.array([48, 32, 16, 0], np.uint64)
    bit = np.arange(64, dtype=np.uint64)
    for batch in batches:
        ids = batch.column("doc_id")
        for at, part, offsets in text_chunks(batch.column("text")):
            h, rows = words(part, offsets)
            n = len(rows) - 1
            size = np.zeros(n, np.int64)
            sig = np.zeros((n, VALUES), np.uint32)
            for i, s in enumerate(shingle_sets(h, rows)):
                size[i] = len(s)
                if len(s):
                    sig[i] = minhash(s)
            k1, k2 = sequence_keys(h, rows)
            mixed = sig * np.uint32(0x9E3779B1)
            labels = (mixed >> np.uint32(16)).astype(np.uint64).reshape(n, TREES * 2, 4)
            keys = (labels << shift).sum(axis=2, dtype=np.uint64)
            bits = ((mixed >> np.uint32(15)) & np.uint32(1)).astype(np.uint64).reshape(n, 2, 64)
            sketch = (bits << bit).sum(axis=2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, n),
                    pa.array(size),
                    pa.array(k1),
                    pa.array(k2),
                    pa.array([x.tobytes() for x in keys], pa.binary()),
                    pa.array(sketch[:, 0].copy().view(np.int64)),
                    pa.array(sketch[:, 1].copy().view(np.int64)),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "keys", "s0", "s1"],
            )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64).reshape(n, TREES, 2)
        again = np.tile(np.arange(n), TREES)
        cols = [np.repeat(np.arange(TREES, dtype=np.int32), n), keys[:, :, 0].T.ravel(), keys[:, :, 1].T.ravel()]
        cols += [batch.column(c).to_numpy()[again] for c in ("rep", "s0", "s1")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["tree", "q0", "q1", "rep", "s0", "s1"])


def _prefix(q0: np.ndarray, q1: np.ndarray) -> np.ndarray:
    """Labels in common with the next row."""
    out = np.zeros(len(q0) - 1, np.int64)
    x, y = q0[1:] ^ q0[:-1], q1[1:] ^ q1[:-1]
    for d in range(1, 5):
        out[(x >> np.uint64(64 - 16 * d)) == 0] = d
    same = x == 0
    for d in range(1, 5):
        out[same & ((y >> np.uint64(64 - 16 * d)) == 0)] = 4 + d
    return out


def forest_neighbours(rows: pd.DataFrame, region: int = REGION, least: int = LEAST_DEPTH) -> pd.DataFrame:
    """Candidates (a, b, bits) among rows sorted by tree, q0, q1."""
    n = len(rows)
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "bits": np.zeros(0, np.int32)})
    if n < 2:
        return none
    tree, rep = rows["tree"].to_numpy(), rows["rep"].to_numpy()
    q0, q1, s0, s1 = (rows[c].to_numpy().view(np.uint64) for c in ("q0", "q1", "s0", "s1"))
    common = _prefix(q0, q1)
    common[tree[1:] != tree[:-1]] = 0
    size = np.zeros((DEPTH + 1, n), np.int64)
    for d in range(least, DEPTH + 1):
        group = np.concatenate([[0], np.cumsum(common < d)])
        size[d] = np.bincount(group)[group]
    found = []
    run = common
    for o in range(1, min(region, n)):
        if o > 1:
            run = np.minimum(run[:-1], common[o - 1 :])
        i = np.flatnonzero(run >= least)
        if not len(i):
            break
        if o > 2:
            i = i[size[run[i], i] <= region]
        bits = 128 - np.bitwise_count(s0[i] ^ s0[i + o]).astype(np.int32) - np.bitwise_count(s1[i] ^ s1[i + o])
        near = bits >= LEAST_BITS
        i, bits = i[near], bits[near]
        found.append(pd.DataFrame({"a": np.minimum(rep[i], rep[i + o]), "b": np.maximum(rep[i], rep[i + o]), "bits": bits.astype(np.int32)}))
    return pd.concat(found) if found else none


def _least_region(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tree, leading labels) of the least deep region of each row."""
    return rows["tree"].to_numpy(), rows["q0"].to_numpy().view(np.uint64) >> np.uint64(64 - 16 * LEAST_DEPTH)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates (a, b, bits), and a row with a = b for each crowded text."""

    def marks(rows: pd.DataFrame, crowded: np.ndarray) -> pd.DataFrame:
        ids = np.unique(rows["rep"].to_numpy()[crowded])
        return pd.DataFrame({"a": ids, "b": ids, "bits": np.zeros(len(ids), np.int32)})

    tail = edge = None
    for pdf in batches:
        for at in range(0, len(pdf), 50_000):
            part = pdf.iloc[at : at + 50_000]
            rows = part if tail is None else pd.concat([tail, part], ignore_index=True)
            yield forest_neighbours(rows).drop_duplicates()
            tree, lead = _least_region(rows)
            group = np.concatenate([[0], np.cumsum((tree[1:] != tree[:-1]) | (lead[1:] != lead[:-1]))])
            # The first and the last region may go on in another partition.
            edge = edge or (tree[0], lead[0])
            yield marks(rows, (np.bincount(group)[group] > REGION) | ((tree == edge[0]) & (lead == edge[1])))
            tail = rows.iloc[-4 * REGION :]
    if tail is not None:
        tree, lead = _least_region(tail)
        yield marks(tail, (tree == tree[-1]) & (lead == lead[-1]))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for at, part, offsets in text_chunks(batch.column("text")):
            sets = list(shingle_sets(*words(part, offsets)))
            flat = np.concatenate(sets).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), lists], ["id", "set"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    x = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    x = x.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return x.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("a", "b")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles, number of each text)."""
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


SLICE_BITS = 12
SLICES = "slice int, buckets binary, n binary"


def _slices(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(k, own.astype("<u2").tobytes(), n[own].astype("<i8").tobytes()) for k, n in counts.items() if len(own := np.flatnonzero(n))]
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "buckets", "n"])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each bucket of shingles occurs, one row a slice of the buckets and task."""
    n = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            n += np.bincount(_bucket(_flat(batch.column("set").slice(at, 1024))[0]), minlength=len(n))
    yield _slices(dict(enumerate(n.reshape(-1, 1 << SLICE_BITS))))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of slices, which are few and small however many rows there are."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, buckets, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "buckets", "n")), strict=True):
            total.setdefault(k, np.zeros(1 << SLICE_BITS, np.int64))[np.frombuffer(buckets, "<u2")] += np.frombuffer(n, "<i8")
    yield _slices(total)


def _often(sets: DataFrame) -> np.ndarray:
    """The count of each bucket over all sets (set): 2 MB at every size."""
    out = np.zeros((1 << (ORDER_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for r in sets.mapInArrow(_bucket_counts, SLICES).repartition("slice").mapInArrow(_added, SLICES).collect():
        out[r["slice"], np.frombuffer(bytes(r["buckets"]), "<u2")] = np.frombuffer(bytes(r["n"]), "<i8")
    return out.ravel()


def _prefixes(often: np.ndarray, percent: int):
    """The shingles by which a text can meet a partner, rarest first; short marks those that suffice for the smaller of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x, n = _flat(batch.column("set"))
                text = np.repeat(np.arange(len(n)), n)
                x = x[np.lexsort((x, often[_bucket(x)], text))]
                place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                keep = place <= (n - -(-percent * n // 100))[text]
                x, text, place = x[keep], text[keep], place[keep]
                short = place <= (n - -(-2 * percent * n // (100 + percent)))[text]
                ids, own = (batch.column(c).to_numpy()[text] for c in ("id", "class"))
                cols = [x, ids, own, n[text].astype(np.int32), place.astype(np.int32), short]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "id", "class", "n", "place", "short"])

    return run


def crowded_pairs(scratch: Scratch, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of texts (id, class, set) in different classes that can reach the similarity; none that does is left out."""
    prefixes = texts.mapInArrow(_prefixes(_often(texts.select("set")), percent), "token long, id long, class long, n int, place int, short boolean")
    prefixes = scratch.save(prefixes, "prefixes")
    # A shingle with a large class meets only the texts outside this class.
    tokens = prefixes.groupBy("token", "class").agg(F.count("*").alias("m")).groupBy("token")
    tokens = tokens.agg(F.max_by("class", F.struct("m", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    shared = scratch.save(prefixes.join(tokens.drop("classes"), "token"), "shared")
    scratch.drop(prefixes)
    x, y = shared.where("short").alias("x"), shared.alias("y")
    meet = "x.token = y.token and x.class <> y.class and (x.n < y.n or (x.n = y.n and x.id < y.id))"
    meet += f" and {100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)"
    met = x.where("x.class <> x.main").join(y, F.expr(meet)).union(x.where("x.class = x.main").join(y.where("y.class <> y.main"), F.expr(meet)))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def with_text_key(docs: DataFrame, name: str) -> DataFrame:
    """docs (text, ...) with the text_key of each row under a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.zeros(0, np.int64)]
            blank = [np.zeros(0, bool)]
            for _, part, offsets in text_chunks(batch.column("text")):
                h, rows = words(part, offsets)
                keys.append(sequence_keys(h, rows)[0])
                blank.append(np.diff(rows) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys), mask=np.concatenate(blank))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for each row of docs (doc_id, text).

    text_key is a hash of the word sequence, null without words; it tells the rows of one id apart.
    """
    scratch = Scratch(spark, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.save(
        docs.mapInArrow(_signatures, "doc_id long, n_shingles long, k1 long, k2 long, keys binary, s0 long, s1 long"), "signatures"
    )
    fine = sig.where("n_shingles > 0 and doc_id is not null")
    first = fine.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    reps = fine.join(first.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"], "left_semi").dropDuplicates(["k1", "k2"])
    pairs = (
        reps.select(F.col("doc_id").alias("rep"), "keys", "s0", "s1")
        .mapInArrow(_trees, "tree int, q0 long, q1 long, rep long, s0 long, s1 long")
        .repartitionByRange("tree", "q0", "q1", "rep")
        .sortWithinPartitions("tree", "q0", "q1", "rep")
        .mapInPandas(_candidates, "a long, b long, bits int")
        .groupBy("a", "b")
        .agg(F.max("bits").alias("bits"))
    )
    pairs = scratch.save(pairs, "candidates")
    nodes = scratch.save(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"), "nodes")
    crowded, pairs = pairs.where("a = b").select(F.col("a").alias("id")), pairs.where("a <> b")
    small = nodes.count() <= BROADCAST_IDS
    sets = docs.join(F.broadcast(nodes) if small else nodes, "doc_id", "left_semi").mapInArrow(_sets, "id long, set array<long>")
    sets = scratch.save(sets, "sets")

    both = pairs.select("a", "b", "bits").union(pairs.select("b", "a", "bits"))
    best = both.groupBy("a").agg(F.max(F.struct("bits", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = scratch.save(tried, "tried")
    links = scratch.save(confirmed(tried, sets, percent), "links")
    label = components(scratch, links)
    for every in (False, True):
        open_ = (
            pairs.join(tried, ["a", "b"], "left_anti")
            .join(label.toDF("a", "ca"), "a", "left")
            .join(label.toDF("b", "cb"), "b", "left")
            .select("a", "b", "bits", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
            .where("ca <> cb")
        )
        open_ = scratch.save(open_, "open")
        if open_.isEmpty():
            break
        if not every:
            ends = (F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
            open_ = open_.groupBy(*ends).agg(F.max(F.struct("bits", "a", "b")).alias("m")).select("m.a", "m.b")
        now = scratch.save(open_.select("a", "b"), "tried")
        more = scratch.save(confirmed(now, sets, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            label = components(scratch, label.toDF("a", "b").union(more))
        tried = tried.union(now)
    texts = sets.join(crowded, "id", "left_semi").join(label, "id", "left").select("id", F.coalesce("component_id", "id").alias("class"), "set")
    met = scratch.save(crowded_pairs(scratch, texts.where("size(set) > 0"), percent), "met")
    more = scratch.save(confirmed(met, sets, percent), "links")
    if not more.isEmpty():
        label = components(scratch, label.toDF("a", "b").union(more))
    scratch.drop(sets)
    classes = scratch.save(
        first.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component_id", "rep").alias("component_id")),
        "classes",
    )
    scratch.keep_only(sig, classes)
    return (
        sig.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("k1")).alias("k1"), "k2", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("text_key"))
        .join(classes, ["k1", "k2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
            "text_key",
        )
    )
