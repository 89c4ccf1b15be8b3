"""Stupid-backoff scores of every document under counts of all the others.

1. Explode: the n-grams of one to three words of each block of documents, as
   64-bit hashes combined within the block: (part, block, h, n), a part being a
   range of hashes. The entries of a block and part travel as one sorted list.
2. Count: the table (part, h, total), a sum over each part.
3. Join: exploded n-grams and table meet by part, under one exchange of the
   exploded side; each block gets the totals of its n-grams.
4. Sum: each block lists its n-grams again, sets the totals beside them, takes
   each document's own counts off and adds up the scores per document.

Steps 1 to 3 run once for each third of the hashes and step 4 once for each third
of the blocks (PASSES), so no more than that share of the lists is on its way
between tasks at once; shuffle files go when their pass is written.

A common n-gram is one entry a block, so no key is hot; a part holds about
ENTRIES_PER_PART entries, whatever the input. There are at most as many lists as
entries. Counts are 64-bit numbers.

A word's score after the two before it is c(abc) / c(ab) if c(abc) > 0, else
0.4 * c(bc) / c(b) if c(bc) > 0, else 0.4**2 * c(c) / N; a word found nowhere
else counts half. First words start at the order they have. All counts are
those of the other documents, rows of the same id being documents of their own.

Defined results: null and empty texts have no words and score 0; a null or
repeated id is scored like any other; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .textops import gram_hashes, text_chunks, words

ORDER, BACKOFF = 3, 0.4
BLOCK_ROWS = 1024
PASSES = 3
ENTRIES_PER_PART = 2_000_000


def file_blocks(files: DataFrame) -> DataFrame:
    """(block, doc_id, text) of a DataFrame read from Parquet files: runs of rows of one file.

    The block depends on the file and the row's place alone, not on how tasks
    split the file, so two scans agree whatever executors there are.
    """
    return files.select(
        F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and each text's first word and the end."""
    hs, rows, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, part, offsets in text_chunks(column):
        h, r = words(part, offsets)
        hs.append(h)
        rows.append(r[1:] + at)
        at += len(h)
    return np.concatenate(hs), np.concatenate(rows)


def _grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams inside texts and the place of their last word."""
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(h))  # words from here to the text's end
    start = np.flatnonzero(left >= n)
    return gram_hashes(h, n)[start], start + n - 1


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as gaps: all low halves, then the middle quarters, then the mostly empty upper ones."""
    gap = np.diff(h, prepend=np.uint64(0))
    return gap.astype("<u4").tobytes() + (gap >> np.uint64(32)).astype("<u2").tobytes() + (gap >> np.uint64(48)).astype("<u2").tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    low, mid, high = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", n, 4 * n), np.frombuffer(raw, "<u2", n, 6 * n)
    return np.cumsum(low.astype(np.uint64) + (mid.astype(np.uint64) << np.uint64(32)) + (high.astype(np.uint64) << np.uint64(48)), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    """64-bit counts, one byte each; those of 255 and more follow in full."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<i8").tobytes()


def unpack_counts(raw: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=size)
    return out


LISTS = "part long, block long, h binary, n binary"


def _rows(parts, blocks, lists: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> dict[str, pa.Array]:
    made = [pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array([pack_hashes(h) for h, _ in lists], pa.binary()), pa.array([pack_counts(n) for _, n in lists], pa.binary())]
    return {k: v for k, v in zip(("part", "block", "h", "n"), made, strict=True) if k in names}


def _exploded(bits: int, low: int, high: int):
    """Lists of the n-grams of each block whose part, the first bits of the hash, is in range(low, high); a block's may come in several runs."""
    shift = np.uint64(64 - bits)

    def emit(block: int, cols: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        h, rows = _texts(pa.concat_arrays(cols))
        keys = np.concatenate([_grams(h, rows, n)[0] for n in range(1, ORDER + 1)])
        part = keys >> shift
        keys, counts = np.unique(keys[(part >= low) & (part < high)], return_counts=True)
        part = (keys >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else []
        for at in range(0, len(cuts) - 1, 256):
            ends = cuts[at : at + 257]
            lists = [(keys[a:b], counts[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(_rows(part[ends[:-1]], np.full(len(lists), block), lists, ["part", "block", "h", "n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(blocks) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and blocks[a] != now:
                    yield from emit(now, held)
                    held = []
                now = int(blocks[a])
                held.append(batch.column("text").slice(a, b - a))
        if held:
            yield from emit(now, held)

    return run


def _listed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, h, n) of all entries of lists."""
    hs = [unpack_hashes(x.as_py()) for x in table.column("h")]
    ns = [unpack_counts(x.as_py(), len(h)) for x, h in zip(table.column("n"), hs, strict=True)]
    return np.repeat(np.arange(len(hs)), [len(h) for h in hs]), np.concatenate(hs), np.concatenate(ns)


def _summed(lists: pa.Table) -> pa.Table:
    """The count table of one part."""
    _, h, n = _listed(lists)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return pa.table(_rows([lists.column("part")[0].as_py()], [0], [(h[first], np.add.reduceat(n, first))], ["part", "h", "n"]))


def _joined(lists: pa.Table, counts: pa.Table) -> pa.Table:
    """The totals of each block's n-grams of one part, a sorted list a block; those that occur nowhere else are left out."""
    _, key, total = _listed(counts)
    which, h, n = _listed(lists)
    total = total[np.searchsorted(key, h)]
    elsewhere = total > n
    block = lists.column("block").to_numpy()[which[elsewhere]]
    h, total = h[elsewhere], total[elsewhere]
    order = np.argsort(block, kind="stable")  # a block's list is sorted; of several runs each is
    block, h, total = block[order], h[order], total[order]
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        keys, first = np.unique(h[a:b], return_index=True)
        out.append((keys, total[a:b][first]))
    return pa.table(_rows([lists.column("part")[0].as_py()] * len(out), block[cuts[:-1]] if out else [], out, ["block", "h", "n"]))


def _scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id, n_words, score, singles: the sum of the logarithms but for the corpus size, which singles words still lack."""
    text = docs.column("text").combine_chunks()
    h, rows = _texts(text)
    m = len(rows) - 1
    size = np.diff(rows)
    log, single = np.zeros(len(h)), np.zeros(len(h), np.int64)
    if len(h):
        grams = [_grams(h, rows, n) for n in range(1, ORDER + 1)]
        keys, place, corpus = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True, return_counts=True)
        if answers.num_rows:
            _, at, total = _listed(answers)
            corpus[np.searchsorted(keys, at)] = total
        doc = np.repeat(np.arange(m), size)
        last = np.concatenate([p for _, p in grams])
        _, which, own = np.unique(doc[last] * len(keys) + place, return_inverse=True, return_counts=True)
        other = corpus[place] - own[which]
        cut = np.cumsum([0, *(len(g) for g, _ in grams)])
        # counts[n][i]: of the n-gram that ends at word i, in the other documents; -1 where there is none
        counts = np.full((ORDER + 1, len(h)), -1, np.int64)
        for n in range(1, ORDER + 1):
            counts[n, grams[n - 1][1]] = other[cut[n - 1] : cut[n]]
        best = np.log(np.maximum(counts[1], 0.5))
        single[:] = 1
        steps = np.zeros(len(h))
        for n in range(2, ORDER + 1):
            there = counts[n] >= 0
            hit = np.flatnonzero(counts[n] > 0)
            steps[there] += 1
            best[hit] = np.log(counts[n, hit] / counts[n - 1, hit - 1])
            steps[hit] = single[hit] = 0
        log = best + steps * np.log(BACKOFF)
    add = lambda x: np.where(size > 0, np.add.reduceat(np.append(x, 0), rows[:-1]), 0) if m else x[:0]
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(size.astype(np.int64)), "score": pa.array(add(log).astype(np.float64)), "singles": pa.array(add(single).astype(np.int64))})


@contextlib.contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go at its end, not when the driver's garbage collector comes by."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _parts(blocks: DataFrame) -> int:
    """Leading bits of a hash that part the n-grams; there are at most 0.3 entries a byte of text."""
    size = blocks.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(3, int(np.ceil(np.log2(max(1, 0.3 * size / ENTRIES_PER_PART)))))


def exploded(blocks: DataFrame, bits: int, low: int, high: int) -> DataFrame:
    """(part, block, h, n): exploded n-grams, partitioned by hash."""
    return blocks.select("block", "text").mapInArrow(_exploded(bits, low, high), LISTS).repartition("part")


def count_table(grams: DataFrame) -> DataFrame:
    """(part, h, n): the totals of exploded n-grams, one sorted list a part."""
    return grams.groupBy("part").applyInArrow(_summed, "part long, h binary, n binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            _, h, n = _listed(pa.Table.from_batches([b.slice(i, 1)]))
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "n": n})


def ngram_counts(blocks: DataFrame) -> DataFrame:
    """(h, n): the whole count table of blocks (block, text), one row an n-gram."""
    bits = _parts(blocks)
    return count_table(exploded(blocks, bits, 0, 1 << bits)).select("h", "n").mapInArrow(_unpacked, "h long, n long")


def stupid_backoff(spark: SparkSession, blocks: DataFrame, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of each row of blocks (block, doc_id, text).

    The block of a row must be the same whenever the DataFrame is computed, and
    blocks must be of bounded size; file_blocks() gives such blocks.
    """
    scratch = Scratch(spark, "backoff")
    bits = _parts(blocks)
    answers, scores = None, []
    with _shuffles_cleaned(spark):
        for i in range(passes):
            grams = exploded(blocks, bits, (i << bits) // passes, ((i + 1) << bits) // passes)
            both = grams.groupBy("part").cogroup(count_table(grams).groupBy("part"))
            own = scratch.save(both.applyInArrow(_joined, "block long, h binary, n binary"), "answers")
            answers = own if answers is None else answers.union(own)
        schema = "doc_id long, n_words long, score double, singles long"
        for i in range(passes):
            here = F.pmod(F.col("block"), F.lit(passes)) == i
            own = blocks.where(here).groupBy("block").cogroup(answers.where(here).groupBy("block")).applyInArrow(_scores, schema)
            scores.append(scratch.save(own, "scores"))
    scored = functools.reduce(DataFrame.union, scores)
    scratch.keep_only(*scores)
    total = scored.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    score = F.col("score") - F.col("singles") * F.log(F.greatest(F.lit(1).cast("long"), F.lit(total).cast("long") - F.col("n_words")))
    out = scored.select("doc_id", "n_words", score.alias("log_score"))
    return out.withColumn("mean_log_score", F.col("log_score") / F.greatest("n_words", F.lit(1)))
