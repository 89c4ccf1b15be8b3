"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

The index holds the test items; every passage of every training text is a
query. Scores are BM25 of an item for the passage's distinct words, divided by
the item's score for itself, so one threshold serves items of every length.
Items are indexed by classes of length (powers of two words); the passages for
a class are windows of twice its length, half overlapping, so one window holds
any copied item whole and no item changes the windows of a longer or shorter one.

A posting list is cut into blocks of neighbouring items with the largest weight
of each. Windows are taken in batches; each step leaves out only what cannot
reach the threshold:

1. the sum of the lists' maxima bounds every item;
2. pivot: the words of a window in order of their maxima; the first ones, which
   sum up to a part of the threshold only, need not be opened, for an item must
   stand in the list of another word too. Only the other lists propose blocks;
3. the block maxima of the opened words and the sum of the others bound a block;
4. the block maxima of all words bound it closer;
5. postings of the blocks left are scored.

So all items above the threshold are retrieved, no more than the exact scores say.

Document frequencies, the number of items and their mean length come from one
aggregation over all items. A large benchmark is indexed in runs of a bounded
number of postings, each a pass over the corpus; scores do not depend on runs.

A retrieved item counts as leaked if at least three quarters of the five-word
shingles of its question and three quarters of the words of its answer occur in
the window. The question ends at the item's answer mark or its last question
mark; an item without either is split at three quarters of its words.

Words are maximal runs outside white space and ASCII punctuation, lower-cased.
Defined results: null and empty texts and items match nothing; repeated rows of
documents each give their rows, equal items are one; items with fewer than five
words in the question compare it as one shingle; an empty table on either side
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .textops import gram_hashes, text_chunks, word_spans

K1, B = 1.2, 0.75
#: Postings of an index that is broadcast at once: 16 bytes each, 64 MB.
POSTINGS_AT_ONCE = 4_000_000
BLOCK, LEAST_WIDTH = 16, 32
#: Slack of bounds for rounding; the part of the threshold that unopened words may sum up to.
SLACK, UNOPENED = 1e-4, 0.4
_ANSWER = re.compile(r"\n\s*(?:answer|a)\s*:", re.IGNORECASE)


def _hash_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each row) of runs of rows."""
    for at, part, offsets in text_chunks(pc.utf8_lower(texts)):
        h, starts, _ = word_spans(part, offsets, punctuation=True)
        yield at, h, np.searchsorted(starts, offsets)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of a test item."""
    if m := _ANSWER.search(text):
        return text[: m.start()], text[m.end() :]
    at = text.rfind("?")
    if at >= 0 and text[at + 1 :].strip():
        return text[: at + 1], text[at + 1 :]
    cuts = [m.end() for m in re.finditer(r"\S+", text)]
    at = cuts[(3 * len(cuts) + 3) // 4 - 1] if cuts else 0
    return text[:at], text[at:]


def _grams(h: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(h, min(5, len(h)))) if len(h) else np.zeros(0, np.uint64)


ITEMS = "rid long, item_id long, first long, length int, terms array<long>, counts array<int>, question array<long>, answer array<long>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (rid, item_id, text) as word hashes; those without a word are left out."""
    for batch in batches:
        texts = [x for t in batch.column("text").to_pylist() for x in (t, *split_item(t))]
        hashes: list[np.ndarray] = []
        for _, h, rows in _hash_words(pa.array(texts, pa.string())):
            hashes += [h[rows[i] : rows[i + 1]] for i in range(len(rows) - 1)]
        out = []
        for i, (rid, item) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("item_id").to_pylist(), strict=True)):
            whole = hashes[3 * i]
            if len(whole):
                terms, counts = np.unique(whole, return_counts=True)
                longs = [x.view(np.int64).tolist() for x in (terms, _grams(hashes[3 * i + 1]), np.unique(hashes[3 * i + 2]))]
                out.append((rid, item, int(whole[:1].view(np.int64)[0]), len(whole), longs[0], counts.tolist(), longs[1], longs[2]))
        long_, int_ = pa.int64(), pa.int32()
        types = [long_, long_, long_, int_, pa.list_(long_), pa.list_(int_), pa.list_(long_), pa.list_(long_)]
        cols = list(zip(*out, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in ITEMS.split(", ")])


@dataclass
class Part:
    """The posting lists of the items of one length class."""

    width: int  # words of a window
    ids: np.ndarray  # of the items
    number: np.ndarray  # of each term of the index among those with a list here, in order of most; -1 without one
    most: np.ndarray  # largest weight in each list, rising
    lists: np.ndarray  # first block of each list and the end
    blocks: int
    key: np.ndarray  # of each block of a list: list * blocks + block
    peak: np.ndarray  # largest weight in each block
    first: np.ndarray  # first posting of each block and the end
    item: np.ndarray  # of each posting
    weight: np.ndarray  # of each posting, relative to the item's score for itself
    questions: list[np.ndarray]
    answers: list[np.ndarray]


@dataclass
class Index:
    terms: np.ndarray  # sorted word hashes
    parts: list[Part]


def _u(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64)


def build_index(items: pd.DataFrame, df: pd.DataFrame, n_items: int, mean_length: float) -> Index:
    """The index of items (the columns of ITEMS) under the document frequencies df (term, n) of all items."""
    by_hash = np.argsort(_u(df["term"]))
    terms, n = _u(df["term"])[by_hash], df["n"].to_numpy()[by_hash]
    idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
    # Items that share their first words share a block more often than not.
    items = items.sort_values(["first", "length", "rid"], ignore_index=True)
    width = np.array([2 * max(LEAST_WIDTH, 1 << (int(x) - 1).bit_length()) for x in items["length"]])
    parts = []
    for w in np.unique(width):
        own = items[width == w].reset_index(drop=True)
        at, item, weight = [], [], []
        for i, (t, tf, length) in enumerate(zip(own["terms"], own["counts"], own["length"], strict=True)):
            t, tf = np.searchsorted(terms, _u(t)), np.asarray(tf)
            x = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            at.append(t)
            item.append(np.full(len(t), i))
            weight.append(x / x.sum())
        at, item, weight = np.concatenate(at), np.concatenate(item), np.concatenate(weight)
        most = np.zeros(len(terms))
        np.maximum.at(most, at, weight)
        listed = np.flatnonzero(most)
        listed = listed[np.argsort(most[listed], kind="stable")]
        number = np.full(len(terms), -1)
        number[listed] = np.arange(len(listed))
        blocks = -(-len(own) // BLOCK)
        key = number[at] * blocks + item // BLOCK
        order = np.lexsort((item, key))
        key, item, weight = key[order], item[order], weight[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        parts.append(
            Part(
                int(w),
                own["item_id"].to_numpy(),
                number.astype(np.int32),
                most[listed].astype(np.float32),
                np.searchsorted(key[first], np.arange(len(listed) + 1) * blocks),
                blocks,
                key[first],
                np.maximum.reduceat(weight, first).astype(np.float32),
                np.append(first, len(key)).astype(np.int32),
                item.astype(np.int32),
                weight.astype(np.float32),
                [_u(x) for x in own["question"]],
                [_u(x) for x in own["answer"]],
            )
        )
    return Index(terms, parts)


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, element) for all elements of the ranges."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]


def _share(part: np.ndarray, window: np.ndarray) -> float:
    return float(np.isin(part, window).mean()) if len(part) else 1.0


def retrieve(part: Part, term: np.ndarray, row: np.ndarray, inner: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, item, score) of all items above the threshold.

    term, row, inner: index term, row and place in the row of each word that the
    index has; rows: first word of each row and the end.
    """
    least = threshold - SLACK
    step = part.width // 2
    term = part.number[term]
    ours = term >= 0
    term, row, inner = term[ours].astype(np.int64), row[ours], inner[ours]
    none = np.zeros(0, np.int64)
    # Cells of half a window get numbers; a window is a cell and the next one of its row.
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-np.diff(rows) // step)))])
    cell = first[row] + inner // step
    n = int(first[-1])
    bound = np.bincount(cell, part.most[term], n)
    bound[:-1] += np.where(np.isin(np.arange(1, n), first), 0, bound[1:])
    live = bound >= least
    own, before = live[cell], (inner >= step) & live[cell - 1]
    window, term = np.concatenate([cell[own], cell[before] - 1]), np.concatenate([term[own], term[before]])
    # Lists are numbered by their maxima, so a window's words come in rising order.
    pair = np.unique(window * len(part.most) + term)
    window, term = pair // len(part.most), pair % len(part.most)
    live = np.bincount(window, part.most[term], n)[window] >= least
    window, term = window[live], term[live]
    if not len(window):
        return none, none, none, np.zeros(0)
    most = part.most[term].astype(np.float64)
    start = np.flatnonzero(np.diff(window, prepend=-1))
    size = np.diff(np.append(start, len(window)))
    total = np.cumsum(most)
    total -= np.repeat(total[start] - most[start], size)
    opened = total >= UNOPENED * least
    closed = np.add.reduceat(~opened, start)  # a window's first words
    rest = np.add.reduceat(np.where(opened, 0, most), start)
    number = np.repeat(np.arange(len(start)), size)  # of each word's window among those left
    at = np.flatnonzero(opened)
    which, entry = _expand(part.lists[term[at]], part.lists[term[at] + 1])
    proposed = number[at[which]] * part.blocks + part.key[entry] % part.blocks
    if len(start) * part.blocks <= 4 * len(proposed) + 1_000_000:
        sums = np.bincount(proposed, part.peak[entry])
        proposed = np.flatnonzero(sums)
        sums = sums[proposed]
    else:
        proposed, place = np.unique(proposed, return_inverse=True)
        sums = np.bincount(place, part.peak[entry])
    good = sums + rest[proposed // part.blocks] >= least
    proposed, sums = proposed[good], sums[good]

    def entries(candidates: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which candidate, block of a list) for so many of the first words of each candidate's window."""
        w, b = candidates // part.blocks, candidates % part.blocks
        cand, word = _expand(start[w], start[w] + words[w])
        want = term[word] * part.blocks + b[cand]
        entry = np.minimum(np.searchsorted(part.key, want), len(part.key) - 1)
        there = part.key[entry] == want
        return cand[there], entry[there]

    hits = [(none, none, np.zeros(0))]
    for i in range(0, len(proposed), 50_000):
        some = proposed[i : i + 50_000]
        cand, entry = entries(some, closed)
        some = some[sums[i : i + 50_000] + np.bincount(cand, part.peak[entry], len(some)) >= least]
        cand, entry = entries(some, size)
        which, posting = _expand(part.first[entry], part.first[entry + 1])
        score = np.bincount(cand[which] * BLOCK + part.item[posting] % BLOCK, part.weight[posting], len(some) * BLOCK)
        top = np.flatnonzero(score >= threshold)
        of = some[top // BLOCK]
        hits.append((window[start[of // part.blocks]], of % part.blocks * BLOCK + top % BLOCK, score[top]))
    window, item, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    r = np.searchsorted(first, window, "right") - 1
    return r, (window - first[r]) * step, item, score


def search(index: Index, h: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(row, first word of the window in the row, item_id, score, question share, answer share)."""
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    place = np.flatnonzero(index.terms[at] == h)
    row = np.searchsorted(rows, place, "right") - 1
    for part in index.parts:
        for r, begin, item, score in zip(*retrieve(part, at[place], row, place - rows[row], rows, threshold), strict=True):
            inside = h[rows[r] + begin : min(rows[r] + begin + part.width, rows[r + 1])]
            q = part.questions[item]
            # A question of fewer than five words is one shorter shingle.
            grams = np.concatenate([gram_hashes(inside, k) for k in range(1, 6)]) if len(q) == 1 else gram_hashes(inside, 5)
            yield int(r), int(begin), int(part.ids[item]), float(score), _share(q, grams), _share(part.answers[item], inside)


def indexes(spark: SparkSession, items: DataFrame, postings_at_once: int = POSTINGS_AT_ONCE) -> Iterator[Index]:
    """Indexes of all items (item_id, text), each of about postings_at_once postings at most, or of one item."""
    scratch = Scratch(spark, "benchmark")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    items = scratch.save(items.withColumn("rid", F.xxhash64("item_id", "text")).mapInArrow(_items, ITEMS), "items")
    df = scratch.save(items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    whole = items.agg(F.count("*").alias("n"), F.avg("length").alias("length"), F.sum(F.size("terms")).alias("postings")).first()
    runs = -(-(whole["postings"] or 0) // postings_at_once)
    for r in range(runs):
        own = items.where(F.pmod(F.xxhash64("rid"), F.lit(runs)) == r)
        rows = own.toPandas()
        if len(rows):
            terms = own.select(F.explode("terms").alias("term")).distinct()
            yield build_index(rows, df.join(terms, "term").toPandas(), whole["n"], whole["length"])
    scratch.close()


def leaked_passages(
    spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.75, answer: float = 0.75, postings_at_once: int = POSTINGS_AT_ONCE
) -> DataFrame:
    """doc_id, item_id, passage (its first word), score, question_overlap, answer_overlap of leaked items.

    An index goes to the executors with a bounded number of postings, and each is
    one pass over docs; what is broadcast at once grows with neither table.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(spark, items, postings_at_once):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column("doc_id"), []
                for at, h, rows in _hash_words(batch.column("text")):
                    for r, begin, item, s, q, a in search(held.value, h, rows, threshold):
                        if q >= question and a >= answer:
                            found.append((ids[at + r].as_py(), item, begin, s, q, a))
                cols = list(zip(*found, strict=True)) or [[]] * 6
                types = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(
    spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.75, answer: float = 0.75, postings_at_once: int = POSTINGS_AT_ONCE
) -> DataFrame:
    """The rows of docs (text, ...) that hold no leaked item; nothing is shuffled."""
    for index in indexes(spark, items, postings_at_once):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, h, rows in _hash_words(batch.column("text")):
                    for r, _, _, _, q, a in search(held.value, h, rows, threshold):
                        if q >= question and a >= answer:
                            keep[at + r] = False
                yield batch if keep.all() else batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaked_items(spark: SparkSession, docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row for each document and item leaked into it: the best passage."""
    hits = leaked_passages(spark, docs, items, **options)
    best = hits.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("passage")).alias("p"))).alias("m"), F.count("*").alias("n_passages")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("m.p")).alias("passage"), "n_passages", F.round("m.score", 6).alias("score"), "m.question_overlap", "m.answer_overlap"
    )
