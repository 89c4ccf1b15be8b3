"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text's bag holds the character n-grams of three to six letters of its words,
word ends marked, each hashed to one of 2**18 vectors. The mean of the vectors
goes into a softmax over two classes; vectors and softmax are trained jointly in
numpy. A misspelt word that was never seen shares most n-grams with the word it
comes from, and so its vectors.

After training, mean and softmax fold into one number for each hashed n-gram, so
a text's score is the logistic of a bias and the mean of those numbers; scoring
runs on the letters of whole batches at once and reads every text to its end.

The mean includes NEUTRAL n-grams without weight, a prior that draws the score
of a few words towards the bias; a text of some hundred letters outweighs it.

The model is fitted on a sample of at most sample_rows labelled texts, one an
id, the smallest by a hash of the id, and of at most sample_grams different
n-grams of texts, so the bound does not grow with the data. Bags are made once,
by all executors, and come as arrays into one task, which sends the driver the
finished model of 1 MB. Scores use the text alone.

Defined results: null and empty texts, and texts without letters, get the score
of the bias; without labelled rows everything counts as clean; rows with a null
id or label are not learned from but are scored; repeated ids give a row each,
and of their texts the smallest is learned, of their labels the largest; ties
of the hash go by id; columns named score, predicted and held_out are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: N-grams without weight that every mean includes, so that a few words decide little.
NEUTRAL = 150
_K = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_LETTER = np.array([chr(i).isalnum() for i in range(1 << 16)])


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with 0 outside of words, and the first place of each text and the end; texts are parted by 0."""
    raw = [t.lower().encode("utf-32-le", "replace") for t in texts]
    c = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(raw) + b"\0\0\0\0", np.uint32).copy()
    c[~_LETTER[np.minimum(c, 0xFFFF)] & (c < 0x10000)] = 0
    starts = np.concatenate([[0], np.cumsum([len(r) // 4 + 1 for r in raw])])
    return c, starts


def _grams(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (hashed n-gram at each place, whether it lies in one word with its end marks)."""
    word = c != 0
    for n in SIZES:
        m = len(c) - n + 1
        if m <= 0:
            return
        h = np.zeros(m, np.uint32)
        inner = np.ones(m, bool)
        for j in range(n):
            h += c[j : j + m] * _K[j]
            if 0 < j < n - 1:
                inner &= word[j : j + m]
        h = (h ^ (h >> np.uint32(15))) * _K[1] + np.uint32(n)
        h = (h ^ (h >> np.uint32(13))) * _K[2]
        yield h >> np.uint32(32 - 18), inner


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-gram numbers and their weights in its mean."""
    c, _ = _letters([text])
    ids = np.concatenate([np.zeros(0, np.uint32), *(h[ok] for h, ok in _grams(c))])
    k, n = np.unique(ids, return_counts=True)
    return k.astype(np.int32), (n / (NEUTRAL + len(ids))).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of each hashed n-gram
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        c, starts = _letters(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for h, ok in _grams(c):
            v = np.where(ok, self.weight[h], 0)
            cuts = np.minimum(starts, len(v))
            sums = np.concatenate([[0], np.cumsum(v, dtype=np.float64)])
            total += sums[cuts[1:]] - sums[cuts[:-1]]
            oks = np.concatenate([[0], np.cumsum(ok)])
            count += oks[cuts[1:]] - oks[cuts[:-1]]
        return self.bias + total / (NEUTRAL + count)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, updates: int = 32_000, rate: float = 2.0, seed: int = 3, damp: float = 1e-3) -> Model:
    """Adagrad over single texts, given as bags; vectors and softmax learn together.

    Small samples are gone through more often. N-grams of few texts are left out,
    for they would learn the texts and not the class; the list of bags is emptied
    of them in place.
    """
    labels = np.asarray(labels, int)
    if not len(bags):
        return Model(np.zeros(BUCKETS, np.float32), -1.0)
    epochs = min(30, max(4, -(-updates // len(bags))))
    least_texts = max(2, min(10, len(bags) // 400))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (2, dim)).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    seen, seen_soft, seen_bias = np.full(BUCKETS, damp, np.float32), np.full((2, 1), 1e-3, np.float32), np.full(2, 1.0, np.float32)
    texts_with = np.zeros(BUCKETS, np.int32)
    for ids, _ in bags:
        texts_with[ids] += 1
    common = texts_with >= least_texts
    vectors[~common] = 0
    for i, (ids, w) in enumerate(bags):
        keep = common[ids]
        bags[i] = ids[keep], w[keep]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(bags)):
            ids, w = bags[i]
            v = vectors[ids]
            mean = w @ v
            z = soft @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ soft
            g = w * w * float(back @ back)
            seen[ids] += g
            vectors[ids] = v - (step * w / np.sqrt(seen[ids]))[:, None] * back
            grad = np.outer(p, mean)
            seen_soft += (grad * grad).mean(axis=1, keepdims=True)
            soft -= 0.1 * step * grad / np.sqrt(seen_soft)
            seen_bias += p * p
            bias -= 0.1 * step * p / np.sqrt(seen_bias)
    return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            made = [bag(t or "") for t in part.column("text").to_pylist()]
            cols = [part.column("doc_id"), part.column("toxic"), pa.array([len(k) for k, _ in made], pa.int64())]
            cols += [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "grams", "ids", "weights"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "ids", "weights")), strict=True)
    rows.sort(key=lambda r: r[0])
    labels = np.array([t > 0 for _, t, _, _ in rows], int)
    bags = [(np.frombuffer(i, np.int32), np.frombuffer(w, np.float32)) for _, _, i, w in rows]
    rows.clear()
    model = train(bags, labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, sample_grams: int = 32_000_000) -> Model:
    """A model of labels (doc_id, toxic), from at most sample_rows labelled texts outside the held-out fold.

    The texts, taken in the order of the sample, have sample_grams n-grams at most (8 bytes each).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    own = own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(*order).limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    scratch = Scratch(docs.sparkSession, "toxicity")
    # The texts are few and long: bags are worth many small tasks.
    bags = scratch.save(rows.repartition(64, "doc_id").mapInArrow(_bags, "doc_id long, toxic int, grams long, ids binary, weights binary"), "bags")
    sizes = bags.select("doc_id", F.sum("grams").over(Window.orderBy(*order)).alias("so_far"))
    taken = bags.join(F.broadcast(sizes.where(F.col("so_far") <= sample_grams).select("doc_id")), "doc_id", "left_semi")
    model = taken.select("doc_id", "toxic", "ids", "weights").repartition(1).mapInArrow(_trained, "weight binary, bias double").first()
    scratch.close()
    return Model(np.frombuffer(bytes(model["weight"]), np.float32), model["bias"]) if model else train([], np.zeros(0))


def _scorer(held, schema: T.StructType):
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        model = Model(np.frombuffer(model[0], np.float32), model[1])
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score = np.zeros(len(texts))
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 300_000):
                    size += len(texts[to])
                    to += 1
                score[at:to] = 1 / (1 + np.exp(-model.logits(texts[at:to])))
                at = to
            cols = {c: batch.column(c) for c in batch.schema.names}
            cols |= {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return run


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """docs (doc_id, text, ...) with held_out, score and predicted."""
    docs = docs.drop("held_out", "score", "predicted")
    model = fit(docs, labels, sample_rows)
    held = spark.sparkContext.broadcast((model.weight.tobytes(), model.bias))  # 1 MB at every size
    more = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *more])
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(_scorer(held, schema), schema)
