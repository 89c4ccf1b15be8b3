"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids with the end id are cut into full windows, which are sequences
by themselves, and a rest cut into pieces of at most 512. Blocks of a fixed
number of pieces are dealt into windows: each piece starts as a partial
partition; the two partial partitions with the largest imbalance are merged,
the fullest windows of one with the emptiest of the other, until one is left.
The window count starts at the total over the capacity and rises whenever a
window exceeds the capacity.

Blocks lie inside an input partition, so nothing is shuffled, memory is bounded
by one block, and a lost task is repeated with the same result.

Defined results: a null or empty text is the end id alone; rows with a null or
repeated id are packed like all others; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .word_bpe import shared_bpe

#: Characters of text that are encoded together.
AT_ONCE = 2_000_000


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size after multiway differencing into the given number of windows."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n * 2, -1, np.int64), np.full(2 * n * 2, -1, np.int64)
    nodes = n
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-int(size), i, np.array([int(size)]), np.array([i])))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, la, ia = heapq.heappop(heap)
        _, _, lb, ib = heapq.heappop(heap)
        # Loads are in descending order; windows past the end of an array are empty.
        ka, kb = len(la), len(lb)
        if ka + kb <= windows:
            load, node = np.concatenate([la, lb]), np.concatenate([ia, ib])
        else:
            over = ka + kb - windows
            both = np.arange(over)
            new = nodes + both
            nodes += over
            if nodes > len(left):
                left = np.concatenate([left, np.full(nodes, -1)])
                right = np.concatenate([right, np.full(nodes, -1)])
            pa_, pb_ = ka - over + both, kb - 1 - both
            left[new], right[new] = ia[pa_], ib[pb_]
            load = np.concatenate([la[: ka - over], la[pa_] + lb[pb_], lb[: kb - over]])
            node = np.concatenate([ia[: ka - over], new, ib[: kb - over]])
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        if len(load) == windows:
            load = load - load[-1]
        spread = int(load[0]) - (int(load[-1]) if len(load) == windows else 0)
        heapq.heappush(heap, (-spread, tick, load, node))
        tick += 1
    out = np.zeros(n, np.int64)
    for w, root in enumerate(heap[0][3]):
        stack = [int(root)]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += (int(left[x]), int(right[x]))
    return out


def deal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none over the capacity; window numbers are gapless."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        at = difference(sizes, windows) if windows < len(sizes) else np.arange(len(sizes))
        most = int(np.bincount(at, sizes).max())
        if most <= capacity:
            return np.unique(at, return_inverse=True)[1]
        windows += max(1, windows * (most - capacity) // (4 * capacity))


def _packer(path: str, capacity: int, piece: int, block: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(path)
        base = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        made = 0
        full: list[tuple] = []
        rest: list[tuple] = []

        def rows(out: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, tokens, seq, off = zip(*out, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def dealt() -> list[tuple]:
            nonlocal made
            at = deal(np.array([len(x[2]) // 4 for x in rest]), capacity)
            out, used = [], {}
            for i in np.argsort(at, kind="stable"):
                w = int(at[i])
                out.append((*rest[i], base + made + w, used.get(w, 0)))
                used[w] = used.get(w, 0) + len(rest[i][2]) // 4
            made += len(used)
            rest.clear()
            return out

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(docs):
                some, size = [], 0
                while at + len(some) < len(docs) and (not some or size < AT_ONCE):
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                yield from zip(docs[at : at + len(some)], bpe.encode_batch(some), strict=True)
                at += len(some)

        for batch in batches:
            for doc, ids in encoded(batch):
                ids += end
                tokens = len(ids) // 4
                at = 0
                while tokens - at >= capacity:
                    full.append((doc, at, ids[4 * at : 4 * (at + capacity)], tokens, base + made, 0))
                    made += 1
                    at += capacity
                while at < tokens:
                    to = min(tokens, at + piece)
                    rest.append((doc, at, ids[4 * at : 4 * to], tokens))
                    at = to
                if len(rest) >= block:
                    full += dealt()
                if len(full) >= 1000:
                    yield rows(full)
                    full = []
        if rest:
            full += dealt()
        if full:
            yield rows(full)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, piece: int = 512, block: int = 768, end_id: int = 1) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, ids (little-endian uint32), doc_tokens, sequence_id, offset."""
    run = _packer(tokenizer or default_tokenizer(), capacity, piece, block, end_id)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")
