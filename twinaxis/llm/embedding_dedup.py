"""Near-duplicate vectors by sorted projection passes.

Every pass sorts all vectors by the signs of 62 random projections read as one
number, so vectors that agree in the first signs stand side by side, and
compares each with its next neighbours. Verified links become stars where they
are found; the passes' stars are united. Within the classes so found, links
are then counted exactly, tile by tile, without writing pairs.

The first passes suppose that signs part the rows evenly, and their number
follows from the row count. Real vectors share directions, so each row's own
chance to have missed a partner at the threshold is measured in the sorted rows:
a partner that agrees in one sign more than the row a window away stands inside
the window. A pair is at risk only if both rows are left with a chance over LEFT.
Those rows get further passes with projections around means instead of zero,
first that of all such rows for the leading signs, then that of the rows with
the same leading signs; a few passes measure how many more are needed. Once
comparing the rest with each other costs less than those passes, or if no number
of passes would do, that is done exactly, in tiles; rows of one class are not
compared again, so a large class of copies costs nothing there.

Defined results: a null vector, one with a null or non-finite component, and a
zero vector link with nothing; vectors of different lengths never link; rows
that repeat an id are vectors of their own, links between rows of one id do not
count and n_links is the sum over the id's rows; a null id links with nothing
and is kept; an empty table gives no rows. Extra columns are ignored. Floats are
compared in double precision, and vectors of doubles too large to square are
scaled first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components, np_components

BITS = 62
#: Leading signs around the common mean, and passes that measure how many are needed, of passes around means.
COARSE, PROBES = 6, 8
#: Rows of a side of a tile of dense rows, and the measured chance of a miss from which a row counts as dense.
DENSE_TILE, LEFT = 2048, 1e-3
#: Rows that a pass handles in the time in which a row is compared with so many others.
ROWS_A_PASS = 4000


def pass_count(rows: int, window: int, threshold: float, miss: float = 1e-4) -> int:
    """Passes after which a pair at the threshold is missed with probability below miss.

    Two vectors at angle t agree in a sign with probability 1 - t / pi; to be
    neighbours they must agree in about log2(rows / window) leading signs.
    """
    if rows <= window:
        return 1
    agree = 1 - math.acos(threshold) / math.pi
    hit = agree ** math.log2(rows / window)
    return max(4, math.ceil(math.log(miss) / math.log1p(-hit)))


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of finite vectors, none zero, at length one in double precision."""
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stacked(rows: pd.Series) -> np.ndarray:
    return _units(np.stack(rows.to_numpy()))


def _planes(seed: int, dim: int, p: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, p]).standard_normal((dim, BITS))


_WEIGHT = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)


def _agree(radius: np.ndarray, threshold: float) -> np.ndarray:
    """Least chance of one sign to agree for a row at a distance from the middle and a partner at the threshold."""
    far = math.sqrt(2 - 2 * threshold)
    return np.where(radius > far, 1 - np.arcsin(np.minimum(1, far / np.maximum(radius, 1e-12))) / math.pi, 0.5)


def _project(passes: range, seed: int, threshold: float, held):
    """One row a vector and pass: pass, dim, key, vec_id, rid, v and the logarithms of the agreement of leading and later signs."""
    plain = math.log(1 - math.acos(threshold) / math.pi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means = held.value if held is not None else {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                raw = [x.tobytes() for x in part["embedding"]]
                unit = _stacked(part["embedding"])
                ids, rid = part["vec_id"].to_numpy(), part["rid"].to_numpy()
                for p in passes:
                    plane = _planes(seed, dim, p)
                    if dim in means:
                        x = unit - means[dim][0]
                        coarse = ((x @ plane[:, :COARSE]) > 0) @ _WEIGHT[-COARSE:]
                        y = unit - means[dim][1][p - passes.start][coarse]
                        key = (coarse << (BITS - COARSE)) + ((y @ plane[:, COARSE:]) > 0) @ _WEIGHT[COARSE:]
                        lead, rest = (np.log(_agree(np.linalg.norm(z, axis=1), threshold)) for z in (x, y))
                    else:
                        key, lead, rest = ((unit @ plane) > 0) @ _WEIGHT, plain, plain
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "key": key, "vec_id": ids, "rid": rid, "v": raw, "lead": lead, "rest": rest})

    return run


SORTED = "pass int, dim int, key long, vec_id long, rid long, v binary, lead double, rest double"


def _sums_of(passes: range | None, seed: int, mean: dict[int, np.ndarray]):
    """Sums of unit vectors by dimension, or around the means by dimension, pass and leading signs; one set a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, list] = {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                unit = _stacked(part["embedding"])
                if passes is None:
                    held = total.setdefault((dim, -1), [np.zeros((1, dim)), np.zeros(1)])
                    held[0] += unit.sum(axis=0)
                    held[1] += len(unit)
                    continue
                for p in passes:
                    held = total.setdefault((dim, p), [np.zeros((1 << COARSE, dim)), np.zeros(1 << COARSE)])
                    cell = (((unit - mean[dim]) @ _planes(seed, dim, p)[:, :COARSE]) > 0) @ _WEIGHT[-COARSE:]
                    by = np.zeros((1 << COARSE, len(unit)))
                    by[cell, np.arange(len(unit))] = 1
                    held[0] += by @ unit
                    held[1] += by.sum(axis=1)
        rows = [(int(d), int(p), c, float(n[c]), s[c].tobytes()) for (d, p), (s, n) in total.items() for c in np.flatnonzero(n)]
        yield pd.DataFrame(rows, columns=["dim", "p", "cell", "n", "s"])

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    s = np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0)
    return pd.DataFrame({"dim": pdf["dim"][:1], "p": pdf["p"][:1], "cell": pdf["cell"][:1], "n": [pdf["n"].sum()], "s": [s.tobytes()]})


def _means(rows: DataFrame, passes: range, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension, the mean unit vector and those of each pass and leading signs: at most len(passes) * 2**COARSE vectors."""
    schema = "dim int, p int, cell int, n double, s binary"

    def sums(of: range | None, mean: dict) -> pd.DataFrame:
        return rows.select("embedding").mapInPandas(_sums_of(of, seed, mean), schema).groupBy("dim", "p", "cell").applyInPandas(_added, schema).toPandas()

    mean = {int(r.dim): np.frombuffer(r.s) / r.n for r in sums(None, {}).itertuples()}
    cells = {d: np.tile(m, (len(passes), 1 << COARSE, 1)) for d, m in mean.items()}
    for r in sums(passes, mean).itertuples():
        cells[int(r.dim)][int(r.p) - passes.start, int(r.cell)] = np.frombuffer(r.s) / r.n
    return {d: (mean[d], cells[d]) for d in mean}


def _windows(window: int, threshold: float, kind: str):
    """Stars (a, b) of the links that are found, and (rid, miss) rows."""

    def links(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out_a, out_b = [], []
        base = 0
        for _, part in rows.groupby(["pass", "dim"], sort=False):
            v = _units(np.stack([np.frombuffer(x, kind) for x in part["v"]]))
            for o in range(1, min(window, len(v) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", v[:-o], v[o:]) >= threshold)
                out_a.append(base + near)
                out_b.append(base + near + o)
            base += len(v)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        """Logarithm of the chance that a row misses a partner in this pass; rows near the ends count in another call, or as missing it."""
        i = np.arange(window, max(window, len(rows) - window))
        key, of, dim = (rows[c].to_numpy() for c in ("key", "pass", "dim"))

        def common(j: np.ndarray) -> np.ndarray:
            signs = BITS - np.frexp((key[i] ^ key[j]).astype(np.float64))[1]
            return np.where((of[i] == of[j]) & (dim[i] == dim[j]), signs, -1)

        need = np.maximum(common(i - window), common(i + window)) + 1
        hit = np.minimum(need, COARSE) * rows["lead"].to_numpy()[i] + np.maximum(need - COARSE, 0) * rows["rest"].to_numpy()[i]
        miss = np.where(need > BITS, 0.0, np.log1p(-np.minimum(np.exp(hit), 1 - 1e-12)))
        return pd.DataFrame({"rid": rows["rid"].to_numpy()[i], "miss": miss})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in batches:
            for at in range(0, len(pdf), 8192):
                part = pdf.iloc[at : at + 8192]
                rows = part if tail is None else pd.concat([tail, part], ignore_index=True)
                a, b = links(rows)
                lab = np_components(len(rows), a, b)
                ids = rows["vec_id"].to_numpy()
                own = np.flatnonzero(lab != np.arange(len(rows)))
                yield pd.DataFrame({"a": ids[own], "b": ids[lab[own]], "rid": None, "miss": 0.0})
                yield measured(rows).assign(a=None, b=None)[["a", "b", "rid", "miss"]]
                tail = rows.iloc[-2 * window :]

    return run


def _passed(scratch: Scratch, rows: DataFrame, passes: range, window: int, threshold: float, seed: int, held, kind: str) -> tuple[DataFrame, DataFrame]:
    """Stars (a, b) and (rid, miss, n) after the passes; rows (rid, vec_id, embedding)."""
    sorted_ = (
        rows.select("rid", "vec_id", "embedding")
        .mapInPandas(_project(passes, seed, threshold, held), SORTED)
        .repartitionByRange("pass", "dim", "key", "vec_id")
        .sortWithinPartitions("pass", "dim", "key", "vec_id")
    )
    out = sorted_.mapInPandas(_windows(window, threshold, kind), "a long, b long, rid long, miss double")
    out = scratch.save(out.groupBy("a", "b", "rid").agg(F.sum("miss").alias("miss"), F.count("*").alias("n")), "links")
    return out.where("rid is null and a <> b").select("a", "b"), out.where("rid is not null").select("rid", "miss", "n")


def _dense_tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out = [pd.DataFrame({"a": none, "b": none})]
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        for _, rows in pdf.groupby(pdf["embedding"].map(len)):
            v, blk = _stacked(rows["embedding"]), rows["blk"].to_numpy()
            ids, own = rows["vec_id"].to_numpy(), rows["class"].to_numpy()
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                a, b = np.nonzero((v[part] @ v[right].T >= threshold) & (own[part][:, None] != own[right]))
                lab = np_components(len(v), part[a], right[b])
                new = np.flatnonzero(lab != np.arange(len(v)))
                out.append(pd.DataFrame({"a": ids[new], "b": ids[lab[new]]}))
        return pd.concat(out)

    return run


def dense_links(scratch: Scratch, rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between rows (vec_id, embedding, class) of different classes, compared exactly.

    A class over a tile has blocks of its own, which are not compared with each other.
    """
    size = scratch.save(rows.groupBy("class").agg(F.count("*").alias("m")), "sizes")
    large = size.where(F.col("m") > DENSE_TILE).select("class", F.ceil(F.col("m") / DENSE_TILE).alias("own"))
    # As many classes over a tile as there are tiles at most.
    order = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    large = scratch.save(large.select("class", "own", (F.sum("own").over(order) - F.col("own")).alias("first")), "large")
    counts = large.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("own")).first()["own"], size.where(F.col("m") <= DENSE_TILE).agg(F.sum("m").alias("m")).first()["m"] or 0
    mixed = -(-counts[1] // DENSE_TILE)
    last = F.lit(counts[0] + mixed - 1).cast("long")
    x = rows.join(large, "class", "left")
    blk = F.when(F.col("own").isNotNull(), F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("own"))).otherwise(counts[0] + F.pmod(F.xxhash64("class"), F.lit(max(1, mixed)))).cast("long")
    every = F.sequence(F.lit(0).cast("long"), last)
    others = F.when(F.col("own").isNull(), every).otherwise(F.array_except(every, F.sequence(F.col("first").cast("long"), (F.col("first") + F.col("own") - 1).cast("long"))))
    x = x.withColumn("blk", blk).withColumn("other", F.explode(others))
    x = x.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "vec_id", "embedding", "class")
    return scratch.save(x.groupBy("i", "j").applyInPandas(_dense_tile(threshold), "a long, b long"), "links")


def _tile(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iat[0], pdf["j"].iat[0]
        parts = []
        for _, rows in pdf.groupby(pdf["embedding"].map(len)):
            v, blk, ids = _stacked(rows["embedding"]), rows["blk"].to_numpy(), rows["vec_id"].to_numpy()
            left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
            counts = np.zeros(len(v), np.int64)
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                hit = (v[part] @ v[right].T >= threshold) & (ids[part][:, None] != ids[right])
                counts[part] += hit.sum(1)
                if i != j:
                    counts[right] += hit.sum(0)
            parts.append(pd.DataFrame({"vec_id": ids, "n": counts}))
        return pd.concat(parts)

    return run


#: Classes whose sums a task holds at once.
HELD_CLASSES = 4096


def _class_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"component_id": list(held), "s": [x.tobytes() for x in held.values()]})

    for pdf in batches:
        for c, rows in pdf.groupby("component_id"):
            held[c] = held.get(c, 0) + _stacked(rows["embedding"]).sum(axis=0)
        if len(held) >= HELD_CLASSES:
            yield out()
            held = {}
    yield out()


def _middle(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x) for x in pdf["s"]], axis=0)
    return pd.DataFrame({"component_id": pdf["component_id"][:1], "middle": [total.tobytes()]})


def _core(threshold: float):
    half = math.acos(threshold) / 2 - 1e-6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, rows in pdf.groupby("component_id"):
                middle = np.frombuffer(rows["middle"].iat[0])
                norm = np.linalg.norm(middle)
                near = _stacked(rows["embedding"]) @ (middle / norm) if norm > 0 else np.zeros(len(rows))
                yield rows[["component_id", "vec_id", "embedding"]].assign(core=near >= math.cos(half))

    return run


def near_duplicate_vectors(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.95, window: int = 32, tile: int = 512, seed: int = 7, rows_a_pass: int = ROWS_A_PASS
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    A class over tile vectors is parted into a core, whose vectors are all linked
    with each other by the triangle inequality of angles, and a rim. Rim vectors
    are compared with the class in tiles of about tile by tile rows dealt by
    hash; no task holds more, and only counts leave it.
    """
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fine = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(
        "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        fine, kind = fine.withColumn("embedding", F.col("embedding").cast("array<double>")), "double"
    array, kind = f"array<{kind}>", {"float": "<f4", "double": "<f8"}[kind]
    fine = fine.select("vec_id", "embedding", F.xxhash64("vec_id", "embedding").alias("rid"))
    label = None

    def united(links: DataFrame) -> DataFrame:
        return components(scratch, links if label is None else label.toDF("a", "b").union(links))

    # Chances add up over passes; rows alike in id and vector share theirs.
    log_left = math.log(LEFT)
    n_rows = fine.count()
    left, passes, held = fine.withColumn("so_far", F.lit(0.0)), range(pass_count(n_rows, window, threshold)), None
    while True:
        links, miss = _passed(scratch, left, passes, window, threshold, seed, held, kind)
        label = united(links)
        own = F.coalesce(F.col("miss") * F.least(F.lit(1.0), F.lit(len(passes)) / F.col("n")), F.lit(0.0))
        left = left.join(miss, "rid", "left").withColumn("rate", -own / len(passes)).withColumn("so_far", F.col("so_far") + own)
        left = scratch.save(left.where(F.col("so_far") > log_left).select("rid", "vec_id", "embedding", "so_far", "rate"), "left")
        # How many passes the slowest but a few of the rows left would need, at the rate of the last ones.
        more = (F.col("so_far") - log_left) / F.greatest("rate", F.lit(1e-9))
        now = left.agg(F.count("*").alias("n"), F.percentile_approx(more, 0.95, 1000).alias("more")).first()
        n_left, first = now["n"], held is None
        wanted = PROBES if first else math.ceil(now["more"] or 0)
        if n_left <= max(2 * DENSE_TILE, rows_a_pass * wanted):
            break
        passes = range(passes.stop, passes.stop + wanted)
        # The means and the numbers of a long run of passes are handled in parts.
        passes = range(passes.start, passes.start + min(len(passes), 64))
        held = spark.sparkContext.broadcast(_means(left, passes, seed))
    dense = left.join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    dense = scratch.save(dense.select("vec_id", "embedding", F.coalesce("component_id", "vec_id").alias("class")), "dense")
    if not dense.isEmpty():
        more = dense_links(scratch, dense, threshold)
        if not more.isEmpty():
            label = united(more)

    size = label.groupBy("component_id").agg(F.count("*").alias("m"))
    members = fine.drop("rid").join(label.withColumnRenamed("id", "vec_id"), "vec_id").join(size, "component_id")
    zero = F.lit(0).cast("long")
    small = members.where(F.col("m") <= tile).select("component_id", zero.alias("i"), zero.alias("j"), zero.alias("blk"), "vec_id", "embedding")

    # Two vectors within half the angle of one direction are within the angle of each other:
    # the core of a large class is linked throughout and needs no comparison.
    large = members.where(F.col("m") > tile).select("component_id", "vec_id", "embedding")
    sums = large.mapInPandas(_class_sums, "component_id long, s binary")
    middle = sums.groupBy("component_id").applyInPandas(_middle, "component_id long, middle binary")
    placed = large.join(middle, "component_id").mapInPandas(_core(threshold), f"component_id long, vec_id long, embedding {array}, core boolean")
    placed = scratch.save(placed, "placed")
    parts = placed.groupBy("component_id").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rim"))
    placed = placed.join(parts, "component_id").where(F.col("core") | (F.col("n_rim") > 0))
    rims, cores = F.ceil(F.col("n_rim") / tile), F.ceil(F.col("n_core") / tile)
    # Blocks of the rim have the numbers below rims, blocks of the core those above.
    own = F.when(F.col("core"), rims + F.pmod(F.xxhash64("vec_id"), cores)).otherwise(F.pmod(F.xxhash64("vec_id"), rims))
    others = F.sequence(zero, F.when(F.col("core"), rims).otherwise(rims + cores) - 1)
    rim = placed.where("n_rim > 0").select("component_id", "vec_id", "embedding", own.alias("blk"), F.explode(others).alias("other"))
    rim = rim.select("component_id", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "vec_id", "embedding")
    counts = small.union(rim).groupBy("component_id", "i", "j").applyInPandas(_tile(threshold), "vec_id long, n long")
    in_core = placed.where("core").groupBy("vec_id", "n_core").agg(F.count("*").alias("copies"))
    counts = counts.union(in_core.select("vec_id", F.col("copies") * (F.col("n_core") - F.col("copies"))))
    counts = counts.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    linked = scratch.save(label.withColumnRenamed("id", "vec_id").join(counts, "vec_id", "left"), "linked")
    scratch.keep_only(linked)
    return (
        rows.select("vec_id")
        .join(linked, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )
