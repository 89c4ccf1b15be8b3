"""Shared plumbing: scratch tables in the shared folder and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, hadoop_path, read_text, scope, shared_root, write_text

__all__ = ["Scratch", "components", "hadoop_path", "np_components", "read_table", "read_text", "scope", "shared_root", "star", "write_text"]


def np_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the links (a, b)."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        m = np.minimum(la, lb)
        new = lab.copy()
        np.minimum.at(new, la, m)
        np.minimum.at(new, lb, m)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        open_ = new[a] != new[b]
        a, b, lab = a[open_], b[open_], new
    return lab


def star(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: (node, smallest reachable node), roots left out."""
    ids, inv = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    k = len(ids_a)
    lab = np_components(len(ids), inv[:k], inv[k:])
    own = lab != np.arange(len(ids))
    return ids[own], ids[lab[own]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    rows = 0

    def flush() -> pd.DataFrame:
        x = pd.concat(held)
        v, r = star(x["a"].to_numpy(), x["b"].to_numpy())
        return pd.DataFrame({"v": v, "r": r})

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= 500_000:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (id, component_id) per linked node.

    Blocks of links are first contracted to stars where they lie; then large-star
    and small-star rounds alternate until only stars are left. Each round is two
    aggregations with map-side combine and two joins that AQE can split where a
    node has very many links. No link, label or node reaches the driver.
    """
    e = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = scratch.save(e.mapInPandas(_contract, "v long, r long").distinct(), "stars")
    while True:
        x = e.select("v", "r", F.col("r").alias("x"))
        done = x.groupBy("v").agg(F.count("*").alias("n")).agg(F.count("*").alias("nodes"), F.sum("n").alias("links")).first()
        if not done["links"]:
            break
        if done["links"] == done["nodes"] and e.join(e.select(F.col("v").alias("w")), F.col("r") == F.col("w"), "left_semi").isEmpty():
            break
        both = e.union(e.select("r", "v")).toDF("u", "w")
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("r")).distinct()
        low = big.groupBy("v").agg(F.min("r").alias("m"))
        small = big.join(low, "v").where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r"))
        nxt = scratch.save(small.union(low.select("v", F.col("m").alias("r"))).distinct(), "stars")
        scratch.drop(e)
        e = nxt
    roots = e.select(F.col("r").alias("id"), F.col("r").alias("component_id")).distinct()
    return scratch.save(e.select(F.col("v").alias("id"), F.col("r").alias("component_id")).union(roots), "labels")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
