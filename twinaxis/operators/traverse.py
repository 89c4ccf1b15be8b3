"""Breadth-first walks over the references carried at one instant.

Every level is written before the next one reads it, so a level's plan holds one
scan of the frontier and one of the edges, however deep the walk goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CycleFound, NoDepth
from ..scratch import Scratch
from .carried import carried
from .temporal import Snapshot

STEP = ["root", "depth", "path", "entity"]


def edges(datoms: DataFrame, at: Snapshot) -> DataFrame:
    """(src, attribute, dst): only references; a literal that spells an entity is none."""
    return carried(datoms, at).where("is_reference").select(F.col("entity").alias("src"), "attribute", F.col("value").alias("dst"))


def _levels(scratch: Scratch, roots: DataFrame, depth: int, strict: bool, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All levels of the walk; links_of(frontier) gives the edges that leave a frontier (entity)."""
    if depth <= 0:
        raise NoDepth("a walk needs a positive depth")
    frontier = roots.select(F.col("entity").alias("root"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"), "entity").distinct()
    seen = frontier = scratch.save(frontier, "level")
    out = None
    for level in range(1, depth + 1):
        found = frontier.join(links_of(frontier.select("entity")), F.col("entity") == F.col("src")).select(
            "root", F.lit(level).alias("depth"), F.concat("path", F.array("attribute")).alias("path"), F.col("dst").alias("entity")
        )
        if not strict:
            first = found.groupBy("root", "entity").agg(F.min("path").alias("path"), F.min("depth").alias("depth"))
            found = first.select(*STEP).join(seen.select("root", "entity"), ["root", "entity"], "left_anti").select(*STEP)
        found = scratch.save(found, "level")
        if strict:
            # A root's entity that occurs twice, on this level or before, refuses the statement.
            own = found.select("root", "entity")
            twice = own.groupBy("root", "entity").count().where("count > 1").select("root", "entity")
            twice = twice.union(own.join(seen.select("root", "entity"), ["root", "entity"], "left_semi")).first()
            if twice is not None:
                raise CycleFound(f"the walk from {twice['root']} returned to {twice['entity']}")
        out = found if out is None else out.union(found)
        if found.isEmpty():
            break
        seen, frontier = seen.union(found), found
    return out


def walk(spark: SparkSession, links: DataFrame, roots: DataFrame, depth: int, strict: bool = True) -> DataFrame:
    """(root, depth, path, entity) of everything within depth references of each root (entity).

    path holds the attributes followed and orders a level as the walk finds it.
    strict refuses a walk that meets any entity of its root twice, which a
    diamond does too; else the first meeting counts and the walk goes on. For
    many roots: the edges are reduced and written once.
    """
    scratch = Scratch(spark, "walk")
    links = scratch.save(links.select("src", "attribute", "dst"), "edges")
    return _levels(scratch, roots, depth, strict, lambda _: links)


def traverse(spark: SparkSession, datoms: DataFrame, root: str, depth: int, at: Snapshot) -> DataFrame:
    """(depth, entity) in the order of the walk.

    For one root: each level reduces the histories of its own frontier alone.
    """
    scratch = Scratch(spark, "walk")
    start = spark.createDataFrame([(root,)], "entity string")
    out = _levels(scratch, start, depth, True, lambda frontier: edges(datoms.join(frontier.distinct(), "entity", "left_semi"), at))
    return out.orderBy("depth", "path").select("depth", "entity")
