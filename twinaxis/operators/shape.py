"""MATCH SHAPE: rows from required, optional and excluded legs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..ql.nodes import Leg, ShapeQuery
from .carried import carried, shape_of
from .temporal import Snapshot, resolve


def build_rows(datoms: DataFrame, legs: tuple[Leg, ...], now: int, default: Snapshot) -> DataFrame:
    """entity and one column leg<i> for each required or optional leg; unbound is null.

    Legs of one instant share one carried state. A required leg that is missing
    or an excluded one that is there drops the entity.
    """
    at = [resolve(leg.time, now) if (leg.time.valid_at, leg.time.transaction) != (None, None) else default for leg in legs]
    out = carried(datoms, default).select("entity").distinct()
    for snapshot in dict.fromkeys(at):
        own = [(i, leg) for i, leg in enumerate(legs) if at[i] == snapshot]
        held = carried(datoms.where(F.col("attribute").isin(*{leg.attribute for _, leg in own})), snapshot)
        state = held.groupBy("entity").agg(*[F.max(F.when(F.col("attribute") == leg.attribute, F.col("value"))).alias(f"leg{i}") for i, leg in own])
        out = out.join(state, "entity", "left")
    for i, leg in enumerate(legs):
        if leg.kind == "required":
            out = out.where(F.col(f"leg{i}").isNotNull())
        elif leg.kind == "excluded":
            out = out.where(F.col(f"leg{i}").isNull()).drop(f"leg{i}")
    return out


def jaccard(shapes: DataFrame, subject: DataFrame) -> DataFrame:
    """(entity, similarity): shared over all attribute names, against the subject's one row."""
    s = subject.select(F.col("attributes").alias("__s"))
    return shapes.join(F.broadcast(s)).select("entity", (F.size(F.array_intersect("attributes", "__s")) / F.size(F.array_union("attributes", "__s"))).alias("similarity"))


def match_shape(datoms: DataFrame, query: ShapeQuery, now: int, metrics: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The rows of a MATCH SHAPE. The language defines no similarity; a caller registers the metrics it means."""
    metric = (metrics or {}).get(query.metric)
    if metric is None:
        raise Unsupported(f"no similarity metric is defined under the name {query.metric}")
    at = resolve(query.time, now)
    shapes = shape_of(datoms, at)
    near = metric(shapes.where(F.col("entity") != query.subject), shapes.where(F.col("entity") == query.subject))
    near = near.where(F.col("similarity") >= query.threshold if query.op == ">=" else F.col("similarity") > query.threshold)
    return build_rows(datoms, query.legs, now, at).join(near, "entity").orderBy(F.desc("similarity"), "entity")
