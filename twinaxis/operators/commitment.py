"""When a write counts as committed: distinct domains, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NoBound, TooFewDomains, UndeclaredLevel


def committed(writes: DataFrame, acks: DataFrame, epoch: int, least: int) -> DataFrame:
    """writes (position) with domains, ready and published.

    A write is ready when at least so many distinct domains acknowledged it in
    the present epoch (acks: position, domain, epoch); it is published when all
    writes before it are ready too.
    """
    if least < 1:
        raise ValueError("the floor must be positive")
    own = acks.where((F.col("epoch") == epoch) & (F.col("domain") != "")).groupBy("position").agg(F.count_distinct("domain").alias("domains"))
    x = writes.select("position").join(own, "position", "left").withColumn("domains", F.coalesce("domains", F.lit(0).cast("long")))
    x = x.withColumn("ready", F.col("domains") >= least)
    # The first write that is not ready holds up all behind it: one number for the whole log.
    first = x.agg(F.min(F.when(~F.col("ready"), F.col("position"))).alias("first"))
    return x.join(F.broadcast(first)).select("position", "domains", "ready", (F.col("first").isNull() | (F.col("position") < F.col("first"))).alias("published"))


def pending(writes: DataFrame, acks: DataFrame, epoch: int, least: int) -> DataFrame:
    """Unpublished writes and why: too few domains of their own, or a write before them."""
    x = committed(writes, acks, epoch, least).where("not published")
    return x.select("position", "domains", F.when(~F.col("ready"), "domains").otherwise("order").alias("why"))


def shortfall(copies: DataFrame, least: int) -> DataFrame:
    """(leaf, domains, missing) of leaves whose copies (leaf, domain) lie in too few distinct domains."""
    if least < 2:
        raise ValueError("durability needs two domains at least")
    x = copies.groupBy("leaf").agg(F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("domains"))
    return x.where(F.col("domains") < least).withColumn("missing", least - F.col("domains"))


def feasible(targets: DataFrame, least: int) -> bool:
    """Whether a deployment (name, domain) has enough domains for the floor."""
    return targets.where("domain <> ''").select("domain").distinct().limit(least).count() >= least


def require_feasible(nodes: DataFrame, level: str, least: int) -> None:
    """Refuses a floor that a topology (name, level) cannot meet: a level it does not
    have, which would else mean no constraint, or too few domains of that level."""
    own = nodes.where(F.col("level") == level).select("name").distinct().limit(least).count()
    if not own:
        raise UndeclaredLevel(f"the topology has no level {level}")
    if own < least:
        raise TooFewDomains(f"{least} domains of level {level} are needed, the topology has {own}")


class Watchdog:
    """Since when each leaf lies in too few domains; answerable only after a grace.

    One row a short leaf: what observe() keeps is bounded by what is wrong, not by the leaves.
    """

    def __init__(self, grace: int):
        if grace <= 0:
            raise NoBound("a watchdog needs a grace")
        self.grace, self.since = grace, {}

    def observe(self, copies: DataFrame, least: int, at: int) -> None:
        """Looks at all copies (leaf, domain); a leaf that is short still keeps its time, one that recovered is forgotten."""
        now = {r["leaf"]: r["domains"] for r in shortfall(copies, least).toLocalIterator()}
        self.since = {leaf: (self.since.get(leaf, (at, 0))[0], domains) for leaf, domains in now.items()}

    def status(self, now: int) -> list[tuple[str, int, int]]:
        """(leaf, domains, age) of all short leaves, oldest first, those inside the grace too."""
        return [(leaf, domains, now - at) for leaf, (at, domains) in sorted(self.since.items(), key=lambda x: (x[1][0], x[0]))]

    def report(self, obligations, now: int) -> int:
        """Raises an obligation for every leaf that is short for longer than the grace; returns how many."""
        late = [(leaf, now - age) for leaf, _, age in self.status(now) if age > self.grace]
        for leaf, since in late:
            obligations.raise_("durability.leaf-below-floor", leaf, since)
        return len(late)


def in_order(entries: DataFrame) -> DataFrame:
    """entries with their place in the order of recording inside each leaf."""
    w = Window.partitionBy(F.col("tx.leaf_prefix"), F.col("tx.leaf_depth")).orderBy("tx", "ord")
    return entries.withColumn("place", F.row_number().over(w))
