"""Carried state: what each entity holds at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .temporal import Snapshot, visible


def latest(datoms: DataFrame) -> DataFrame:
    """The last recorded datom of each tenant, entity and attribute, retractions included.

    The rank filter becomes a group limit, which cuts rows before the exchange.
    """
    w = Window.partitionBy("tenant", "entity", "attribute").orderBy(F.col("tx").desc(), F.col("ord"))
    return datoms.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def tenant_rows(datoms: DataFrame, tenant: int) -> DataFrame:
    """The datoms of one tenant; all a statement of that tenant may see."""
    return datoms.where(F.col("tenant") == tenant)


def carried(datoms: DataFrame, at: Snapshot) -> DataFrame:
    """Visible, then latest, then without retractions; in no other order."""
    return latest(visible(datoms, at)).where(F.col("assert"))


def history(datoms: DataFrame, entity: str) -> DataFrame:
    """All datoms of an entity in the order of recording, each once."""
    one = datoms.where(F.col("entity") == entity)
    return deduplicate(one).orderBy("tx", "ord")


def deduplicate(datoms: DataFrame) -> DataFrame:
    """Rows equal in everything but their arrival become one, the first."""
    keys = [c for c in datoms.columns if c != "ord"]
    return datoms.groupBy(*keys).agg(F.min("ord").alias("ord")).select(*datoms.columns)


def shape_of(datoms: DataFrame, at: Snapshot) -> DataFrame:
    """entity and the sorted names of the attributes it carries."""
    return carried(datoms, at).groupBy("entity").agg(F.sort_array(F.collect_set("attribute")).alias("attributes"))


def entities(datoms: DataFrame) -> DataFrame:
    return datoms.select("entity").distinct().orderBy("entity")


def referrers(datoms: DataFrame, target: str, at: Snapshot) -> DataFrame:
    """Candidates: entities with a visible reference datom to target, withdrawn or not."""
    return visible(datoms, at).where(F.col("is_reference") & (F.col("value") == target)).select("tenant", "entity").distinct()
