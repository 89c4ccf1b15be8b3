"""Grants as datoms. Decisions take no instant: present grants decide, also about the past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotGranted, ReservedTenant
from .carried import carried, history
from .temporal import Snapshot

SYSTEM_TENANT = 0


def grant_entity(tenant: int, action: str) -> str:
    return f"grant:{tenant:04x}:{action}"


def present_grants(datoms: DataFrame, now: int) -> DataFrame:
    """(entity, principal): who holds which grant now. The principals are the attributes of a grant."""
    own = datoms.where((F.col("tenant") == SYSTEM_TENANT) & F.col("entity").startswith("grant:"))
    return carried(own, Snapshot(now)).select("entity", F.col("attribute").alias("principal"))


def allow(datoms: DataFrame, principal: str, tenant: int, action: str, now: int) -> None:
    """Returns if the principal may read or write the tenant; refuses otherwise."""
    if tenant == SYSTEM_TENANT:
        raise ReservedTenant("the system tenant cannot be granted")
    own = datoms.where(F.col("entity") == grant_entity(tenant, action))
    if present_grants(own, now).where(F.col("principal") == principal).isEmpty():
        raise NotGranted(f"{principal} holds no {action} grant on tenant {tenant}")


def grant_history(datoms: DataFrame, tenant: int, action: str) -> DataFrame:
    """Every record of a grant, in the order of recording."""
    return history(datoms.where(F.col("tenant") == SYSTEM_TENANT), grant_entity(tenant, action))


def denied_certificates(datoms: DataFrame, now: int) -> DataFrame:
    """(serial): certificates with a denial carried now."""
    own = datoms.where((F.col("tenant") == SYSTEM_TENANT) & (F.col("attribute") == "certificate:denied"))
    return carried(own, Snapshot(now)).select(F.expr("substring(entity, 6)").alias("serial"))
