"""Visibility on two axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoSnapshot, UnboundInstant
from ..model import TxId
from ..ql.nodes import TimeClause


@dataclass(frozen=True)
class Snapshot:
    """What is true at valid_at, as recorded up to known (None: everything recorded)."""

    valid_at: int | None
    known: TxId | None = None


def resolve(clause: TimeClause, now: int) -> Snapshot:
    """Fills a clause's defaults; called once a statement, so all its parts see one instant.

    TRANSACTION n is the lowest id with that wall clock, so facts recorded at n
    are left out.
    """
    if clause.transaction == 0:
        raise NoSnapshot("transaction 0 names no snapshot")
    known = None if clause.transaction is None else TxId(clause.transaction)
    return Snapshot(now if clause.valid_at is None else clause.valid_at, known)


def visible(datoms: DataFrame, at: Snapshot) -> DataFrame:
    """The datoms valid at the instant and recorded by the bound; the two tests are independent."""
    if at.valid_at is None:
        raise UnboundInstant("the query has no instant of validity")
    out = datoms.where((F.col("valid_from") <= at.valid_at) & (F.col("valid_to") > at.valid_at))
    if at.known is not None:
        # The first test follows from the second; it is there because Parquet can prune by it.
        out = out.where((F.col("tx.wall") <= at.known.wall) & (F.col("tx") <= at.known.column()))
    return out
