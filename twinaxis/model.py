"""The datom: one fact about one entity on two time axes.

valid_from <= t < valid_to says when the fact was true; tx says when and by whom
it was recorded. A withdrawn fact is a row with assert = false, never a missing
row. Instants are plain 64-bit numbers; the unit is the writer's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The open end of a validity interval.
FOREVER = (1 << 63) - 1

#: Fields in the order that makes a struct comparison the order of recording.
TX = T.StructType(
    [
        T.StructField("wall", T.LongType(), False),
        T.StructField("logical", T.LongType(), False),  # unsigned 32 bits
        T.StructField("leaf_prefix", T.BinaryType(), False),
        T.StructField("leaf_depth", T.ShortType(), False),
        T.StructField("seq", T.LongType(), False),  # unsigned 32 bits
    ]
)

DATOMS = T.StructType(
    [
        T.StructField("tenant", T.IntegerType(), False),
        T.StructField("entity", T.StringType(), False),
        T.StructField("attribute", T.StringType(), False),
        T.StructField("value", T.StringType(), False),
        T.StructField("is_reference", T.BooleanType(), False),
        T.StructField("valid_from", T.LongType(), False),
        T.StructField("valid_to", T.LongType(), False),
        T.StructField("assert", T.BooleanType(), False),
        T.StructField("tx", TX, False),
        T.StructField("ord", T.LongType(), False),  # arrival order; decides between equal tx only
    ]
)


@dataclass(frozen=True, order=True)
class TxId:
    """A transaction id; compares like the tx column."""

    wall: int
    logical: int = 0
    leaf_prefix: bytes = b""
    leaf_depth: int = 0
    seq: int = 0

    def column(self) -> Column:
        return tx_column(F.lit(self.wall), F.lit(self.seq), F.lit(self.logical), F.lit(self.leaf_prefix), F.lit(self.leaf_depth))

    def row(self) -> tuple:
        return (self.wall, self.logical, bytearray(self.leaf_prefix), self.leaf_depth, self.seq)


def tx_column(wall: Column, seq: Column, logical: Column | None = None, prefix: Column | None = None, depth: Column | None = None) -> Column:
    return F.struct(
        wall.cast("long").alias("wall"),
        (logical if logical is not None else F.lit(0)).cast("long").alias("logical"),
        (prefix if prefix is not None else F.lit(b"")).cast("binary").alias("leaf_prefix"),
        (depth if depth is not None else F.lit(0)).cast("short").alias("leaf_depth"),
        seq.cast("long").alias("seq"),
    )
