"""Entity keys and leaves as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32


def entity_key(tenant: Column, entity: Column) -> Column:
    """32 bytes: two of the tenant, then the first 30 of SHA-256 of the entity."""
    return F.unhex(F.concat(F.lpad(F.hex(tenant), 4, "0"), F.substring(F.sha2(entity.cast("binary"), 256), 1, 60)))


def leaf(key: Column, depth: int | Column) -> Column:
    """The leaf of a key: its first depth bytes."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring(key, F.lit(1), depth)


def leaf_name(key: Column, depth: int | Column) -> Column:
    """depth:hex, as leaves are written."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.concat(depth.cast("string"), F.lit(":"), F.lower(F.hex(leaf(key, depth))))


def key_bytes(tenant: int, entity: str) -> bytes:
    return tenant.to_bytes(2, "big") + hashlib.sha256(entity.encode()).digest()[: KEY_BYTES - 2]


def parse_leaf(text: str) -> tuple[int, bytes]:
    """(depth, prefix) of a leaf written as depth:hex."""
    depth, _, digits = text.partition(":")
    if not depth.isdigit() or not 1 <= int(depth) <= KEY_BYTES or len(digits) != 2 * int(depth):
        raise ValueError(f"{text!r} is no leaf: depth 1 to {KEY_BYTES}, then two digits for each byte")
    return int(depth), bytes.fromhex(digits)
