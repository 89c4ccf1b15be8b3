"""Comparison of a stored value with a literal of a statement."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotComparable, UnknownOperator
from ..ql.nodes import Predicate

# What a number looks like: decimal, or hexadecimal with a binary exponent; infinities and NaN by name; no spaces, no suffix.
_FINITE = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|0x(?:[0-9a-f]+\.?[0-9a-f]*|\.[0-9a-f]+)p[+-]?[0-9]+)$"
_NAMED = r"(?i)^[+-]?(?:inf(?:inity)?|nan)$"


def _literal(text: str) -> float | None:
    """The number of a statement's literal; None if it is none or beyond the range of doubles."""
    if re.match(_NAMED, text):
        return float(text)
    if not re.match(_FINITE, text):
        return None
    try:
        out = float.fromhex(text) if "x" in text.lower() else float(text)
    except OverflowError:
        return None
    return None if abs(out) == float("inf") else out


def holds(value: Column, predicate: Predicate) -> Column:
    """Whether value op literal; a number in the statement asks for numbers on both sides.

    A stored value that is no number aborts the statement: it is not false, it
    cannot be compared. NaN compares as equal with everything.
    """
    tests = {"=": lambda c: c == 0, "==": lambda c: c == 0, "!=": lambda c: c != 0, "<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0}
    if predicate.op not in tests:
        raise UnknownOperator(predicate.op)
    if not predicate.numeric:
        plain = {"=": value == predicate.value, "==": value == predicate.value, "!=": value != predicate.value, "<": value < predicate.value, "<=": value <= predicate.value, ">": value > predicate.value, ">=": value >= predicate.value}
        return plain[predicate.op]
    right = _literal(predicate.value)
    if right is None:
        raise NotComparable(f"{predicate.value} is no number")
    refusal = F.raise_error(F.concat(F.lit("those operands cannot be compared: "), value, F.lit(f" and {predicate.value}")))
    left = value.try_cast("double")  # reads hexadecimal numbers too
    left = F.when(value.rlike(_FINITE) & (F.abs(left) < float("inf")), left).when(value.rlike(_NAMED), left).otherwise(refusal.cast("double"))
    sign = F.when(F.isnan(left) | F.lit(right != right), 0).when(left < right, -1).when(left > right, 1).otherwise(0)
    return tests[predicate.op](sign)
