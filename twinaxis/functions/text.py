"""Text analysis for search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def analyze(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    """The distinct terms of a query, in order."""
    out, word = [], []
    for c in text.lower() + " ":
        if c.isalpha() or c.isdecimal():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return list(dict.fromkeys(out))
