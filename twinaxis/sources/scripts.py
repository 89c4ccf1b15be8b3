"""Statements from lines of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException

from ..errors import Refused


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Lines without blank ones and those that begin with --."""
    for line in lines:
        line = line.strip()
        if line and not line.startswith("--"):
            yield line


def run_script(session, lines: Iterable[str], most: int | None = None) -> Iterator[tuple[str, list | str]]:
    """(statement, its rows or the text of its refusal); a refusal does not end the script.

    Rows come to the caller one after the other, at most so many of a statement if a bound is given.
    """
    for text in statements(lines):
        try:
            out = session.run(text)
            rows = [] if out is None else (out if most is None else out.limit(most)).toLocalIterator()
            yield text, list(rows)
        except (Refused, PySparkException) as e:
            yield text, f"refused: {e}"


def transcript(session, lines: Iterable[str], most: int = 1000) -> Iterator[str]:
    """What a reader of a script sees: each statement, its rows, its facets or its refusal."""
    for text in statements(lines):
        yield text
        try:
            out = session.run(text)
            if out is None:
                yield "  recorded"
                continue
            n = 0
            for row in out.limit(most).toLocalIterator():
                n += 1
                yield "  " + "  ".join(f"{k}={v}" for k, v in row.asDict().items())
            yield f"  {n} rows" + " (the first)" * (n == most)
            for name, facet in getattr(out, "facets", {}).items():
                yield f"  {name}: {facet.total} matched"
                for row in facet.values.toLocalIterator():
                    yield f"    {row['value']}: {row['count']}"
        except (Refused, PySparkException) as e:
            yield f"  refused: {e}"
