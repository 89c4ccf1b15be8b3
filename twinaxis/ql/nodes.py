"""Syntax trees, as written: defaults are filled in by the compiler."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TimeClause:
    """[AS OF valid_at] [TRANSACTION wall]; None where not written."""

    valid_at: int | None = None
    transaction: int | None = None


@dataclass(frozen=True)
class Page:
    limit: int
    offset: int = 0


@dataclass(frozen=True)
class Predicate:
    attribute: str
    op: str
    value: str
    numeric: bool = False


@dataclass(frozen=True)
class Read:
    """READ of one entity, or with inbound of the entities that reference it. No attributes: all."""

    entity: str
    inbound: bool = False
    attributes: tuple[str, ...] = ()
    where: Predicate | None = None
    without: tuple[str, ...] = ()
    page: Page | None = None
    time: TimeClause = field(default_factory=TimeClause)


@dataclass(frozen=True)
class Search:
    query: str
    attributes: tuple[str, ...]
    limit: int
    facets: tuple[str, ...] = ()
    time: TimeClause = field(default_factory=TimeClause)


@dataclass(frozen=True)
class Traverse:
    root: str
    depth: int
    time: TimeClause = field(default_factory=TimeClause)


@dataclass(frozen=True)
class Leg:
    attribute: str
    kind: str  # required, optional or excluded
    time: TimeClause = field(default_factory=TimeClause)


@dataclass(frozen=True)
class ShapeQuery:
    subject: str
    legs: tuple[Leg, ...]
    metric: str
    op: str
    threshold: float
    time: TimeClause = field(default_factory=TimeClause)


@dataclass(frozen=True)
class Write:
    entity: str
    attribute: str
    value: str
    retract: bool = False
    reference: bool = False
    numeric: bool = False
    valid_from: int | None = None
    valid_to: int | None = None
