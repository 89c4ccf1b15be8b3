"""The statement language: text to syntax tree."""

from .nodes import Leg, Page, Predicate, Read, Search, ShapeQuery, TimeClause, Traverse, Write
from .parser import parse, parse_policy

__all__ = ["Leg", "Page", "Predicate", "Read", "Search", "ShapeQuery", "TimeClause", "Traverse", "Write", "parse", "parse_policy"]
