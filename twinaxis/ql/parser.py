"""Statements to syntax trees.

The clause order is fixed; see the grammar in the README. Every refusal names
the byte where it stands.
"""

from __future__ import annotations

from collections.abc import Callable

from .. import errors as e
from .nodes import Leg, Page, Predicate, Read, Search, ShapeQuery, TimeClause, Traverse, Write
from .tokens import Token, tokens

OPERATORS = ("=", "==", "!=", "<", "<=", ">", ">=")
CODECS = {"none": "uncompressed", "identity": "uncompressed", "zstd": "zstd"}


class _Cursor:
    def __init__(self, source: str):
        self.all, self.at = tokens(source), 0

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def take(self) -> Token:
        t = self.now
        self.at = min(self.at + 1, len(self.all) - 1)
        return t

    def refuse(self, expected: str, error: type[e.ParseError] = e.ParseError, at: Token | None = None):
        t = at or self.now
        raise error(t.position, str(t), expected)

    def has(self, kind: str, *texts: str) -> bool:
        return self.now.kind == kind and (not texts or self.now.text in texts)

    def word(self, *words: str) -> bool:
        """Takes the keywords if they come next; the first one decides."""
        if not self.has("keyword", words[0]):
            return False
        for w in words:
            if not self.has("keyword", w):
                self.refuse(f"keyword {w}")
            self.take()
        return True

    def need(self, kind: str, expected: str, *texts: str, error: type[e.ParseError] = e.ParseError) -> Token:
        if not self.has(kind, *texts):
            self.refuse(expected, error)
        return self.take()

    def name(self, what: str) -> str:
        t = self.need("ident", what)
        if not t.text:
            self.refuse(what, at=t)
        return t.text

    def integer(self, what: str, least: int | None = None, error: type[e.ParseError] = e.ParseError) -> int:
        t = self.need("number", what, error=error)
        try:
            n = int(t.text)
        except ValueError:
            self.refuse(what, error, t)
        if not -(1 << 63) <= n < 1 << 63 or (least is not None and n < least):
            self.refuse(what, error, t)
        return n

    def listed(self, one: Callable[[], object]) -> list:
        out = [one()]
        while self.has("punct", ","):
            self.take()
            out.append(one())
        return out


def _time(c: _Cursor) -> TimeClause:
    valid = c.integer("an integer instant") if c.word("AS", "OF") else None
    return TimeClause(valid, c.integer("an integer transaction reference") if c.word("TRANSACTION") else None)


def _value(c: _Cursor) -> tuple[str, bool]:
    if not (c.has("number") or c.has("string") or c.has("ident")):
        c.refuse("a value")
    t = c.take()
    return t.text, t.kind == "number"


def _read(c: _Cursor) -> Read:
    def attribute() -> tuple[Token, bool, str]:
        first, marked = c.now, c.has("punct", "->")
        if marked:
            c.take()
        return first, marked, c.name("an attribute name")

    projected = []
    if c.has("punct", "*"):
        c.take()
    else:
        projected = c.listed(attribute)
    if not c.word("FROM"):
        c.refuse("keyword FROM")
    inbound = c.has("punct", "[")
    if inbound:
        c.take()
    entity = c.name("an entity name")
    if inbound:
        c.need("punct", 'a closing "]"', "]")

    def names(found: list) -> tuple[str, ...]:
        for t, marked, name in found:
            if marked and not inbound:
                c.refuse(f"a bare {name}, because FROM names one entity; FROM [{entity}] reads the entities that point at it", e.JoinNotSupported, t)
            if inbound and not marked:
                c.refuse(f"->{name}, because FROM names a set; a bare name would be an attribute of {entity}, which is a join", e.JoinNotSupported, t)
        return tuple(n for _, _, n in found)

    attributes, where, without, page = names(projected), None, (), None
    if c.word("WHERE"):
        on = attribute()
        op = c.need("punct", "a comparison operator", *OPERATORS).text
        value, numeric = _value(c)
        where = Predicate(*names([on]), op, value, numeric)
    if c.word("WITHOUT"):
        without = names(c.listed(attribute))
    if c.has("keyword", "OFFSET"):
        c.refuse("keyword LIMIT before OFFSET")
    if c.has("keyword", "LIMIT"):
        if not inbound:
            c.refuse(f"no page, because one entity has nothing to page; FROM [{entity}] reads a set")
        c.take()
        page = Page(c.integer("a row count of zero or more", 0), c.integer("an offset of zero or more", 0) if c.word("OFFSET") else 0)
    return Read(entity, inbound, attributes, where, without, page, _time(c))


def _search(c: _Cursor) -> Search:
    query = c.need("string", "a quoted search query").text
    if not c.word("IN"):
        c.refuse("keyword IN")
    attributes = tuple(c.listed(lambda: c.name("an attribute name")))
    facets = tuple(c.listed(lambda: c.name("an attribute name"))) if c.word("FACET", "BY") else ()
    if not c.word("LIMIT"):
        c.refuse("keyword LIMIT: a search needs a positive LIMIT", e.NoSearchLimit)
    limit = c.integer("a positive whole limit", 1, e.NoSearchLimit)
    return Search(query, attributes, limit, facets, _time(c))


def _shape(c: _Cursor) -> ShapeQuery:
    if not c.word("SHAPE", "LIKE"):
        c.refuse("keyword SHAPE")
    subject, legs = c.name("a subject to match against"), []
    for word, kind in (("REQUIRE", "required"), ("OPTIONAL", "optional"), ("WITHOUT", "excluded")):
        if c.word(word):
            legs += c.listed(lambda kind=kind: Leg(c.name("an attribute name"), kind, _time(c)))
    if not c.word("SIMILARITY"):
        c.refuse("keyword SIMILARITY: a shape query needs a metric and a threshold", e.NoThreshold)
    metric = c.name("a similarity metric")
    op = c.need("punct", ">= or >", ">=", ">", error=e.NoThreshold).text
    t = c.need("number", "a threshold", error=e.NoThreshold)
    try:
        threshold = float(t.text)
    except ValueError:
        c.refuse("a numeric threshold", at=t)
    return ShapeQuery(subject, tuple(legs), metric, op, threshold, _time(c))


def _write(c: _Cursor, retract: bool) -> Write:
    entity, attribute = c.name("an entity name"), c.name("an attribute name")
    c.need("punct", "= before the value", "=", "==")
    reference = c.has("punct", "->")
    if reference:
        c.take()
        value, numeric = c.name("an entity name after ->"), False
    else:
        value, numeric = _value(c)
    start = end = None
    if c.word("VALID", "FROM"):
        start = c.integer("an instant for VALID FROM")
        end = c.integer("an instant for TO") if c.word("TO") else None
    if c.has("keyword", "TRANSACTION"):
        c.refuse("end of statement: the time of recording is assigned by the system", e.TransactionTimeNotYours)
    return Write(entity, attribute, value, retract, reference, numeric, start, end)


def _traverse(c: _Cursor) -> Traverse:
    root = c.name("an entity to start from")
    if not c.word("DEPTH"):
        c.refuse("keyword DEPTH: a traversal needs a positive DEPTH", e.NoDepth)
    return Traverse(root, c.integer("a positive whole depth", 1, e.NoDepth), _time(c))


def parse(source: str) -> Read | Search | ShapeQuery | Traverse | Write:
    """The syntax tree of one statement."""
    c = _Cursor(source)
    if c.has("keyword", "SELECT"):
        c.refuse("READ, which replaced SELECT", e.SelectRenamed)
    heads = {
        "READ": _read,
        "MATCH": _shape,
        "SEARCH": _search,
        "ASSERT": lambda c: _write(c, False),
        "RETRACT": lambda c: _write(c, True),
        "TRAVERSE": _traverse,
    }
    if not c.has("keyword", *heads):
        c.refuse("READ, MATCH, SEARCH, ASSERT, RETRACT or TRAVERSE")
    out = heads[c.take().text](c)
    c.need("end", "end of statement")
    return out


def parse_policy(source: str) -> str:
    """The Parquet codec that WITH COMPRESSION names, for new files only."""
    c = _Cursor(source)
    if not c.word("WITH", "COMPRESSION"):
        c.refuse("keyword WITH")
    t = c.need("ident", "a codec")
    if t.text.lower() not in CODECS:
        c.refuse(f"one of {', '.join(CODECS)}", at=t)
    c.need("end", "end of statement")
    return CODECS[t.text.lower()]
