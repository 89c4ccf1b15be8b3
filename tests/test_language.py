"""The statement language: trees, refusals and their positions."""

import pytest

from twinaxis import errors as e
from twinaxis.ql import Leg, Page, Predicate, Read, Search, ShapeQuery, TimeClause, Traverse, Write, parse, parse_policy


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("READ * FROM planet-7", Read("planet-7")),
        ("read mass, radius from planet-7 where mass>-40 without moon as of 5 transaction 9", Read("planet-7", False, ("mass", "radius"), Predicate("mass", ">", "-40", True), ("moon",), None, TimeClause(5, 9))),
        ("READ `limit` FROM `in` WHERE `select` = 'yes'", Read("in", False, ("limit",), Predicate("select", "=", "yes"))),
        ("READ ->name FROM [staff] WHERE ->lastname == a WITHOUT ->left LIMIT 3 OFFSET 1", Read("staff", True, ("name",), Predicate("lastname", "==", "a"), ("left",), Page(3, 1))),
        ("READ * FROM [staff] LIMIT 0", Read("staff", True, page=Page(0))),
        ("SEARCH 'red star' IN name, note FACET BY class LIMIT 5", Search("red star", ("name", "note"), 5, ("class",))),
        ("TRAVERSE a:1 DEPTH 2 AS OF 7", Traverse("a:1", 2, TimeClause(7))),
        ("MATCH SHAPE LIKE p REQUIRE a AS OF 1, b OPTIONAL c WITHOUT d SIMILARITY jaccard > 0.5", ShapeQuery("p", (Leg("a", "required", TimeClause(1)), Leg("b", "required"), Leg("c", "optional"), Leg("d", "excluded")), "jaccard", ">", 0.5)),
        ("ASSERT p mass = 5972 VALID FROM 100 TO 200", Write("p", "mass", "5972", numeric=True, valid_from=100, valid_to=200)),
        ("RETRACT p orbits = ->star-1", Write("p", "orbits", "star-1", True, True)),
        ('READ * FROM p WHERE a = "it\'s"', Read("p", where=Predicate("a", "=", "it's"))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize(
    ("text", "error", "position"),
    [
        ("SELECT * FROM p", e.SelectRenamed, 0),
        ("READ name FROM [staff]", e.JoinNotSupported, 5),
        ("READ ->name FROM staff", e.JoinNotSupported, 5),
        ("READ ->n FROM [s] WHERE lastname = 1", e.JoinNotSupported, 24),
        ("READ * FROM p LIMIT 3", e.ParseError, 14),
        ("READ * FROM [p] OFFSET 3", e.ParseError, 16),
        ("READ * FROM [p] LIMIT -1", e.ParseError, 22),
        ("READ * FROM p TRANSACTION 1 AS OF 2", e.ParseError, 28),
        ("READ * FROM p AS OF 1.5", e.ParseError, 20),
        ("READ * FROM p WHERE é ~ 1", e.ParseError, 23),
        ("READ * FROM p WHERE a = 'open", e.ParseError, 24),
        ("READ * FROM ``", e.ParseError, 12),
        ("SEARCH 'x' IN a", e.NoSearchLimit, 15),
        ("SEARCH 'x' IN a LIMIT 0", e.NoSearchLimit, 22),
        ("TRAVERSE a", e.NoDepth, 10),
        ("TRAVERSE a DEPTH 0", e.NoDepth, 17),
        ("MATCH SHAPE LIKE p REQUIRE a", e.NoThreshold, 28),
        ("ASSERT p a = 1 TRANSACTION 5", e.TransactionTimeNotYours, 15),
        ("DROP p", e.ParseError, 0),
        ("", e.ParseError, 0),
    ],
)
def test_refusals(text, error, position):
    with pytest.raises(error) as x:
        parse(text)
    assert x.value.position == position
    assert str(x.value).startswith(f"ql: at byte {position}: found ")


def test_policy():
    assert parse_policy("WITH COMPRESSION none") == "uncompressed"
    assert parse_policy("with compression zstd") == "zstd"
    with pytest.raises(e.ParseError):
        parse_policy("WITH COMPRESSION lzma")
