"""Tokens by one master pattern."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..errors import ParseError

# The reserved words of the language. SELECT names no statement and is there to be refused.
KEYWORDS = frozenset(
    """READ FROM WHERE AS OF TRANSACTION MATCH SHAPE LIKE REQUIRE OPTIONAL WITHOUT SIMILARITY WITH COMPRESSION
    SEARCH IN FACET BY LIMIT OFFSET ASSERT RETRACT VALID TO TRAVERSE DEPTH SELECT""".split()
)

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | `(?P<quoted>[^`]*)`
      | '(?P<single>[^']*)' | "(?P<double>[^"]*)"
      | (?P<number>-?[0-9][0-9.]*)
      | (?P<word>[^\W\d][\w:-]*)
      | (?P<open>['"`])
      | (?P<punct>>=|<=|!=|==|->|.)""",
    re.VERBOSE | re.DOTALL,
)


class Token(NamedTuple):
    kind: str  # ident, keyword, number, string, punct or end
    text: str
    position: int  # bytes from the start

    def __str__(self) -> str:
        return "end of input" if self.kind == "end" else f'{self.kind} "{self.text}"'


def tokens(source: str) -> list[Token]:
    """All tokens, then one of kind end. An unterminated quote is refused where it opens."""
    out, at = [], 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "open":
            raise ParseError(at, f"an unterminated {text}", f"a closing {text}")
        if kind == "word":
            upper = text.upper()
            out.append(Token("keyword", upper, at) if upper in KEYWORDS else Token("ident", text, at))
        elif kind == "quoted":
            out.append(Token("ident", text, at))
        elif kind in ("single", "double"):
            out.append(Token("string", text, at))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at += len(m[0].encode())
    return [*out, Token("end", "", at)]
