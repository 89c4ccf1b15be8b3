"""Other ways to write a statement: calls of agents and paths of a file tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ParseError, Refused
from .ql.nodes import Leg, Read, ShapeQuery, TimeClause


class SurfaceRefusal(Refused):
    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


@dataclass(frozen=True)
class Tool:
    """A tool's arguments; as_of is always among them."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ("as_of",)


TOOLS = {
    "read_entity": Tool("read_entity", ("entity",), ("attributes", "as_of")),
    "find_resembling": Tool("find_resembling", ("subject", "metric", "threshold"), ("require", "without", "as_of")),
}
#: Words that would write; no tool may be named by them.
MUTATIONS = ("assert", "retract", "write", "insert", "update", "delete", "create", "set", "put", "remove", "erase", "purge", "shred")


def register(tool: Tool) -> None:
    if "as_of" not in tool.required + tool.optional:
        raise SurfaceRefusal("no_instant", f"{tool.name} does not declare as_of")
    if any(w in MUTATIONS for w in tool.name.lower().split("_")):
        raise SurfaceRefusal("mutation", f"{tool.name} names a mutation")
    TOOLS[tool.name] = tool


def compile_call(name: str, arguments: dict) -> Read | ShapeQuery:
    """The statement of a tool call. The tenant is the session's, never an argument."""
    tool = TOOLS.get(name)
    if tool is None:
        raise SurfaceRefusal("unknown_tool", f"there is no tool {name}")
    if "tenant" in arguments:
        raise SurfaceRefusal("tenant", "the tenant comes from the session")
    for a in tool.required:
        if a not in arguments:
            raise SurfaceRefusal("missing_argument", f"{name} needs {a}")
    for a in arguments:
        if a not in tool.required + tool.optional:
            raise SurfaceRefusal("unknown_argument", f"{name} has no argument {a}")
    when = arguments.get("as_of")
    if when is not None and (not isinstance(when, int) or isinstance(when, bool)):
        raise SurfaceRefusal("bad_argument", "as_of is a whole number")
    time = TimeClause(valid_at=when)
    if name == "find_resembling":
        legs = [Leg(a, "required") for a in arguments.get("require", ())] + [Leg(a, "excluded") for a in arguments.get("without", ())]
        return ShapeQuery(arguments["subject"], tuple(legs), arguments["metric"], ">=", float(arguments["threshold"]), time)
    return Read(arguments["entity"], attributes=tuple(arguments.get("attributes", ())), time=time)


def compile_path(path: str) -> Read:
    """/e/<entity>[/<attribute>], or /.at/<instant>/e/...; anything else is refused."""
    parts = [p for p in path.split("/") if p]
    time = TimeClause()
    if parts[:1] == [".at"]:
        if len(parts) < 2 or not parts[1].lstrip("-").isdigit():
            raise SurfaceRefusal("ENOENT", f"{path} names no instant")
        time, parts = TimeClause(valid_at=int(parts[1])), parts[2:]
    if len(parts) not in (2, 3) or parts[0] != "e":
        raise SurfaceRefusal("ENOENT" if not parts or parts[0] != "e" else "EISDIR" if len(parts) < 2 else "ENOTDIR", f"{path} names no entity or attribute")
    return Read(parts[1], attributes=tuple(parts[2:]), time=time)


def open_path(path: str, write: bool = False) -> Read:
    """The statement behind a path that is opened; the tree is read-only."""
    if write:
        raise SurfaceRefusal("EROFS", "facts are asserted, files are not written")
    return compile_path(path)


def stat(rows: DataFrame, erased: DataFrame | None = None) -> DataFrame:
    """(entity, attribute, size, mtime) of rows of a READ: bytes of the value and wall clock of its
    recording. Entities whose key was destroyed (erased: subject) are not there."""
    if erased is not None:
        rows = rows.join(erased.select(F.col("subject").alias("entity")), "entity", "left_anti")
    return rows.select("entity", "attribute", F.octet_length("value").alias("size"), F.col("tx.wall").alias("mtime"))


__all__ = ["ParseError", "SurfaceRefusal", "Tool", "compile_call", "compile_path", "open_path", "register", "stat"]
