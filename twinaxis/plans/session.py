"""Statements run against datoms: parse, resolve the instant once, compile to a DataFrame."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..clock import Clock, Minter
from ..erase import erased_subjects
from ..errors import CrossEntity, NoEntity, Refused
from ..model import DATOMS, FOREVER, TxId
from ..operators import access
from ..operators.carried import deduplicate, tenant_rows
from ..operators.read import read
from ..operators.search import Facet, facet_of, facet_values, search
from ..operators.shape import match_shape
from ..operators.temporal import resolve
from ..operators.traverse import traverse
from ..ql import Read, Search, ShapeQuery, Traverse, Write, parse, parse_policy
from ..scratch import read_text, write_text
from ..sources.postings import SearchIndex
from ..sources.store import LeafStore, Policy


def compile_statement(
    spark: SparkSession, datoms: DataFrame, statement, now: int, honour: bool = True, erased: DataFrame | None = None, metrics=None, tenant: int = 1, index=None
) -> DataFrame:
    """The DataFrame of a tenant's query. Without honour, SEARCH looks at all attributes and all
    history, whatever its IN and time clauses say. Datoms of other tenants are never seen; an
    index (sources/postings.py) must be of this tenant's datoms."""
    datoms = tenant_rows(datoms, tenant)
    if isinstance(statement, Read):
        return read(datoms, statement, resolve(statement.time, now))
    if isinstance(statement, Traverse):
        return traverse(spark, datoms, statement.root, statement.depth, resolve(statement.time, now))
    if isinstance(statement, Search):
        at = resolve(statement.time, now)
        # All history counts each record once; what is carried is one record anyhow.
        rows = datoms if honour or index is not None else deduplicate(datoms)
        return search(rows, statement.query, statement.limit, statement.attributes, at if honour else None, erased, index)
    if isinstance(statement, ShapeQuery):
        return match_shape(datoms, statement, now, metrics)
    raise TypeError(f"{type(statement).__name__} is no query")


class SearchResult:
    """The hits of a SEARCH, which answer like a DataFrame, and the facets it asked for."""

    def __init__(self, hits: DataFrame, facets: dict[str, Facet]):
        self.hits, self.facets = hits, facets

    def __getattr__(self, name: str):
        return getattr(self.hits, name)

    def show(self, *args, **more) -> None:
        self.hits.show(*args, **more)
        for name, f in self.facets.items():
            print(f"{name}: {f.total} matched")
            f.values.show(*args, **more)


class Session:
    """One writer's session of one tenant over a store, or over memory if path is None.

    keys (a keystore) takes subjects whose key was destroyed out of hits and
    facets. A policy seals and compacts the store after writes.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        now: Callable[[], int] = time.time_ns,
        tenant: int = 1,
        honour: bool = True,
        metrics=None,
        keys=None,
        policy: Policy | None = None,
    ):
        self.spark, self.now, self.tenant, self.honour, self.metrics = spark, now, tenant, honour, metrics
        self.keys, self.policy = keys, policy
        self.store = LeafStore(spark, path) if path else None
        self.memory: list[tuple] = []
        self.minter = Minter(Clock(now))
        if self.store and (last := self.store.last()):
            # One aggregate in place of a look at every stored id.
            self.minter.observe(last)

    def datoms(self) -> DataFrame:
        """All records of the tenant; one that came twice may be there twice, which no carried state shows."""
        return tenant_rows(self.store.raw() if self.store else self.spark.createDataFrame(self.memory, DATOMS), self.tenant)

    def erased(self) -> DataFrame | None:
        """(subject): whose keys were all destroyed."""
        return None if self.keys is None else erased_subjects(self.keys.table())

    def configure(self, text: str) -> None:
        """WITH COMPRESSION: the codec of segments written from now on."""
        codec = parse_policy(text)
        if self.store:
            self.store.compression = codec

    def reindex(self) -> None:
        """Stores a search index of the tenant's sealed records; searches use it until another segment comes."""
        path = f"{self.store.path}/index-{uuid.uuid4().hex}"
        segments = self.store.segments()
        SearchIndex.build(self.spark, deduplicate(self.datoms()), path)
        write_text(self.spark, f"{self.store.path}/index-{self.tenant}.json", json.dumps({"path": path, "segments": segments, "layout": SearchIndex.LAYOUT}))

    def index(self) -> SearchIndex | None:
        """The stored index, if it has all records."""
        if not self.store or self.store.tail:
            return None
        text = read_text(self.spark, f"{self.store.path}/index-{self.tenant}.json")
        held = json.loads(text) if text else {"segments": None}
        fresh = held["segments"] == self.store.segments() and held.get("layout") == SearchIndex.LAYOUT
        return SearchIndex(self.spark, held["path"]) if fresh else None

    def run(self, text: str) -> DataFrame | SearchResult | None:
        """The rows of a query, with the facets of a SEARCH that asks for them, or None after a write or setting."""
        if text.split()[:1] == ["WITH"]:
            self.configure(text)
            return None
        statement = parse(text)
        if isinstance(statement, Write):
            self.write([statement])
            return None
        now = self.now()
        index = self.index() if isinstance(statement, Search) else None
        hits = compile_statement(self.spark, self.datoms(), statement, now, self.honour, self.erased(), self.metrics, self.tenant, index)
        if not isinstance(statement, Search) or not statement.facets:
            return hits
        return SearchResult(hits, {a: facet_of(hits, facet_values(self.datoms(), a), statement.limit) for a in statement.facets})

    def facets(self, text: str) -> dict[str, DataFrame]:
        """For each FACET BY attribute of a SEARCH, (value, count) over its hits after LIMIT."""
        out = self.run(text)
        return {a: f.values for a, f in out.facets.items()} if isinstance(out, SearchResult) else {}

    def write(self, statements: list[Write]) -> TxId:
        """Records writes about one entity under one transaction id."""
        tx = self.minter.mint()
        rows = []
        for w in statements:
            start = tx.wall if w.valid_from is None else w.valid_from
            end = FOREVER if w.valid_to is None else w.valid_to
            rows.append((self.tenant, w.entity, w.attribute, w.value, w.reference, start, end, not w.retract, tx.row(), len(self.memory) + len(rows)))
        if self.store:
            self.store.append(rows)
            if self.policy and self.policy.should_seal(*self.store.exposed(), tx.wall):
                self.store.seal()
                if self.policy.should_compact(len(self.store.segments())):
                    self.store.compact()
        else:
            self.memory += rows
        return tx

    def close(self) -> None:
        if self.store:
            self.store.seal()

    def authorized(self, grants: DataFrame, principal: str, text: str, grants_now: int) -> DataFrame | None:
        """run() if the principal's present grants permit; the statement's own instants do not matter."""
        action = "write" if isinstance(parse(text), Write) else "read"
        access.allow(grants, principal, self.tenant, action, grants_now)
        return self.run(text)


class Transaction:
    """Writes about one entity that are recorded together."""

    def __init__(self, entity: str):
        if not entity:
            raise NoEntity("a transaction needs an entity")
        self.entity, self.writes = entity, []

    def _add(self, entity: str, attribute: str, value: str, retract: bool, **more) -> None:
        if entity != self.entity:
            raise CrossEntity(f"a transaction about {self.entity} cannot write {entity}")
        self.writes.append(Write(entity, attribute, value, retract, **more))

    def assert_(self, entity: str, attribute: str, value: str, **more) -> None:
        self._add(entity, attribute, value, False, **more)

    def retract(self, entity: str, attribute: str, value: str = "", **more) -> None:
        self._add(entity, attribute, value, True, **more)

    def commit(self, session: Session) -> TxId:
        return session.write(self.writes)


__all__ = ["Refused", "SearchResult", "Session", "Transaction", "compile_statement", "tenant_rows"]
