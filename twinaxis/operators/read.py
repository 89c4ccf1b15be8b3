"""READ of one entity, of many, and of the entities that reference one.

The carried state cuts histories down before its exchange, so an entity with a
very long one stays small; all clauses are questions about whole entities and
windows over one further exchange of the carried rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compare import holds
from ..ql.nodes import Page, Predicate, Read
from .carried import carried, referrers
from .temporal import Snapshot

ROW = ["entity", "attribute", "value", "valid_from", "valid_to", "tx", "is_reference"]


WHOLE = ["tenant", "entity"]


def _any(condition: Column) -> Column:
    """Whether the condition holds for any carried row of the entity."""
    return F.coalesce(F.max(condition).over(Window.partitionBy(*WHOLE)), F.lit(False))


def _only(datoms: DataFrame, entities: DataFrame) -> DataFrame:
    """The datoms of entities (tenant, entity)."""
    return datoms.join(entities, WHOLE, "left_semi")


def read_entities(
    datoms: DataFrame,
    at: Snapshot,
    attributes: tuple[str, ...] = (),
    where: Predicate | None = None,
    without: tuple[str, ...] = (),
    members_of: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """The carried rows of every entity that passes.

    where and without judge the whole carried set, before the projection. With
    whole, an entity that lacks a projected attribute or the compared one is
    dropped altogether; else missing names are left out.

    Where nothing else is asked of the carried set, the compared attribute is
    reduced alone first, and only the entities that pass are read as a whole.
    """
    if where is not None and members_of is None and not without:
        tested = carried(datoms.where(F.col("attribute") == where.attribute), at)
        passed = tested.where(holds(F.col("value"), where)).select(*WHOLE)
        rows = _only(datoms, passed)
        if attributes and not whole:
            rows = rows.where(F.col("attribute").isin(*attributes))
        rows = carried(rows, at)
        where = None
    else:
        rows = carried(datoms, at)
    tests = []
    if members_of is not None:
        tests.append(_any(F.col("is_reference") & (F.col("value") == members_of)))
    if without:
        tests.append(~_any(F.col("attribute").isin(*without)))
    if tests:
        rows = rows.withColumns({f"__t{i}": t for i, t in enumerate(tests)})
        rows = rows.where(" and ".join(f"__t{i}" for i in range(len(tests)))).drop(*(f"__t{i}" for i in range(len(tests))))
    if where is not None:
        # Compared after the tests above, so that only candidates can refuse the comparison.
        rows = rows.withColumn("__w", _any(F.when(F.col("attribute") == where.attribute, holds(F.col("value"), where)))).where("__w").drop("__w")
    if attributes:
        rows = rows.where(F.col("attribute").isin(*attributes))
        if whole:
            n = F.count("*").over(Window.partitionBy(*WHOLE))
            rows = rows.withColumn("__n", n).where(F.col("__n") == len(set(attributes))).drop("__n")
    return rows.select(*ROW)


def page_members(rows: DataFrame, page: Page) -> DataFrame:
    """The rows of the members of a page; members are in the byte order of their names."""
    members = rows.select("entity").distinct().orderBy("entity").offset(page.offset).limit(page.limit)
    return rows.join(members, "entity", "left_semi")


def read(datoms: DataFrame, statement: Read, at: Snapshot) -> DataFrame:
    """The rows of a READ, by entity and attribute."""
    if not statement.inbound:
        one = datoms.where(F.col("entity") == statement.entity)
        return read_entities(one, at, statement.attributes, statement.where, statement.without).orderBy("attribute")
    # Candidates are proposed by any visible reference and confirmed by the carried one.
    candidates = _only(datoms, referrers(datoms, statement.entity, at))
    rows = read_entities(candidates, at, statement.attributes, statement.where, statement.without, statement.entity, whole=True)
    if statement.page is not None:
        rows = page_members(rows, statement.page)
    return rows.orderBy("entity", "attribute")
