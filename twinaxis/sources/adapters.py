"""Relational tables as datoms, from one mapping for both dialects.

Each table gives an entity, its literal attributes and its references. The same
mapping writes the Spark plan (one scan, the attributes unpivoted by an array of
structs) and the DuckDB view that results are compared with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DATOMS, FOREVER, tx_column


@dataclass(frozen=True)
class View:
    """SQL expressions that both engines understand; {us:c} is a timestamp column in microseconds."""

    entity: str
    literals: dict[str, str]
    references: dict[str, str]
    wall: str
    valid_from: str = "0"
    seq: str = "0"  # added to ten times the row's own sequence
    asserted: str = "true"


VIEWS = {
    "region": View("'region:' || r_regionkey", {"r_name": "r_name"}, {}, "r_regionkey"),
    "nation": View("'nation:' || n_nationkey", {"n_name": "n_name"}, {"n_region": "'region:' || n_regionkey"}, "n_nationkey"),
    "customer": View(
        "'customer:' || c_custkey",
        {"c_name": "c_name", "c_segment": "c_mktsegment", "c_acctbal": "cast(cast(c_acctbal as decimal(18,2)) as {str})"},
        {"c_nation": "'nation:' || c_nationkey"},
        "c_custkey",
    ),
    "supplier": View(
        "'supplier:' || s_suppkey",
        {"s_name": "s_name", "s_acctbal": "cast(cast(s_acctbal as decimal(18,2)) as {str})"},
        {"s_nation": "'nation:' || s_nationkey"},
        "s_suppkey",
    ),
    "part": View("'part:' || p_partkey", {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "cast(p_size as {str})"}, {}, "p_partkey"),
    "orders": View(
        "'order:' || o_orderkey",
        {"o_status": "o_orderstatus", "o_priority": "o_orderpriority", "o_total": "cast(cast(o_totalprice as decimal(18,2)) as {str})"},
        {"o_customer": "'customer:' || o_custkey"},
        "o_orderkey",
        "{us:o_orderdate}",
    ),
    "lineitem": View(
        "'line:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey",
        {"l_flag": "l_returnflag", "l_status": "l_linestatus", "l_quantity": "cast(cast(l_quantity as decimal(18,2)) as {str})", "l_discount": "cast(cast(l_discount as decimal(18,2)) as {str})"},
        {"l_order": "'order:' || l_orderkey", "l_part": "'part:' || l_partkey", "l_supplier": "'supplier:' || l_suppkey"},
        "l_orderkey",
        "{us:l_shipdate}",
        "l_linenumber",
    ),
    "events": View(
        "'user:' || user_id",
        {"event_type": "event_type", "value": "cast(cast(value as decimal(18,2)) as {str})"},
        {},
        "event_id",
        "{us:ts}",
        asserted="event_type <> 'error'",
    ),
    "documents": View("'doc:' || doc_id", {"text": "text", "lang": "lang", "source": "source"}, {}, "doc_id"),
    "labels": View("'doc:' || doc_id", {"quality": "cast(quality as {str})", "toxic": "cast(toxic as {str})"}, {}, "doc_id", seq="1"),
    "conversations": View("'turn:' || conv_id || '-' || turn", {"role": "role", "text": "text"}, {"conv": "'conv:' || conv_id"}, "conv_id", seq="turn"),
    "benchmark": View("'item:' || item_id", {"text": "text"}, {}, "item_id"),
    "pages": View("'page:' || page_id", {"url": "url", "html": "html"}, {}, "page_id"),
}


def _text(expr: str, duckdb: bool) -> str:
    out = expr.replace("{str}", "varchar" if duckdb else "string")
    while "{us:" in out:
        a = out.index("{us:")
        b = out.index("}", a)
        c = out[a + 4 : b]
        out = out[:a] + (f"epoch_us({c})" if duckdb else f"unix_micros(cast({c} as timestamp))") + out[b + 1 :]
    return out


def _attributes(view: View) -> list[tuple[str, str, bool]]:
    return [(a, x, False) for a, x in view.literals.items()] + [(a, x, True) for a, x in view.references.items()]


def datoms(spark: SparkSession, sf_dir: str, *tables: str, attributes: tuple[str, ...] = (), tenant: int = 1) -> DataFrame:
    """The datoms of tables, only of some attributes if named; no columns are read but those they need."""
    out = None
    for table in tables:
        view = VIEWS[table]
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        own = [(i, a, x, ref) for i, (a, x, ref) in enumerate(_attributes(view), 1) if not attributes or a in attributes]
        if not own:
            continue
        facts = F.array(*[F.struct(F.lit(a).alias("attribute"), F.expr(_text(x, False)).alias("value"), F.lit(ref).alias("is_reference"), F.lit(i).alias("i")) for i, a, x, ref in own])
        base = rows.select(
            F.expr(_text(view.entity, False)).alias("entity"),
            F.expr(view.wall).cast("long").alias("wall"),
            (F.expr(view.seq) * 10).cast("long").alias("seq"),
            F.expr(_text(view.valid_from, False)).cast("long").alias("valid_from"),
            F.expr(view.asserted).alias("assert"),
            F.explode(facts).alias("f"),
        )
        part = base.select(
            F.lit(tenant).alias("tenant"),
            "entity",
            "f.attribute",
            "f.value",
            "f.is_reference",
            "valid_from",
            F.lit(FOREVER).alias("valid_to"),
            "assert",
            tx_column(F.col("wall"), F.col("seq") + F.col("f.i")).alias("tx"),
            F.lit(0).cast("long").alias("ord"),
        ).where("value is not null")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], DATOMS)


def duckdb_datoms(*tables: str, attributes: tuple[str, ...] = ()) -> str:
    """The same datoms as a query for DuckDB: entity, attribute, value, is_reference, valid_from, valid_to, asserted, wall, seq."""
    parts = []
    for table in tables:
        view = VIEWS[table]
        for i, (a, x, ref) in enumerate(_attributes(view), 1):
            if attributes and a not in attributes:
                continue
            parts.append(
                f"select {_text(view.entity, True)} as entity, '{a}' as attribute, {_text(x, True)} as value, {str(ref).lower()} as is_reference, "
                f"cast({_text(view.valid_from, True)} as bigint) as valid_from, {FOREVER} as valid_to, {view.asserted} as asserted, "
                f"cast({view.wall} as bigint) as wall, cast(({view.seq}) * 10 + {i} as bigint) as seq from {table} where ({_text(x, True)}) is not null"
            )
    return " union all ".join(parts)
