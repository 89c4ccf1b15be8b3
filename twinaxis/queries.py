"""The registered queries over the driver's tables and their SQL for DuckDB.

Single statements go through the language; the set-based forms apply the same
rule to every entity of a table at once, which is what a benchmark can measure.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import entity_key, leaf_name
from .functions.text import analyze
from .model import FOREVER, tx_column
from .operators import access, carried, commitment, placement, read, search, shape, temporal, traverse
from .operators.temporal import Snapshot
from .plans.session import Session, compile_statement
from .ql import Leg, Predicate, TimeClause, parse
from .scratch import Scratch
from .sources.adapters import datoms, duckdb_datoms
from .sources.postings import SearchIndex

NOW = 4_000_000_000_000_000_000
#: Instants inside the range of the tables, in microseconds.
MID_EVENTS, MID_ORDERS = 1_705_300_000_000_000, 900_000_000_000_000
LATE = Snapshot(NOW)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql is not None:
        _ORACLES[name] = sql


# DuckDB building blocks.


def _carried_sql(source: str, valid_at: int = NOW, wall: int | None = None) -> str:
    bound = "" if wall is None else f" and wall < {wall}"
    return (
        f"select entity, attribute, value, is_reference, valid_from, wall from (select *, row_number() over (partition by entity, attribute order by wall desc, seq desc) as rk "
        f"from ({source}) where valid_from <= {valid_at} and valid_to > {valid_at}{bound}) where rk = 1 and asserted"
    )


def _with(source: str, body: str, valid_at: int = NOW, wall: int | None = None) -> str:
    return f"with d as ({source}), c as ({_carried_sql('select * from d', valid_at, wall)}) {body}"


ALL = "select entity, attribute, value, is_reference, valid_from, wall from c"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("entity", "attribute", "value", "is_reference", "valid_from", F.col("tx.wall").alias("wall"))


def _statement(text: str, *tables: str, attributes: tuple[str, ...] = (), rows: bool = True):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = compile_statement(spark, datoms(spark, sf_dir, *tables, attributes=attributes), parse(text), NOW)
        return _rows(out) if rows else out

    return run


# READ of one entity.

_CUSTOMER = duckdb_datoms("customer")
_EVENTS = duckdb_datoms("events")
_USER = "user:7"

_register("read_entity", _statement("READ * FROM customer:7", "customer"), _with(_CUSTOMER, ALL + " where entity = 'customer:7'"))
_register("read_projection", _statement("READ c_name, c_segment, absent FROM customer:7", "customer"), _with(_CUSTOMER, ALL + " where entity = 'customer:7' and attribute in ('c_name', 'c_segment')"))
_register("read_asof", _statement(f"READ * FROM {_USER} AS OF {MID_EVENTS}", "events"), _with(_EVENTS, f"{ALL} where entity = '{_USER}'", MID_EVENTS))
_register("read_transaction", _statement(f"READ * FROM {_USER} TRANSACTION 600", "events"), _with(_EVENTS, f"{ALL} where entity = '{_USER}'", NOW, 600))
_register("read_bitemporal", _statement(f"READ * FROM {_USER} AS OF {MID_EVENTS} TRANSACTION 400", "events"), _with(_EVENTS, f"{ALL} where entity = '{_USER}'", MID_EVENTS, 400))

# Two tenants that know the same entities: events with an odd id are the second one's.


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datoms(spark, sf_dir, "events").withColumn("tenant", (1 + F.col("tx.wall") % 2).cast("int"))


def _second(text: str):
    return lambda spark, sf_dir: _rows(compile_statement(spark, _tenants(spark, sf_dir), parse(text), NOW, tenant=2))


_register(
    "tenants_carried",
    lambda s, d: carried.carried(_tenants(s, d), LATE).select("tenant", "entity", "attribute", "value", F.col("tx.wall").alias("wall")),
    "select tenant, entity, attribute, value, wall from (select *, cast(1 + wall % 2 as integer) as tenant, row_number() over (partition by wall % 2, entity, attribute order by wall desc, seq desc) as rk "
    f"from ({_EVENTS}) where valid_from <= {NOW}) where rk = 1 and asserted",
)
_register("tenants_read", _second(f"READ * FROM {_USER}"), _with(f"select * from ({_EVENTS}) where wall % 2 = 1", f"{ALL} where entity = '{_USER}'"))
_register(
    "tenants_where",
    lambda s, d: read.read_entities(_tenants(s, d), LATE, (), Predicate("event_type", "=", "purchase")).groupBy("entity").agg(F.count("*").alias("facts")),
    f"with c as (select *, wall % 2 as t from (select *, row_number() over (partition by wall % 2, entity, attribute order by wall desc, seq desc) as rk from ({_EVENTS}) where valid_from <= {NOW}) where rk = 1 and asserted) "
    "select entity, count(*) as facts from c where (t, entity) in (select (t, entity) from c where attribute = 'event_type' and value = 'purchase') group by entity",
)

# Predicates over all entities of a table.

_ORDERS = duckdb_datoms("orders")


def _where(predicate: Predicate | None, without: tuple[str, ...] = (), attributes: tuple[str, ...] = (), tables: tuple[str, ...] = ("orders",), at: Snapshot = LATE):
    return lambda spark, sf_dir: _rows(read.read_entities(datoms(spark, sf_dir, *tables), at, attributes, predicate, without))


def _exists(attribute: str, test: str) -> str:
    return f"entity in (select entity from c where attribute = '{attribute}' and {test})"


for _name, _op in {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    _register(
        f"read_where_{_name}_num",
        _where(Predicate("o_total", _op, "204551.76", True)),
        _with(_ORDERS, f"{ALL} where {_exists('o_total', f'cast(value as double) {_op} 204551.76')}"),
    )
_register("read_where_text", _where(Predicate("o_priority", ">=", "3")), _with(_ORDERS, f"{ALL} where {_exists('o_priority', "value >= '3'")}"))
_register(
    "read_where_unprojected",
    _where(Predicate("o_status", "=", "F"), attributes=("o_total", "o_customer")),
    _with(_ORDERS, f"{ALL} where {_exists('o_status', "value = 'F'")} and attribute in ('o_total', 'o_customer')"),
)
_DOCS = duckdb_datoms("documents", "labels", attributes=("lang", "source", "quality", "toxic"))
_LACKS = "entity not in (select entity from c where attribute in ('quality'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datoms(spark, sf_dir, "documents", "labels", attributes=("lang", "source", "quality", "toxic"))


_register("read_without", lambda s, d: _rows(read.read_entities(_docs(s, d), LATE, without=("quality",))), _with(_DOCS, f"{ALL} where {_LACKS}"))
_register(
    "read_where_without",
    lambda s, d: _rows(read.read_entities(_docs(s, d), LATE, (), Predicate("lang", "=", "fr"), ("quality",))),
    _with(_DOCS, f"{ALL} where {_LACKS} and {_exists('lang', "value = 'fr'")}"),
)

# Carried state, history, shapes.

_register("read_retracted", lambda s, d: _rows(carried.carried(datoms(s, d, "events"), Snapshot(MID_EVENTS))), _with(_EVENTS, ALL, MID_EVENTS))
_register("carried_all", lambda s, d: _rows(carried.carried(datoms(s, d, "orders", "customer"), Snapshot(MID_ORDERS))), _with(duckdb_datoms("orders", "customer"), ALL, MID_ORDERS))
_register(
    "carried_lines",
    lambda s, d: carried.carried(datoms(s, d, "lineitem", attributes=("l_order",)), Snapshot(MID_ORDERS)).groupBy("value").agg(F.count("*").alias("lines")),
    _with(duckdb_datoms("lineitem", attributes=("l_order",)), "select value, count(*) as lines from c group by value", MID_ORDERS),
)
_register(
    "history",
    lambda s, d: carried.history(datoms(s, d, "events"), _USER).select("entity", "attribute", "value", "valid_from", "assert", F.col("tx.wall").alias("wall"), F.col("tx.seq").alias("seq")),
    f"select distinct entity, attribute, value, valid_from, asserted as assert, wall, seq from ({_EVENTS}) where entity = '{_USER}'",
)
_register(
    "shape_attributes",
    lambda s, d: carried.shape_of(_docs(s, d), LATE).select("entity", F.array_join("attributes", ",").alias("attributes")),
    _with(_DOCS, "select entity, string_agg(attribute, ',' order by attribute) as attributes from c group by entity"),
)
_register("entities", lambda s, d: carried.entities(datoms(s, d, "events", "nation")), f"select distinct entity from ({duckdb_datoms('events', 'nation')})")
_register(
    "referrers",
    lambda s, d: carried.referrers(datoms(s, d, "customer", "supplier"), "nation:7", LATE).select("entity"),
    f"select distinct entity from ({duckdb_datoms('customer', 'supplier')}) where is_reference and value = 'nation:7'",
)

# Inbound READ.

_IN = duckdb_datoms("customer", "supplier")
_MEMBER = "entity in (select entity from c where is_reference and value = 'nation:7')"


def _has(*attributes: str) -> str:
    return " and ".join(f"entity in (select entity from c where attribute = '{a}')" for a in attributes)


def _inbound(text: str):
    return _statement(text, "customer", "supplier")


_register("inbound_star", _inbound("READ * FROM [nation:7]"), _with(_IN, f"{ALL} where {_MEMBER}"))
_register(
    "inbound_where",
    _inbound("READ ->c_name, ->c_acctbal FROM [nation:7] WHERE ->c_acctbal > 1000"),
    _with(_IN, f"{ALL} where {_MEMBER} and {_has('c_name', 'c_acctbal')} and {_exists('c_acctbal', 'cast(value as double) > 1000')} and attribute in ('c_name', 'c_acctbal')"),
)
_register("inbound_without", _inbound("READ * FROM [nation:7] WITHOUT ->c_segment"), _with(_IN, f"{ALL} where {_MEMBER} and entity not in (select entity from c where attribute = 'c_segment')"))
_PAGE = f"entity in (select distinct entity from c where {_MEMBER} and {_has('c_name')} and {_exists('c_segment', "value = 'BUILDING'")} order by entity limit 3 offset 1)"
_register("inbound_page", _inbound("READ ->c_name FROM [nation:7] WHERE ->c_segment = BUILDING LIMIT 3 OFFSET 1"), _with(_IN, f"{ALL} where {_PAGE} and attribute = 'c_name'"))
_register("inbound_drop_rule", _inbound("READ ->s_name, ->s_acctbal FROM [nation:7]"), _with(_IN, f"{ALL} where {_MEMBER} and {_has('s_name', 's_acctbal')} and attribute in ('s_name', 's_acctbal')"))
_register(
    "inbound_asof",
    _statement(f"READ ->o_status, ->o_total FROM [customer:7] AS OF {MID_ORDERS}", "orders"),
    _with(_ORDERS, f"{ALL} where entity in (select entity from c where is_reference and value = 'customer:7') and attribute in ('o_status', 'o_total')", MID_ORDERS),
)

# Traversal: order -> customer -> nation -> region.

_GRAPH = ("orders", "customer", "nation", "region")
_REFS = ("o_customer", "c_nation", "n_region")
_EDGES = duckdb_datoms(*_GRAPH, attributes=_REFS)


def _walk(depth: int, at: Snapshot = LATE):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = datoms(spark, sf_dir, *_GRAPH, attributes=_REFS)
        roots = datoms(spark, sf_dir, "orders", attributes=("o_customer",)).select("entity")
        return traverse.walk(spark, traverse.edges(d, at), roots, depth, strict=False).select("root", "depth", "entity")

    return run


def _walk_sql(depth: int, valid_at: int = NOW) -> str:
    return (
        f"with recursive d as ({_EDGES}), c as ({_carried_sql('select * from d', valid_at)}), w(root, depth, entity) as ("
        f"select distinct entity, 0, entity from ({duckdb_datoms('orders', attributes=('o_customer',))}) "
        f"union all select w.root, w.depth + 1, c.value from w join c on c.entity = w.entity where c.is_reference and w.depth < {depth}) "
        "select root, depth, entity from w where depth > 0"
    )


for _n in (1, 2, 3, 6):
    _register(f"traverse_d{_n}", _walk(_n), _walk_sql(_n))
_register("traverse_asof", _walk(3, Snapshot(MID_ORDERS)), _walk_sql(3, MID_ORDERS))
_register(
    "traverse_statement",
    _statement("TRAVERSE order:7 DEPTH 3", *_GRAPH, rows=False),
    _walk_sql(3).replace("select root, depth, entity from w where depth > 0", "select depth, entity from w where depth > 0 and root = 'order:7'"),
)


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a ring: a strict walk that goes once around is refused, a shorter one is not."""
    from .errors import CycleFound

    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"))
    size = n.count()
    name = lambda c: F.concat(F.lit("nation:"), c.cast("string"))
    ring = n.select(name(F.col("k")).alias("src"), F.lit("next").alias("attribute"), name((F.col("k") + 1) % size).alias("dst"))
    start = ring.select(F.col("src").alias("entity")).where("entity = 'nation:0'")
    out = []
    for depth in (2, 4):
        try:
            out.append((depth, False, traverse.walk(spark, ring, start, depth).count()))
        except CycleFound:
            out.append((depth, True, 0))
    # One nation with an edge back to the start closes the ring after three steps.
    short = ring.where("src in ('nation:0', 'nation:1')").union(spark.createDataFrame([("nation:2", "next", "nation:0")], ring.schema))
    try:
        out.append((3, False, traverse.walk(spark, short, start, 3).count()))
    except CycleFound:
        out.append((3, True, 0))
    return spark.createDataFrame(out, "depth int, refused boolean, reached long")


_register(
    "traverse_cycle_refused",
    _cycle,
    "select cast(depth as integer) as depth, refused, cast(case when refused then 0 else least(depth, (select count(*) - 1 from nation)) end as bigint) as reached from (values (2, false), (4, false), (3, true)) t(depth, refused)",
)

# Search.

_TEXT = "select doc_id, text from documents"
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datoms(spark, sf_dir, "documents", attributes=("text",))


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of all texts, built by the first search of an application and stored in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(spark, _documents(spark, sf_dir), Scratch(spark, "search").path)
    return _INDEXES[key]


def _found(query: str, limit: int):
    return lambda s, d: _ranked(search.rank_indexed(_index(s, d), query, limit))


def _rank_sql(terms: list[str], limit: int, erased: str = "false") -> str:
    sums = " + ".join(
        f"case when n{i} > 0 then n{i} * ln(1 + (select sum(n) from s) / (select sum(n{i}) from s where not erased)) else 0 end" for i in range(len(terms))
    )
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as n{i}" for i, w in enumerate(terms))
    some = " or ".join(f"n{i} > 0" for i in range(len(terms)))
    return (
        f"with t as (select 'doc:' || doc_id as subject, {_TOKENS} as t from documents), s as (select subject, {erased} as erased, len(t) as n, {counts} from t) "
        f"select subject, round({sums}, 6) as score from s where ({some}) and not erased order by {sums} desc, subject limit {limit}"
    )


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("subject", F.round("score", 6).alias("score"))


_register(
    "analyze_terms",
    lambda s, d: _documents(s, d).select("entity", F.size(analyze(F.col("value"))).cast("long").alias("n_terms")),
    f"select 'doc:' || doc_id as entity, cast(len({_TOKENS}) as bigint) as n_terms from documents",
)
_register("search_rank", lambda s, d: _found("region", 50)(s, d).union(_found("the", 50)(s, d)), f"({_rank_sql(['region'], 50)}) union all ({_rank_sql(['the'], 50)})")
_register("search_unindexed", lambda s, d: _ranked(search.rank(_documents(s, d), "region la", 50)), _rank_sql(["region", "la"], 50))
_register(
    "search_multi_term",
    lambda s, d: _ranked(compile_statement(s, _documents(s, d), parse("SEARCH 'The, and THE la' IN text LIMIT 100"), NOW, index=_index(s, d))),
    _rank_sql(["the", "and", "la"], 100),
)
_register("search_limit", _found("the", 5), _rank_sql(["the"], 5))
_register(
    "search_compat",
    lambda s, d: _ranked(compile_statement(s, _documents(s, d), parse("SEARCH 'der' IN lang LIMIT 20"), NOW, honour=False, index=_index(s, d))),
    _rank_sql(["der"], 20),
)
_register(
    "search_facet",
    lambda s, d: search.facet(search.rank_indexed(_index(s, d), "the", 100), search.facet_values(datoms(s, d, "documents", attributes=("source",)), "source"), 100),
    f"with h as ({_rank_sql(['the'], 100)}) select source as value, count(*) as count from h join documents on subject = 'doc:' || doc_id group by source",
)


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all history, of which the texts of every third document were withdrawn later."""
    d = _documents(spark, sf_dir)
    gone = d.where("tx.wall % 3 = 0").withColumn("assert", F.lit(False)).withColumn("tx", tx_column(F.col("tx.wall") + 1, F.lit(1)))
    return _ranked(search.confirm(search.rank_indexed(_index(spark, sf_dir), "der", 40), d.unionByName(gone), "der", LATE))


_register("search_confirm", _confirmed, f"select * from ({_rank_sql(['der'], 40)}) where cast(substr(subject, 5) as bigint) % 3 <> 0")
_register(
    "search_shredded",
    lambda s, d: _ranked(search.rank_indexed(_index(s, d), "the", 50, _documents(s, d).where("tx.wall % 3 = 0").select(F.col("entity").alias("subject")))),
    _rank_sql(["the"], 50, "cast(substr(subject, 5) as bigint) % 3 = 0"),
)
_register(
    "search_postings",
    lambda s, d: search.postings(datoms(s, d, "benchmark")).groupBy("subject", "term").agg(F.count("*").alias("n")),
    f"select subject, term, count(*) as n from (select 'item:' || item_id as subject, unnest({_TOKENS}) as term from benchmark) group by subject, term",
)

# Shapes.


def _legs(*legs: Leg, at: Snapshot = LATE):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape.build_rows(_docs(spark, sf_dir), legs, NOW, at)

    return run


def _leg(i: int, attribute: str) -> str:
    return f"max(case when attribute = '{attribute}' then value end) as leg{i}"


_register("shape_require", _legs(Leg("lang", "required"), Leg("quality", "required")), _with(_DOCS, f"select entity, {_leg(0, 'lang')}, {_leg(1, 'quality')} from c group by entity having leg0 is not null and leg1 is not null"))
_register("shape_optional", _legs(Leg("lang", "required"), Leg("toxic", "optional")), _with(_DOCS, f"select entity, {_leg(0, 'lang')}, {_leg(1, 'toxic')} from c group by entity having leg0 is not null"))
_register("shape_without", _legs(Leg("lang", "required"), Leg("toxic", "excluded")), _with(_DOCS, f"select entity, {_leg(0, 'lang')} from c group by entity having leg0 is not null and max(case when attribute = 'toxic' then value end) is null"))


def _leg_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = (Leg("event_type", "required"), Leg("event_type", "optional", TimeClause(valid_at=MID_EVENTS)))
    return shape.build_rows(datoms(spark, sf_dir, "events"), legs, NOW, LATE)


_register(
    "shape_leg_time",
    _leg_time,
    f"with d as ({_EVENTS}), c as ({_carried_sql('select * from d')}), e as ({_carried_sql('select * from d', MID_EVENTS)}) "
    "select c.entity, c.value as leg0, e.value as leg1 from c left join e on e.entity = c.entity and e.attribute = 'event_type' where c.attribute = 'event_type'",
)


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH SHAPE LIKE doc:1 REQUIRE lang SIMILARITY jaccard >= 0.6"
    out = compile_statement(spark, _docs(spark, sf_dir), parse(text), NOW, metrics={"jaccard": shape.jaccard})
    return out.select("entity", "leg0", F.round("similarity", 6).alias("similarity"))


_register(
    "shape_jaccard",
    _jaccard,
    _with(
        _DOCS,
        "select entity, leg0, round(similarity, 6) as similarity from (select entity, max(case when attribute = 'lang' then value end) as leg0, "
        "count(*) filter (where attribute in (select attribute from c where entity = 'doc:1')) * 1.0 / (count(*) + (select count(*) from c where entity = 'doc:1') "
        "- count(*) filter (where attribute in (select attribute from c where entity = 'doc:1'))) as similarity from c where entity <> 'doc:1' group by entity) where leg0 is not null and similarity >= 0.6",
    ),
)

# Storage.


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = datoms(spark, sf_dir, "events")
    return _rows(carried.deduplicate(d.unionByName(d)))


_register("dedup_merge", _twice, f"select distinct entity, attribute, value, is_reference, valid_from, wall from ({_EVENTS})")


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.store import LeafStore

    store = LeafStore(spark, _scratch(spark, "leaf"))
    d = datoms(spark, sf_dir, "events")
    store.write(d.where("tx.wall < 500"))
    store.write(d.where("tx.wall >= 400"))
    store.compact()
    return _rows(carried.carried(store.datoms(), LATE))


def _scratch(spark: SparkSession, name: str) -> str:
    """A path that is not there yet, in a folder of the query's own."""
    return f"{Scratch(spark, name).path}/{name}"


_register("compact_invariance", _compacted, _with(_EVENTS, ALL))


def _exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.store import exposure

    return exposure(datoms(spark, sf_dir, "customer", "nation"))


_register(
    "exposure",
    _exposure,
    f"select count(*) as datoms, cast(sum(74 + strlen(entity) + strlen(attribute) + strlen(value)) as bigint) as bytes, min(wall) as oldest from ({duckdb_datoms('customer', 'nation')})",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.feed import PostingsIndex, deliver, tail

    log, base = _scratch(spark, "log"), _scratch(spark, "index")
    datoms(spark, sf_dir, "benchmark").repartition(4).write.parquet(log)
    index = PostingsIndex(spark, f"{base}/postings")
    for _ in range(2):  # the second run has nothing to deliver
        deliver(tail(spark, log, files_per_batch=2), index.consume, f"{base}/cursor")
    return index.postings().groupBy("subject", "term").agg(F.count("*").alias("n"))


_register("stream_index_equals_batch", _streamed, _ORACLES["search_postings"])


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation is asserted, renamed and referred to its region by statements, then sealed and read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").toLocalIterator()  # 25 rows at every size
    path = _scratch(spark, "session")
    s = Session(spark, path, now=itertools.count(1000).__next__)
    for r in rows:
        e = f"nation:{r['n_nationkey']}"
        s.run(f"ASSERT {e} name = old VALID FROM 100")
        s.run(f"ASSERT {e} name = '{r['n_name']}' VALID FROM 100")
        s.run(f"ASSERT {e} region = ->region:{r['n_regionkey']} VALID FROM 100")
        if r["n_nationkey"] % 5 == 0:
            s.run(f"RETRACT {e} name = '{r['n_name']}' VALID FROM 120")
    s.close()
    again = Session(spark, path, now=itertools.count(5000).__next__)
    return read.read_entities(again.datoms(), Snapshot(150)).select("entity", "attribute", "value", "is_reference")


_register(
    "write_roundtrip",
    _session,
    "select 'nation:' || n_nationkey as entity, 'name' as attribute, n_name as value, false as is_reference from nation where n_nationkey % 5 <> 0 "
    "union all select 'nation:' || n_nationkey, 'region', 'region:' || n_regionkey, true from nation",
)

# Cluster functions, over sets.


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    acks = e.select((F.col("event_id") % 97).alias("position"), F.col("event_type").alias("domain"), (F.col("user_id") % 2).cast("int").alias("epoch"))
    return commitment.committed(acks.select("position").distinct(), acks, 1, 3)


_register(
    "commit_gate",
    _gate,
    "with a as (select event_id % 97 as position, event_type as domain, user_id % 2 as epoch from events), w as (select distinct position from a), "
    "x as (select w.position, count(distinct case when epoch = 1 then domain end) as domains from w join a using (position) group by w.position), "
    "f as (select min(position) as first from x where domains < 3) "
    "select position, domains, domains >= 3 as ready, coalesce(position < first, true) as published from x, f",
)


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers hold grants on the tenant of their nation; those with a debt had theirs withdrawn later."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    both = s.select("*", F.explode(F.expr("case when s_acctbal < 0 then array(true, false) else array(true) end")).alias("assert"))
    return both.select(
        F.lit(0).alias("tenant"),
        F.concat(F.lit("grant:"), F.lpad(F.lower(F.hex(F.col("s_nationkey") + 1)), 4, "0"), F.lit(":read")).alias("entity"),
        F.col("s_name").alias("attribute"),
        F.lit("yes").alias("value"),
        F.lit(False).alias("is_reference"),
        F.lit(0).cast("long").alias("valid_from"),
        F.lit(FOREVER).alias("valid_to"),
        "assert",
        tx_column(F.col("s_suppkey") * 2 + F.when(F.col("assert"), 0).otherwise(1), F.lit(1)).alias("tx"),
        F.lit(0).cast("long").alias("ord"),
    )


_GRANT = "'grant:' || lpad(lower(hex(s_nationkey + 1)), 4, '0') || ':read'"
_register("authz_allow", lambda s, d: access.present_grants(_grants(s, d), NOW), f"select {_GRANT} as entity, s_name as principal from supplier where s_acctbal >= 0")
_register(
    "authz_history",
    lambda s, d: access.grant_history(_grants(s, d), 8, "read").select("attribute", "assert", F.col("tx.wall").alias("wall")),
    "select s_name as attribute, a as assert, s_suppkey * 2 + case when a then 0 else 1 end as wall from supplier, (values (true), (false)) t(a) where s_nationkey = 7 and (a or s_acctbal < 0)",
)
_register(
    "entity_keys",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(
        F.concat(F.lit("customer:"), F.col("c_custkey")).alias("entity"),
        F.lower(F.hex(entity_key(F.lit(1), F.concat(F.lit("customer:"), F.col("c_custkey"))))).alias("key"),
        leaf_name(entity_key(F.lit(1), F.concat(F.lit("customer:"), F.col("c_custkey"))), 3).alias("leaf"),
    ),
    "select entity, key, '3:' || substr(key, 1, 6) as leaf from (select 'customer:' || c_custkey as entity, '0001' || substr(sha256('customer:' || c_custkey), 1, 60) as key from customer)",
)


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = entity_key(F.lit(1), F.concat(F.lit("customer:"), F.col("c_custkey")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit(3).alias("depth"), F.substring(key, 1, 3).alias("prefix")).distinct()


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"disk-{i}", 1 + i % 3, f"rack-{i % 4}") for i in range(8)], "name string, weight int, domain string")


_RANKED = (
    "with targets as (select 'disk-' || i as name, 1 + i % 3 as weight, 'rack-' || (i % 4) as domain from range(8) t(i)), "
    "leaves as (select distinct '0001' || substr(sha256('customer:' || c_custkey), 1, 2) as leaf from customer), "
    "s as (select leaf, name, domain, cast('0x' || substr(sha256(unhex('03' || leaf) || encode(name)), 1, 12) as hugeint) * weight as score from leaves, targets), "
    "r as (select *, cast(row_number() over (partition by leaf order by score desc, name) as integer) as rank from s) "
)
_register(
    "placement_rank",
    lambda s, d: placement.rank_targets(_leaves(s, d), _targets(s)).where("rank <= 2").select(F.lower(F.hex("prefix")).alias("leaf"), "name", "rank"),
    _RANKED + "select leaf, name, rank from r where rank <= 2",
)
_register(
    "placement_spread",
    lambda s, d: placement.spread(placement.rank_targets(_leaves(s, d), _targets(s)), _targets(s).select("name", "domain"), 3).select(F.lower(F.hex("prefix")).alias("leaf"), "name", "domain", "place"),
    _RANKED
    .replace("as rank from s) ", "as rank from s), ")
    + "x as (select *, row_number() over (partition by leaf, domain order by rank) as round from r) "
    "select * from (select leaf, name, domain, cast(row_number() over (partition by leaf order by round, rank) as integer) as place from x) where place <= 3",
)


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = entity_key(F.lit(1), F.concat(F.lit("nation:"), F.col("n_nationkey")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.alias("key"), "n_nationkey")
    deep = n.select(F.substring("key", 1, 3).alias("prefix"), F.lit(3).alias("depth"), F.concat(F.lit("node-"), F.col("n_nationkey")).alias("node"))
    return deep.union(spark.createDataFrame([(bytearray(b"\0\1"), 2, "root")], "prefix binary, depth int, node string"))


_register(
    "route_lookup",
    lambda s, d: placement.route(_routes(s, d).where("depth = 3").select(F.concat("prefix", F.lit(b"\0")).alias("key")).union(s.createDataFrame([(bytearray(b"\0\1\0\0"),)], "key binary")), _routes(s, d)).select(
        F.lower(F.hex("key")).alias("key"), "depth", "node"
    ),
    "with r as (select '0001' || substr(sha256('nation:' || n_nationkey), 1, 2) as prefix, 'node-' || n_nationkey as node from nation), "
    "k as (select prefix || '00' as key from r union select '00010000') "
    "select key, cast(case when max(node) is null then 2 else 3 end as integer) as depth, coalesce(max(node), 'root') as node from k left join r on substr(key, 1, 6) = prefix group by key",
)


def _topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their nations as a topology of three levels; both tables have a fixed number of rows."""
    below: dict[int, list[dict]] = {}
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").toLocalIterator():
        below.setdefault(r["n_regionkey"], []).append({"name": r["n_name"], "level": "nation"})
    regions = [{"name": f"region {r['r_name']}", "level": "region", "children": below.get(r["r_regionkey"], [])} for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").toLocalIterator()]
    tree = {"version": 1, "depth": 2, "levels": ["world", "region", "nation"], "root": {"name": "world", "level": "world", "children": regions}}
    return spark.createDataFrame(list(placement.nested_set(tree)), placement.TOPOLOGY)


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _topology(spark, sf_dir)
    leaves = nodes.where("level = 'nation'").select("name")
    return placement.distances(nodes, leaves.toDF("a").join(leaves.toDF("b"), F.col("a") < F.col("b")))


_register(
    "topology_distance",
    _distance,
    "with n as (select n_name as name, r_name as region from nation join region on n_regionkey = r_regionkey) "
    "select x.name as a, y.name as b, case when x.region = y.region then 'region ' || x.region else 'world' end as ancestor, "
    "cast(case when x.region = y.region then 1 else 2 end as integer) as distance from n x join n y on x.name < y.name",
)


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaf, its nations in the order in which a reader in NATION_6 asks them."""
    targets = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), F.lit(1).alias("weight"))
    places = placement.rank_targets(_leaves(spark, sf_dir), targets).where("rank <= 6").select("depth", "prefix", "name", F.col("rank").alias("place"))
    return placement.nearest(places, _topology(spark, sf_dir), "NATION_6").select(F.lower(F.hex("prefix")).alias("leaf"), "name", "place", "near")


_register(
    "placement_nearest",
    _near,
    "with leaves as (select distinct '0001' || substr(sha256('customer:' || c_custkey), 1, 2) as leaf from customer), "
    "s as (select leaf, n_name as name, n_regionkey as region, cast('0x' || substr(sha256(unhex('03' || leaf) || encode(n_name)), 1, 12) as hugeint) as score from leaves, nation), "
    "p as (select *, cast(row_number() over (partition by leaf order by score desc, name) as integer) as place from s), "
    "f as (select n_regionkey as home from nation where n_name = 'NATION_6') "
    "select leaf, name, place, cast(row_number() over (partition by leaf order by case when name = 'NATION_6' then 0 when region = home then 1 else 2 end, place) as integer) as near from p, f where place <= 6",
)


def _shredded(spark: SparkSession, sf_dir: str, subject: str) -> DataFrame:
    """Posting counts of all subjects, sealed, after one subject's key was destroyed."""
    from .erase import allocate_all, destroy_of, open_, seal

    scratch = Scratch(spark, "erasure")
    p = search.postings(datoms(spark, sf_dir, "benchmark")).select("subject", "term")
    keys = scratch.save(allocate_all(p.select("subject").distinct()), "keys")
    sealed = scratch.save(seal(p, keys), "sealed")
    return open_(sealed, scratch.save(destroy_of(keys, subject), "keys")).groupBy("subject", "term").agg(F.count("*").alias("n"))


_register("erasure_shred", lambda s, d: _shredded(s, d, "item:2"), f"select * from ({_ORACLES['search_postings']}) where subject <> 'item:2'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitemporal READ of one user of the event table."""
    return _rows(compile_statement(spark, datoms(spark, sf_dir, "events"), parse(f"READ * FROM {_USER} AS OF {MID_EVENTS} TRANSACTION 400"), NOW))


__all__ = ["flagship", "oracle_sql", "queries", "temporal"]
