"""Clock, access, erasure, placement, surfaces and the registry."""

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from twinaxis import erase, observe, surfaces
from twinaxis import errors as e
from twinaxis.clock import Clock, Minter
from twinaxis.functions.keys import entity_key, key_bytes, parse_leaf
from twinaxis.model import DATOMS, FOREVER, TxId
from twinaxis.operators import access, commitment, placement
from twinaxis.ql import Read, TimeClause


def test_clock():
    c = Clock(lambda: 10)
    assert c.now() == (10, 0) and c.now() == (10, 1) and c.merge(10, 5) == (10, 6) and c.merge(20, 3) == (20, 4) and c.now() == (20, 5)
    with pytest.raises(e.SkewTooLarge):
        c.admit(99, 0, 5)
    m = Minter(Clock(lambda: 1))
    ids = [m.mint() for _ in range(3)]
    assert ids == sorted(ids) and ids[0].seq == 1
    m.observe(TxId(50, 2, b"", 0, 40))
    assert m.mint() > TxId(50, 2, b"", 0, 40)


def test_grants(spark):
    def row(action, who, keep, wall):
        return (0, access.grant_entity(7, action), who, "yes", False, 0, FOREVER, keep, TxId(wall, seq=1).row(), 0)

    d = spark.createDataFrame([row("read", "ann", True, 1), row("read", "bob", True, 1), row("read", "bob", False, 2)], DATOMS)
    access.allow(d, "ann", 7, "read", 100)
    for who, tenant, action, error in (("bob", 7, "read", e.NotGranted), ("ann", 7, "write", e.NotGranted), ("ann", 0, "read", e.ReservedTenant)):
        with pytest.raises(error):
            access.allow(d, who, tenant, action, 100)
    assert access.grant_history(d, 7, "read").count() == 3


def test_keys(spark):
    row = spark.range(1).select(entity_key(F.lit(258), F.lit("planet-é")).alias("k")).first()
    assert bytes(row["k"]) == key_bytes(258, "planet-é") and len(row["k"]) == 32
    assert parse_leaf("2:0102") == (2, b"\1\2")
    with pytest.raises(ValueError):
        parse_leaf("2:01")


def test_erasure(spark):
    keys = erase.Keystore(spark)
    first = keys.allocate("a")
    keys.allocate("b")
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "subject string, term string")
    sealed = erase.seal(p, keys.table()).cache()
    sealed.count()
    purge = erase.Purge(keys, {"index": type("S", (), {"forget": lambda self, s: True})(), "log": object()})
    assert purge.shred("a") == ("incomplete", ["log"]) and purge.shred("nobody")[0] == "refused"
    assert sorted(tuple(r) for r in erase.open_(sealed, keys.table()).collect()) == [("b", "y"), ("b", "y")]
    with pytest.raises(e.KeyDestroyed):
        keys.fetch(first)
    with pytest.raises(e.UnknownSubject):
        keys.fetch(b"?")
    assert keys.allocate("a") != first
    with pytest.raises(e.NoBound):
        purge.sweep(p, 0)
    o = erase.Obligations()
    o.raise_("k", "s", 5)
    o.raise_("k", "s", 9)
    o.raise_("k", "r", 1)
    assert [x[2] for x in o.outstanding()] == [1, 5]


def test_placement(spark):
    leaves = spark.createDataFrame([(2, bytearray([i, 0])) for i in range(200)], "depth int, prefix binary")
    targets = spark.createDataFrame([("a", 1), ("b", 3), ("off", 0)], "name string, weight int")
    ranked = placement.rank_targets(leaves, targets)
    best = {r["name"]: r["count"] for r in ranked.where("rank = 1").groupBy("name").count().collect()}
    assert set(best) == {"a", "b"} and best["b"] > best["a"] and ranked.where("rank = 3").select("name").distinct().first()["name"] == "off"
    domains = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("off", "r2")], "name string, domain string")
    assert placement.spread(ranked, domains, 2).groupBy("prefix").agg(F.count_distinct("domain").alias("n")).where("n < 2").isEmpty()


def test_events():
    s = observe.Stream(2)
    for n in range(3):
        s.emit("routing.redirect", n)
    assert [x[1] for x in s.take()] == [0, 1] and s.dropped == 1 and s.counts["routing.redirect"] == 3 and s.take() == []
    with pytest.raises(e.Refused):
        s.emit("routing.unheard-of", 1)


def test_topology_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"version": 1, "levels": ["u", "d"], "depth": 1, "root": {"level": "u", "name": "u", "children": [{"level": "d", "name": "a", "weight": 5}, {"level": "d", "name": "b"}]}}')
    nodes = placement.load_topology(spark, f"file://{tmp_path}/t.json")
    assert {r["name"]: (r["lft"], r["rgt"], r["weight"]) for r in nodes.collect()} == {"u": (1, 6, 6), "a": (2, 3, 5), "b": (4, 5, 1)}
    with pytest.raises(ValueError):
        list(placement.nested_set({"version": 9, "levels": ["u"], "root": {}}))


def test_topology(spark):
    tree = {"version": 1, "levels": ["u", "s", "d"], "depth": 3, "root": {"name": "u", "level": "u", "children": [{"name": "s1", "level": "s", "children": [{"name": "d1", "level": "d"}, {"name": "d2", "level": "d"}]}, {"name": "d3", "level": "d"}]}}
    nodes = spark.createDataFrame(list(placement.nested_set(tree)), placement.TOPOLOGY)
    pairs = spark.createDataFrame([("d1", "d2"), ("d1", "d3"), ("d1", "d1"), ("s1", "d1")], "a string, b string")
    assert {(r["a"], r["b"]): r["distance"] for r in placement.distances(nodes, pairs).collect()} == {("d1", "d2"): 1, ("d1", "d3"): 2, ("d1", "d1"): 0, ("s1", "d1"): 1}
    with pytest.raises(ValueError):
        list(placement.nested_set({"levels": ["u"], "root": {"name": "u", "level": "u", "children": [{"name": "u", "level": "u"}]}}))


def test_routes(spark):
    full = [(bytearray([1, i]), 2, "n1") for i in range(256)] + [(bytearray([2, 0]), 2, "n2"), (bytearray([1]), 1, "old")]
    routes = spark.createDataFrame(full, "prefix binary, depth int, node string")
    keys = spark.createDataFrame([(bytearray([1, 9, 9]),), (bytearray([2, 0, 9]),), (bytearray([3]),)], "key binary")
    assert sorted((r["depth"], r["node"]) for r in placement.route(keys, routes).collect()) == [(2, "n1"), (2, "n2")]
    assert {(r["depth"], r["node"]) for r in placement.aggregate_routes(routes.where("depth = 2")).collect()} == {(1, "n1"), (2, "n2")}
    assert placement.follow("a", {"a": (1, "b"), "b": None}.get) == "b"
    with pytest.raises(ValueError):
        placement.follow("a", lambda n: (1, n))


def test_commitment(spark):
    writes = spark.createDataFrame([(1,), (2,), (3,)], "position int")
    acks = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "x", 5), (2, "x", 5), (2, "y", 4), (3, "x", 5), (3, "y", 5)], "position int, domain string, epoch int")
    assert {r["position"] for r in commitment.committed(writes, acks, 5, 2).where("published").collect()} == {1}
    assert {(r["position"], r["why"]) for r in commitment.pending(writes, acks, 5, 2).collect()} == {(2, "domains"), (3, "order")}
    with pytest.raises(ValueError):
        commitment.shortfall(spark.createDataFrame([], "leaf string, domain string"), 1)


def test_surfaces():
    assert surfaces.compile_call("read_entity", {"entity": "p", "as_of": 5}) == Read("p", time=TimeClause(5))
    assert surfaces.compile_path("/.at/7/e/p/mass") == Read("p", attributes=("mass",), time=TimeClause(7))
    for call, code in ((("drop", {}), "unknown_tool"), (("read_entity", {}), "missing_argument"), (("read_entity", {"entity": "p", "tenant": 1}), "tenant")):
        with pytest.raises(surfaces.SurfaceRefusal) as x:
            surfaces.compile_call(*call)
        assert x.value.code == code
    with pytest.raises(surfaces.SurfaceRefusal):
        surfaces.compile_path("/x")
    with pytest.raises(surfaces.SurfaceRefusal):
        surfaces.register(surfaces.Tool("delete_entity", (), ("as_of",)))


def test_stat(spark):
    rows = spark.createDataFrame([("p", "a", "dé", TxId(7, seq=1).row()), ("q", "a", "x", TxId(8, seq=1).row())], "entity string, attribute string, value string, tx struct<wall:long,logical:long,leaf_prefix:binary,leaf_depth:short,seq:long>")
    gone = spark.createDataFrame([("q",)], "subject string")
    assert [tuple(r) for r in surfaces.stat(rows, gone).collect()] == [("p", "a", 3, 7)]
    with pytest.raises(surfaces.SurfaceRefusal) as x:
        surfaces.open_path("/e/p/a", write=True)
    assert x.value.code == "EROFS"


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(v) if hasattr(v, "as_tuple") else v) for v in (r[i] for i in order)) for r in rows)


def test_every_query_matches_its_sql(spark):
    from twinaxis.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    oracles = oracle_sql()
    wrong = []
    for name, run in queries().items():
        df = run(spark, DATA)
        got = _plain([tuple(r) for r in df.collect()], df.columns)
        if name in oracles:
            res = con.execute(oracles[name])
            if got != _plain(res.fetchall(), [c[0] for c in res.description]):
                wrong.append(name)
    assert not wrong


def test_nearest_reorders_and_drops_nothing(spark):
    tree = {"version": 1, "levels": ["u", "s", "d"], "depth": 3, "root": {"name": "u", "level": "u", "children": [{"name": f"s{i}", "level": "s", "children": [{"name": f"s{i}d{j}", "level": "d"} for j in range(2)]} for i in range(2)]}}
    nodes = spark.createDataFrame(list(placement.nested_set(tree)), placement.TOPOLOGY)
    names = ["s0d0", "s1d0", "gone", "s1d1", "s0d1"]
    places = spark.createDataFrame([(1, bytearray([7]), n, i + 1) for i, n in enumerate(names)], "depth int, prefix binary, name string, place int")
    near = lambda origin: [r["name"] for r in placement.nearest(places, nodes, origin).orderBy("near").collect()]
    assert near("s1d1") == ["s1d1", "s1d0", "s0d0", "s0d1", "gone"] and near("nowhere") == names
    assert {r["name"]: r["ancestor"] for r in placement.ancestors(nodes, "s").collect()}["s1d0"] == "s1"


def test_generation(spark):
    text = f"{10**9:016x}{1:08x}" + "00" * 32 + "02" + f"{1:08x}"
    got = placement.generation_of({"generation": text})
    assert got == TxId(10**9, 1, b"\0\0", 2, 1) and placement.require_generation({"generation": text}) == got and placement.generation_of({}) is None
    for bad in ("xyz", "00", "00" * 49, text[:-10] + "ff" + text[-8:]):
        with pytest.raises(ValueError):
            placement.generation_of({"generation": bad})
    with pytest.raises(ValueError):
        placement.require_generation({})
    for odd in ({"extra": 1}, {"root": {"level": "u", "name": "u", "more": 1}}):
        with pytest.raises(ValueError, match="unknown fields"):
            list(placement.nested_set({"version": 1, "levels": ["u"], "depth": 1, "root": {"level": "u", "name": "u"}, **odd}))


def test_durability(spark):
    nodes = spark.createDataFrame([("r1", "rack"), ("r2", "rack"), ("d", "disk")], "name string, level string")
    commitment.require_feasible(nodes, "rack", 2)
    with pytest.raises(e.UndeclaredLevel):
        commitment.require_feasible(nodes, "rak", 1)
    with pytest.raises(e.TooFewDomains):
        commitment.require_feasible(nodes, "rack", 3)
    copies = lambda *rows: spark.createDataFrame(list(rows), "leaf string, domain string")
    assert commitment.feasible(copies(("a", "x"), ("a", "y")), 2) and not commitment.feasible(copies(("a", "x"), ("a", "")), 2)
    w, owed = commitment.Watchdog(10), erase.Obligations()
    w.observe(copies(("a", "x"), ("b", "x"), ("b", "y")), 2, 100)
    w.observe(copies(("a", "x"), ("b", "x"), ("b", "x")), 2, 105)
    assert w.status(108) == [("a", 1, 8), ("b", 1, 3)] and w.report(owed, 108) == 0
    assert w.report(owed, 112) == 1 and w.report(owed, 120) == 2
    w.observe(copies(("a", "x"), ("a", "y"), ("b", "x")), 2, 121)
    assert [x[0] for x in w.status(121)] == ["b"] and [x[1:] for x in owed.outstanding()] == [("a", 100), ("b", 105)]
    with pytest.raises(e.NoBound):
        commitment.Watchdog(0)
    entries = spark.createDataFrame([(TxId(2, seq=1).row(), 0), (TxId(1, seq=1).row(), 1)], "tx struct<wall:long,logical:long,leaf_prefix:binary,leaf_depth:short,seq:long>, ord long")
    assert [r["tx"]["wall"] for r in commitment.in_order(entries).orderBy("place").collect()] == [1, 2]


def test_certificates_and_hidden_subjects(spark):
    row = lambda who, keep, wall: (0, f"cert:{who}", "certificate:denied", "yes", False, 0, FOREVER, keep, TxId(wall, seq=1).row(), 0)
    d = spark.createDataFrame([row("1a", True, 1), row("2b", True, 1), row("2b", False, 2), (7, *row("3c", True, 1)[1:])], DATOMS)
    assert [r["serial"] for r in access.denied_certificates(d, 100).collect()] == ["1a"]
    keys = erase.Keystore(spark)
    keys.allocate("cert:1a")
    keys.allocate("cert:2b")
    keys.shred("cert:1a")
    assert {r["entity"] for r in erase.hide_erased(d, keys.table()).collect()} == {"cert:2b", "cert:3c"}


def test_shredding_covers_every_subject(spark):
    from conftest import DATA
    from pyspark.sql import functions as F

    from twinaxis import queries
    from twinaxis.operators import search

    p = search.postings(queries.datoms(spark, DATA, "benchmark"))
    want = {tuple(r) for r in p.groupBy("subject", "term").agg(F.count("*")).collect()}
    got = {tuple(r) for r in queries._shredded(spark, DATA, "item:2").collect()}
    assert len({s for s, _, _ in got}) > 3
    assert got == {r for r in want if r[0] != "item:2"}
    assert {tuple(r) for r in queries.queries()["erasure_shred"](spark, DATA).collect()} == {r for r in want if r[0] != "item:2"}
