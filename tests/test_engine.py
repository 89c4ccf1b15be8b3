"""Visibility, carried state, reads, walks and search against small cases and a plain oracle."""

import random

import pytest
from pyspark.errors import PySparkException

from twinaxis import errors as e
from twinaxis.model import DATOMS, FOREVER, TxId
from twinaxis.operators import carried, read, search, shape, traverse
from twinaxis.operators.temporal import Snapshot, resolve, visible
from twinaxis.plans.session import Session, Transaction
from twinaxis.ql import Leg, Predicate, TimeClause
from twinaxis.sources.scripts import run_script
from twinaxis.sources.store import LeafStore, Policy, exposure


def fact(entity, attribute, value, wall=1, start=0, end=FOREVER, keep=True, ref=False, seq=1, logical=0, order=0):
    return (1, entity, attribute, value, ref, start, end, keep, TxId(wall, logical, b"", 0, seq).row(), order)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DATOMS)


def held(df):
    return sorted((r["entity"], r["attribute"], r["value"]) for r in df.collect())


def test_visibility_and_carried_agree_with_a_plain_oracle(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        start = rng.randrange(0, 100)
        end = FOREVER if rng.random() < 0.2 else start + rng.randrange(-5, 60)
        rows.append(fact(f"e{rng.randrange(8)}", f"a{rng.randrange(4)}", str(i), rng.randrange(1, 100), start, end, rng.random() < 0.8, seq=i + 1, logical=rng.randrange(3), order=i))
    d = frame(spark, *rows).cache()
    for _ in range(6):
        t, known = rng.randrange(0, 120), rng.choice([None, TxId(rng.randrange(1, 100)), TxId(50, 1, b"", 0, 300)])
        at = Snapshot(t, known)
        seen = [r for r in rows if r[5] <= t < r[6] and (known is None or (r[8][0], r[8][1], bytes(r[8][2]), r[8][3], r[8][4]) <= (known.wall, known.logical, known.leaf_prefix, known.leaf_depth, known.seq))]
        assert visible(d, at).count() == len(seen)
        last = {}
        for r in seen:
            k = (r[1], r[2])
            if k not in last or (r[8][0], r[8][1], r[8][4]) > (last[k][8][0], last[k][8][1], last[k][8][4]):
                last[k] = r
        assert held(carried.carried(d, at)) == sorted((r[1], r[2], r[3]) for r in last.values() if r[7])


def test_resolve():
    assert resolve(TimeClause(), 9) == Snapshot(9)
    assert resolve(TimeClause(3, 4), 9) == Snapshot(3, TxId(4))
    with pytest.raises(e.NoSnapshot):
        resolve(TimeClause(None, 0), 9)


def test_retraction_comes_after_the_choice_of_the_latest(spark):
    d = frame(spark, fact("p", "a", "1", 100), fact("p", "a", "whatever", 200, keep=False), fact("p", "mass", "5"), fact("p", "b", "x", 1), fact("p", "b", "x", 2, start=500, keep=False))
    assert held(carried.carried(d, Snapshot(400))) == [("p", "b", "x"), ("p", "mass", "5")]
    assert held(carried.carried(d, Snapshot(600))) == [("p", "mass", "5")]


def test_equal_ids_keep_the_first(spark):
    d = frame(spark, fact("p", "a", "second", order=2), fact("p", "a", "first", order=1))
    assert held(carried.carried(d, Snapshot(1))) == [("p", "a", "first")]


@pytest.mark.parametrize(
    ("value", "op", "literal", "numeric", "want"),
    [("5", "=", "5.0", True, 1), ("5", "!=", "5", True, 0), ("10", "<", "9", True, 0), ("10", "<", "9", False, 1), ("7", ">=", "7", True, 1), ("7", "<=", "6", True, 0), ("Z", "<", "a", False, 1), ("NaN", "=", "3", True, 1), ("1e3", ">", "999", True, 1), ("0x1p4", "=", "16", True, 1), ("-0X1.8p1", "=", "-3", True, 1), ("0x.8p-1", "=", "0.25", True, 1), ("16", "=", "0x1p4", True, 1), ("0x1p-1074", ">", "0", True, 1), ("inf", ">", "1e308", True, 1)],
)
def test_comparisons(spark, value, op, literal, numeric, want):
    d = frame(spark, fact("p", "v", value))
    assert read.read_entities(d, Snapshot(1), (), Predicate("v", op, literal, numeric)).count() == want


@pytest.mark.parametrize("value", ["blue marble", " 5 ", "1d", "", "1_000", "1e999", "-1e999", "0x1", "0x1p9999"])
def test_a_value_that_is_no_number_refuses(spark, value):
    d = frame(spark, fact("p", "v", value))
    with pytest.raises(PySparkException, match="cannot be compared"):
        read.read_entities(d, Snapshot(1), (), Predicate("v", ">", "5", True)).collect()
    assert read.read_entities(d, Snapshot(1), (), Predicate("absent", ">", "5", True)).count() == 0


def staff(spark):
    rows = [fact(n, "member", "staff", ref=True) for n in ("ann", "bob", "cy", "dee")]
    rows += [fact(n, "name", n.title()) for n in ("ann", "bob", "dee")] + [fact(n, "lastname", "a") for n in ("ann", "cy")] + [fact("dee", "lastname", "z")]
    return frame(spark, *rows, fact("eve", "member", "staff"), fact("fay", "member", "staff", 1, ref=True), fact("fay", "member", "staff", 2, keep=False, ref=True))


def test_inbound(spark):
    s = Session(spark, now=lambda: 10)
    s.memory = [tuple(r) for r in staff(spark).collect()]
    run = lambda text: sorted({r["entity"] for r in s.run(text).collect()})
    assert run("READ ->name FROM [staff] WHERE ->lastname = 'a'") == ["ann"]
    assert run("READ * FROM [staff]") == ["ann", "bob", "cy", "dee"]
    assert run("READ ->name FROM [staff] LIMIT 1 OFFSET 1") == ["bob"]
    assert run("READ * FROM [staff] WITHOUT ->lastname") == ["bob"]
    assert run("READ * FROM [staff] LIMIT 0") == []
    assert run("READ ->name, ->name FROM [staff]") == ["ann", "bob", "dee"]


def test_absence_follows_the_snapshot(spark):
    rows = [fact(n, "member", "staff", ref=True) for n in ("ann", "bob", "cy", "dee")]
    rows += [fact("bob", "third", "x", 100), fact("bob", "third", "x", 200, start=200, keep=False), fact("cy", "third", "x", 1, 0, 200), fact("dee", "third", "x")]
    d = frame(spark, *rows)
    names = lambda t: sorted({r["entity"] for r in read.read_entities(d, Snapshot(t), without=("third",)).collect()})
    assert names(300) == ["ann", "bob", "cy"]
    assert names(150) == ["ann"]


def test_session_script_and_time_travel(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/leaf", now=iter(range(1000, 3000)).__next__)
    lines = ["-- a comment", "", "ASSERT p mass = 5972 VALID FROM 100", "ASSERT p mass = 6000 VALID FROM 100", "READ mass FROM p AS OF 150", "READ mass FROM p AS OF 150 TRANSACTION 1001", "SELECT * FROM p", "READ mass FROM p WHERE mass > 1 AS OF 50"]
    out = [x for _, x in run_script(s, lines)]
    assert [[r["value"] for r in x] for x in out[2:4]] == [["6000"], ["5972"]]
    assert out[4].startswith("refused: ql: at byte 0") and out[5] == []
    s.close()
    again = Session(spark, f"file://{tmp_path}/leaf", now=lambda: 5)
    again.run("ASSERT p mass = 7 VALID FROM 100")
    assert [r["value"] for r in again.run("READ mass FROM p AS OF 150").collect()] == ["7"]  # its id is past all that were read


def test_transactions():
    t = Transaction("p")
    t.assert_("p", "a", "1")
    with pytest.raises(e.CrossEntity):
        t.retract("q", "a")
    assert len(t.writes) == 1
    with pytest.raises(e.NoEntity):
        Transaction("")


def test_store_compaction_changes_no_answer(spark, tmp_path):
    store = LeafStore(spark, f"file://{tmp_path}/s")
    rows = [fact(f"e{i % 5}", f"a{i % 3}", str(i), wall=i + 1, seq=i + 1, keep=i % 7 != 0) for i in range(60)]
    for part in (rows[:25], rows[20:45], rows[40:]):
        store.append(part)
        store.seal()
    before = held(carried.carried(store.datoms(), Snapshot(5)))
    assert store.raw().count() == 70 and store.datoms().count() == 60
    reader = store.datoms()
    assert store.compact() and not store.compact()
    assert reader.count() == 60  # planned before, its segments are there for a while
    store.sweep(0)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        reader.collect()
    store.least_bytes, store.ratio = 100, 1.05
    store.append([rows[0]])
    store.seal()
    large = store.segments()
    assert len(large) == 2 and len(store.tiers()) == 2 and not store.compact()  # a small segment leaves the large one alone
    store.least_bytes, store.ratio = 1 << 20, 4
    assert store.compact() and store.raw().count() == 60
    assert held(carried.carried(store.datoms(), Snapshot(5))) == before and store.datoms().count() == 60
    assert [r["tx"]["wall"] for r in store.history("e1").collect()] == [i + 1 for i in range(60) if i % 5 == 1]
    assert store.last().wall == 60
    assert exposure(frame(spark, fact("ab", "c", "dé"))).first()["bytes"] == 74 + 2 + 1 + 3


def test_policy():
    with pytest.raises(e.NoBound):
        Policy().should_seal(1, 1, 1)
    assert Policy(max_bytes=10).should_seal(10, 0, 0) and not Policy(max_age=5).should_seal(99, 1, 5) and Policy(max_age=4).should_seal(0, 1, 5)


def test_walks(spark):
    d = frame(spark, fact("p", "orbits", "star", ref=True), fact("star", "within", "old", 1, 100, 200, ref=True), fact("star", "within", "new", 2, 200, ref=True), fact("p", "note", "star"))
    names = lambda t: [r["entity"] for r in traverse.traverse(spark, d, "p", 2, Snapshot(t)).collect()]
    assert names(150) == ["star", "old"] and names(250) == ["star", "new"]
    ring = frame(spark, *[fact(a, "n", b, ref=True) for a, b in ("ab", "bc", "ca")])
    assert len(traverse.traverse(spark, ring, "a", 2, Snapshot(1)).collect()) == 2  # the way back lies deeper
    with pytest.raises(e.CycleFound):
        traverse.traverse(spark, ring, "a", 3, Snapshot(1))
    diamond = frame(spark, *[fact(a, x, b, ref=True) for a, x, b in (("r", "x", "a"), ("r", "y", "b"), ("a", "x", "z"), ("b", "x", "z"))])
    with pytest.raises(e.CycleFound):
        traverse.traverse(spark, diamond, "r", 2, Snapshot(1))


def test_search(spark):
    d = frame(spark, fact("planet-1", "t", "red dwarf star"), fact("planet-2", "t", "Red-giant star"), fact("planet-3", "t", "blue nebula"), fact("planet-4", "t", "dwarf dwarf dwarf"), fact("planet-5", "t", "dwarf", keep=False), fact("planet-6", "t", "dwarf", ref=True))
    hits = search.search(d, "dwarf", 10).collect()
    assert [r["subject"] for r in hits] == ["planet-4", "planet-1"] and abs(hits[0]["score"] / hits[1]["score"] - 3) < 1e-9
    assert [r["subject"] for r in search.search(d, "dwarf", 10, erased=spark.createDataFrame([("planet-4",)], "subject string")).collect()] == ["planet-1"]
    with pytest.raises(e.NoQuery):
        search.search(d, " - ", 1)
    with pytest.raises(e.NoLimit):
        search.search(d, "x", 0)


def test_facets(spark):
    hits = spark.createDataFrame([(x,) for x in "abcde"], "subject string")
    values = spark.createDataFrame([("a", "rock"), ("b", "gas"), ("c", "rock"), ("d", "rock")], "entity string, value string")
    assert [tuple(r) for r in search.facet(hits, values, 5).collect()] == [("rock", 3), ("gas", 1)]
    with pytest.raises(e.FacetTooWide):
        search.facet(hits, values, 3)
    with pytest.raises(e.NoFacetBound):
        search.facet(hits, values, 0)


def test_shape_legs(spark):
    d = frame(spark, fact("a", "mass", "1"), fact("a", "nick", "A"), fact("b", "mass", "2"), fact("c", "mass", "3"), fact("c", "retired", "yes"), fact("d", "nick", "D"))
    out = shape.build_rows(d, (Leg("mass", "required"), Leg("nick", "optional"), Leg("retired", "excluded")), 1, Snapshot(1)).orderBy("entity").collect()
    assert [tuple(r) for r in out] == [("a", "1", "A"), ("b", "2", None)]
    s = Session(spark, now=lambda: 1)
    with pytest.raises(e.Unsupported, match="similarity"):
        s.run("MATCH SHAPE LIKE a SIMILARITY cosine >= 0.5")


def test_literals_out_of_range_are_refused(spark):
    d = frame(spark, fact("p", "v", "5"))
    for literal in ("1e999", "0x1p99999", "five"):
        with pytest.raises(e.NotComparable):
            read.read_entities(d, Snapshot(1), (), Predicate("v", ">", literal, True))


def of(tenant, row):
    return (tenant, *row[1:])


def test_tenants_see_nothing_of_each_other(spark, tmp_path):
    from twinaxis.operators import access

    path = f"file://{tmp_path}/shared"
    one, two = (Session(spark, path, now=iter(range(1000 * t, 1000 * t + 900)).__next__, tenant=t) for t in (1, 2))
    for s, v in ((one, "alpha"), (two, "beta")):
        s.run(f"ASSERT x secret = {v} VALID FROM 0")
        s.run(f"ASSERT x knows = ->{v} VALID FROM 0")
        s.run(f"ASSERT {v} knows = ->end{v} VALID FROM 0")
        s.close()
    values = lambda s, text: sorted(r["value"] for r in s.run(text).collect())
    assert values(one, "READ secret FROM x AS OF 5") == ["alpha"] and values(two, "READ secret FROM x AS OF 5") == ["beta"]
    assert [r["entity"] for r in two.run("TRAVERSE x DEPTH 2 AS OF 5").collect()] == ["beta", "endbeta"]
    assert one.run("SEARCH 'beta' IN secret LIMIT 5 AS OF 5").count() == 0 and two.run("SEARCH 'beta' IN secret LIMIT 5 AS OF 5").count() == 1
    assert sorted(r["entity"] for r in one.run("READ * FROM [alpha] AS OF 5").collect()) == ["x", "x"]
    grants = spark.createDataFrame([(0, access.grant_entity(1, "read"), "ann", "yes", False, 0, FOREVER, True, TxId(1, seq=1).row(), 0)], DATOMS)
    assert [r["value"] for r in one.authorized(grants, "ann", "READ secret FROM x AS OF 5", 100).collect()] == ["alpha"]
    with pytest.raises(e.NotGranted):
        two.authorized(grants, "ann", "READ secret FROM x AS OF 5", 100)
    both = frame(spark, of(1, fact("a", "v", "1", 5)), of(2, fact("a", "v", "2", 9)), of(2, fact("a", "w", "3")))
    assert {(r["tenant"], r["value"]) for r in carried.carried(both, Snapshot(1)).collect()} == {(1, "1"), (2, "2"), (2, "3")}
    assert read.read_entities(both, Snapshot(1), without=("w",)).count() == 1 and read.read_entities(both, Snapshot(1), (), Predicate("v", "=", "2", True)).count() == 2


def test_an_unbound_instant_is_refused(spark):
    with pytest.raises(e.UnboundInstant):
        visible(frame(spark, fact("a", "v", "1")), Snapshot(None))


def test_store_load(spark, tmp_path):
    store = LeafStore(spark, f"file://{tmp_path}/s")
    store.append([fact("a", "v", "1", wall=5), fact("a", "v", "2", wall=9), fact("b", "v", "3")])
    assert held(store.load("a", Snapshot(1, TxId(6)))) == [("a", "v", "1")] and store.load("a", Snapshot(1)).count() == 2
    with pytest.raises(e.NoSnapshot):
        store.load("a", Snapshot(1, TxId(0)))


def test_policy_seals_and_compacts(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/p", now=iter(range(1, 500)).__next__, policy=Policy(max_bytes=1, max_segments=3))
    for i in range(7):
        s.run(f"ASSERT e{i} v = {i} VALID FROM 0")
    assert not s.store.tail and 1 <= len(s.store.segments()) < 3 and s.datoms().count() == 7


def test_walks_of_any_depth_scan_each_level_once(spark):
    links = spark.createDataFrame([(f"n{i}", "next", f"n{i + 1}") for i in range(12)], "src string, attribute string, dst string")
    roots = spark.createDataFrame([("n0",), ("n3",)], "entity string")
    for depth in (1, 3, 6):
        out = traverse.walk(spark, links, roots, depth, strict=False)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= depth and out.count() == 2 * depth


def test_index_answers_like_the_texts(spark, tmp_path):
    from twinaxis.sources.postings import SearchIndex

    rng = random.Random(4)
    words = "red dwarf star giant blue".split()
    rows = []
    for i in range(120):
        rows.append(fact(f"p{i % 30}", rng.choice("tu"), " ".join(rng.choices(words, k=rng.randrange(0, 6))), wall=i + 1, start=rng.choice([0, 0, 50]), end=rng.choice([FOREVER, 80]), keep=rng.random() < 0.8, ref=rng.random() < 0.1, seq=i + 1, order=i))
    d = frame(spark, *rows)
    index = SearchIndex.build(spark, d, f"file://{tmp_path}/i")
    plan = index.postings.where("term in ('red')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,red)" in plan
    erased = spark.createDataFrame([("p3",), ("p4",)], "subject string")
    for at in (None, Snapshot(10), Snapshot(60, TxId(90)), Snapshot(90)):
        for gone in (None, erased):
            a, b = ([(r["subject"], round(r["score"], 9)) for r in search.search(d, "Red, dwarf moon", 20, ("t",), at, gone, x).collect()] for x in (None, index))
            assert a == b and (at is None or a)
    assert search.match(index.postings, "star", 3).count() == 3
    assert {f.name for f in search.postings(d).schema} >= {"tx_from", "tx_until"} and search.postings(d).where("tx_until is not null").isEmpty()


def test_building_an_index_moves_nothing(spark, tmp_path):
    from twinaxis.sources.postings import SearchIndex

    d = frame(spark, *[fact(f"p{i}", "t", "red red star" + " giant" * (i % 3), wall=i + 1, seq=i + 1, order=i) for i in range(40)]).repartition(5).localCheckpoint()
    spark.sparkContext.setJobGroup("index", "index")
    index = SearchIndex.build(spark, d, f"file://{tmp_path}/i")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    # A job without an exchange has one stage.
    assert [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("index")] == [1]
    assert index.postings.where("term = 'red'").agg({"n": "sum"}).first()[0] == 80


def test_blocks_of_any_size_hold_the_same_index(spark, tmp_path):
    from twinaxis.sources.postings import SearchIndex

    rng = random.Random(6)
    texts = ["", "?!", "ÄRGER ärger Σίσυφος 東京 x1", "red " * 40, *[" ".join(rng.choices("red Red dwarf star, giant".split(), k=rng.randrange(12))) for _ in range(50)]]
    rows = [fact(f"p{i % 40}", "t", x, wall=i + 1, keep=i % 7 > 0, ref=i % 9 == 0, seq=i + 1, order=i) for i, x in enumerate(texts)]
    d = frame(spark, *rows).repartition(3, "entity")
    want = sorted((r["subject"], r["term"], r["tx_from"]["wall"], r["count"]) for r in search.postings(d).groupBy("subject", "term", "tx_from").count().collect())
    for terms, facts in ((1, 100), (1000, 1), (7, 4), (1000, 1000)):
        index = SearchIndex.build(spark, d, f"file://{tmp_path}/{terms}-{facts}", terms, facts)
        assert sorted((r["entity"], r["term"], r["tx"]["wall"], r["n"]) for r in index.postings.collect()) == want
        assert index.facts.count() == len(rows) == index.facts.select("block", "slot").distinct().count()
        assert index.facts.groupBy("block").count().agg({"count": "max"}).first()[0] <= facts
        assert search.search(d, "red x1", 50, (), None, None, index).collect() == search.search(d, "red x1", 50).collect()
    assert SearchIndex.build(spark, d.limit(0), f"file://{tmp_path}/none").postings.isEmpty()


def test_a_stored_index_of_another_layout_is_not_used(spark, tmp_path):
    from twinaxis.scratch import read_text, write_text

    s = Session(spark, f"file://{tmp_path}/s", now=iter(range(1000, 1900)).__next__)
    s.run("ASSERT a note = 'red star' VALID FROM 100")
    s.close()
    s.reindex()
    at = f"file://{tmp_path}/s/index-1.json"
    assert s.index() is not None
    write_text(spark, at, read_text(spark, at).replace('"layout"', '"other"'))
    assert s.index() is None and s.run("SEARCH 'red' IN note LIMIT 5 AS OF 150").count() == 1


def test_facets_of_a_statement_and_shredded_subjects(spark):
    from twinaxis.erase import Keystore

    keys = Keystore(spark)
    s = Session(spark, now=iter(range(100, 900)).__next__, keys=keys)
    for name, kind, text in (("a", "rock", "red star"), ("b", "gas", "red giant"), ("c", "rock", "red red"), ("d", None, "red")):
        keys.allocate(name)
        s.run(f"ASSERT {name} note = '{text}' VALID FROM 0")
        if kind:
            s.run(f"ASSERT {name} class = {kind} VALID FROM 0")
    out = s.run("SEARCH 'red' IN note FACET BY class LIMIT 10")
    assert [r["subject"] for r in out.collect()] == ["c", "a", "b", "d"] and out.facets["class"].total == 4
    assert [tuple(r) for r in out.facets["class"].values.collect()] == [("rock", 2), ("gas", 1)]
    keys.shred("c")
    out = s.run("SEARCH 'red' IN note FACET BY class LIMIT 10")
    assert [r["subject"] for r in out.collect()] == ["a", "b", "d"] and out.facets["class"].total == 3
    assert [tuple(r) for r in s.facets("SEARCH 'red' IN note FACET BY class LIMIT 10")["class"].collect()] == [("gas", 1), ("rock", 1)]
    assert s.run("READ * FROM c").count() == 2  # facts of shredded subjects stay readable


def test_command(spark, tmp_path, capsys):
    from twinaxis.__main__ import main

    file = tmp_path / "s.tw"
    file.write_text("-- a comment\nASSERT p note = 'red star' VALID FROM 100\nASSERT p class = rock VALID FROM 100\nSELECT 1\n")
    assert main(["--file", str(file), "--clock", "1000", "--dir", f"file://{tmp_path}/leaf"], spark) == 0
    assert main(["SEARCH 'red' IN note FACET BY class LIMIT 3 AS OF 150", "--clock", "2000", "--dir", f"file://{tmp_path}/leaf"], spark) == 0
    out = capsys.readouterr().out
    assert "refused: ql: at byte 0" in out and "subject=p" in out and "class: 1 matched" in out and "rock: 1" in out
    assert main(["READ * FROM p AS OF 150", "--dir", f"file://{tmp_path}/leaf", "--tenant", "8"], spark) == 0
    assert "0 rows" in capsys.readouterr().out


def test_redelivery_changes_nothing(spark, tmp_path):
    from twinaxis.streaming.feed import PostingsIndex, deliver, published, tail

    log, base = f"file://{tmp_path}/log", f"file://{tmp_path}"
    rows = [fact(f"e{i}", "t", f"word{i} again", wall=i + 1, seq=1, order=i) for i in range(30)]
    index = PostingsIndex(spark, f"{base}/postings")
    index.consume(frame(spark, *rows[:10]), 0)
    index.consume(frame(spark, *rows[:10]), 0)  # the crash came before the cursor moved
    index.consume(frame(spark, *rows[8:20]), 1)  # some entries come again in another batch
    assert index.datoms().count() == 20 and index.cursor().wall == 20 and index.postings().count() == 40
    index.consume(frame(spark, *rows[20:], *rows[:3]), 2)
    assert index.datoms().count() == 30 and index.marks()[2] == (1, 30)
    index.consume(frame(spark, *rows).limit(0), 3)
    assert index.datoms().count() == 30
    frame(spark, *rows).coalesce(1).write.parquet(log)
    again = PostingsIndex(spark, f"{base}/again")

    def crash(batch, number):
        again.consume(batch, number)
        raise RuntimeError("after the sink, before the cursor")

    with pytest.raises(Exception, match="before the cursor"):
        deliver(tail(spark, log), crash, f"{base}/cursor")
    deliver(tail(spark, log), again.consume, f"{base}/cursor")
    assert again.datoms().count() == 30
    assert published(frame(spark, *rows), TxId(5)).count() == 4


def test_a_session_uses_its_stored_index(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/s", now=iter(range(1000, 1900)).__next__, tenant=3)
    s.run("WITH COMPRESSION none")
    assert s.store.compression == "uncompressed"
    for name, text in (("a", "red star"), ("b", "red red giant"), ("c", "blue")):
        s.run(f"ASSERT {name} note = '{text}' VALID FROM 100")
    s.close()
    query = "SEARCH 'red' IN note LIMIT 5 AS OF 150"
    plain = [tuple(r) for r in s.run(query).collect()]
    assert s.index() is None and [x[0] for x in plain] == ["b", "a"]
    s.reindex()
    assert s.index() is not None and [tuple(r) for r in s.run(query).collect()] == plain
    s.run("RETRACT b note = 'red red giant' VALID FROM 100")
    assert s.index() is None and [r["subject"] for r in s.run(query).collect()] == ["a"]
    s.close()
    assert s.index() is None
    s.reindex()
    assert s.index() is not None and [r["subject"] for r in s.run(query).collect()] == ["a"]
