"""Packing, sharding and the pipeline."""

import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from twinaxis.llm.packing import deal, default_tokenizer, pack
from twinaxis.llm.sharding import CommitConflict, ShardStore, shard_documents
from twinaxis.llm.word_bpe import WordBpe

TEXTS = [
    "Hello, world! It's 12 o'clock; don't panic...",
    "",
    "  \n\t ",
    "é É ß ŒUVRE œ ªº ²³ ½ naïve café",
    "ΣΑΣ Σ İstanbul",
    "a<|endoftext|>b <|startoftext|>",
    "emoji 😀 中文 кириллица é",
    "x y z\x1cw\x85v",
    "don’t “quote” – dash…",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
    "'s 't 're 've 'm 'll 'd I'LL",
    "!!??,,..--__ @#$%^&*()",
    "word " * 3000,
    "ĿŀŉǅƏ ɏ ʰ",
]


def test_ids_equal_the_library():
    bpe = WordBpe(default_tokenizer())
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüéèçñ  ,.'\n0123456789", k=rng.randrange(1, 300))) for _ in range(200)]
    for _ in range(2):  # the second time from the tables
        got = bpe.encode_batch(texts)
        for t, g in zip(texts, got, strict=True):
            assert np.frombuffer(g, "<u4").tolist() == bpe.whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(4))
def test_dealing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 513, [1, 5, 300, 768][seed])
    at = deal(sizes, 2048)
    load = np.bincount(at, sizes)
    assert load.max() <= 2048 and load.min() > 0 and len(at) == len(sizes)
    if len(sizes) > 100:
        assert load.sum() / (2048 * len(load)) > 0.97


def test_packing_is_a_partition_of_the_ids(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id"), (77, None), (78, "long " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, start string").repartition(3)
    out = [r for r in pack(docs).collect()]
    whole = WordBpe(default_tokenizer()).whole
    want = sorted((repr(i), tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    parts = {}
    for r in out:
        ids = tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())
        assert 0 < len(ids) <= 2048
        parts.setdefault((repr(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], ids))
    got = []
    for (i, n), pieces in parts.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(np.cumsum([0, *(len(p[1]) for p in pieces)])[:-1]) or i == "3"
        whole_ids = tuple(x for _, p in pieces for x in p)
        if len(whole_ids) == n:
            got.append((i, whole_ids))
    assert sorted(got) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *(n for _, n in s)])[:-1]) and sum(n for _, n in s) <= 2048
    assert pack(docs.limit(0)).count() == 0


def test_shards_round_trip(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("file", F.lit("x")).withColumn("tier", F.lit(None).cast("int"))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).select(*[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]))
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=150_000, least_bytes=10_000, ratio=4, fan_in=3)
    for part in docs.randomSplit([1.0] * 9, 5):
        store.append(part.coalesce(1))
    before = store.manifest()
    n_before, version = before.count(), store.version()
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(*docs.columns).collect())
    assert n_before == 9 and rows(store.read()) == rows(docs)
    assert store.compact() > version and store.manifest().count() < 9 and rows(store.read()) == rows(docs)
    assert rows(store.read(version)) == rows(docs)  # an older version stays readable
    tiers = store.manifest().where("bytes < 150000 and tier < 1000").groupBy("tier").count().where("count >= 3")
    assert tiers.isEmpty() and store.compact() == store.version()
    with pytest.raises(CommitConflict):
        store._commit(version - 1, before)
    store.vacuum(1, 0)
    assert rows(store.read()) == rows(docs)


def test_sharding_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(6)
    out = shard_documents(ShardStore(spark, f"file://{tmp_path}/a"), docs)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    sizes = out.groupBy("shard", "shard_rows").count().collect()
    assert all(r["shard_rows"] == r["count"] for r in sizes) and len(sizes) < 6
    assert shard_documents(ShardStore(spark, f"file://{tmp_path}/b"), docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r["doc_id"]: r for r in now.collect()}
        at = f"file://{tmp_path}/{k}"
        stage(spark, now, DATA).write.parquet(at)
        out = spark.read.parquet(at)
        if name == "packing":
            pieces = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
            assert {r["doc_id"] for r in pieces} == set(before) and all(r["n"] == r["t"] for r in pieces)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before)
            assert all(set((after[i]["text"]).split("\n")) <= set(before[i]["text"].split("\n")) or after[i]["text"] == "" for i in after)
        else:
            assert all(after[i] == before[i] for i in after)
        now = out
    whole = p.run(spark, DATA)
    assert {(r["doc_id"], r["doc_tokens"]) for r in whole.collect()} == {(r["doc_id"], r["t"]) for r in pieces}


def test_appends_with_different_columns(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    for i in range(2):
        store.append(spark.createDataFrame([(i, f"a{i}")], "doc_id long, text string").coalesce(1))
        store.append(spark.createDataFrame([(10 + i, f"b{i}", f"x{i}")], "doc_id long, text string, extra string").coalesce(1))
    want = [(0, "a0", None), (1, "a1", None), (10, "b0", "x0"), (11, "b1", "x1")]
    assert sorted(map(tuple, store.read().select("doc_id", "text", "extra").collect())) == want
    store.compact()
    store.vacuum(1, 0)
    assert store.manifest().count() == 1
    assert sorted(map(tuple, store.read().select("doc_id", "text", "extra").collect())) == want


def test_vacuum_harms_no_append_and_no_reader(spark, tmp_path):
    one = lambda i: spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1)
    a, b = (ShardStore(spark, f"file://{tmp_path}/s", fan_in=3) for _ in range(2))
    for i in range(3):
        a.append(one(i))
    old = a.read()
    # A writer that has written its files and not committed yet.
    with b._staged(b.version()) as name:
        folder = f"{b.path}/data/{name}"
        one(100).write.parquet(folder)
        a.compact()
        a.vacuum(1, 0)
        b._commit(b.version(), b._written(folder, b.version() + 1))
    assert sorted(r["doc_id"] for r in a.read().collect()) == [0, 1, 2, 100]
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST"):
        old.collect()  # without a grace readers of old versions lose their files
    for i in range(3, 6):
        a.append(one(i))
    old = a.read()
    a.compact()
    a.vacuum()
    assert sorted(r["doc_id"] for r in old.collect()) == [0, 1, 2, 3, 4, 5, 100]


def test_manifests_of_many_versions(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=4)
    for i in range(20):
        store.append(spark.createDataFrame([(i, "x" * 100)], "doc_id long, text string").coalesce(1))
    assert store.manifest().count() == 20 and store.manifest(15).count() == 15 and store.manifest(16).count() == 16
    sizes = [store.spark.read.parquet(f"{store.path}/manifest/v{v}").count() for v in (15, 16, 17)]
    assert sizes == [1, 16, 1]
    store.compact()
    store.vacuum(1, 0)
    assert store.manifest().count() < 4 and sorted(r["doc_id"] for r in store.read().collect()) == list(range(20))


def plain_leaks(texts, items):
    """Documents that hold an item by the stated rule, counted window by window."""
    from collections import Counter
    from math import log1p

    from test_text import norm

    from twinaxis.llm import decontaminate as d

    items = [(i, t) for i, t in sorted({(i, t) for i, t in items if i is not None and t}) if norm(t)]
    n, mean = len(items), sum(len(norm(t)) for _, t in items) / max(1, len(items))
    df = Counter(w for _, t in items for w in set(norm(t)))
    out = set()
    for k, text in enumerate(texts):
        w = norm(text or "")
        for _, t in items:
            x = norm(t)
            weight = {v: log1p((n - df[v] + 0.5) / (df[v] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for v, c in Counter(x).items()}
            whole, step = sum(weight.values()), max(32, 1 << (len(x) - 1).bit_length())
            q, a = (norm(part) for part in d.split_item(t))
            g = min(5, len(q))
            parts = {tuple(q[i : i + g]) for i in range(len(q) - g + 1)}
            for at in range(0, len(w), step):
                inside = w[at : at + 2 * step]
                if sum(weight.get(v, 0) for v in set(inside)) < 0.5 * whole:
                    continue
                held = {tuple(inside[i : i + g]) for i in range(len(inside) - g + 1)}
                if len(parts & held) >= 0.75 * len(parts) and len(set(a) & set(inside)) >= 0.75 * len(set(a)):
                    out.add(k)
    return out


def odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").first()["text"]
    long_ = " ".join(f"word{i}" for i in range(30_000))
    more = [(None, "a text without an id of some words", None, None, None), (9_000_001, None, None, None, None), (9_000_002, "", "en", "s", 0)]
    more += [(9_000_003, long_, "en", "s", 1), (9_000_004, long_ + " end", "en", "s", 1), (9_000_005, "before it\n" + item + "\nafter it all", "en", "s", 1)]
    # One id with an equal text twice, a copy of an earlier document, a leak and a text of its own.
    more += [(9_000_006, x, "en", "s", 1) for x in ("quite some words that stand alone here", "quite some words that stand alone here", long_, item, "another text, its very own words")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines string, keys string"
    return spark.createDataFrame([(*r, 0.25, "kept", "k") for r in rows + more], schema)


def test_every_stage_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline as p
    from test_dedup import classes, line_keys, shingles
    from test_text import plain_score

    from twinaxis.llm import toxicity

    odd_documents(spark).repartition(3).write.parquet(f"file://{tmp_path}/0")
    now = spark.read.parquet(f"file://{tmp_path}/0")
    stages = dict(p.STAGES)

    def after(name):
        nonlocal now
        before = [tuple(r) for r in now.collect()]
        stages[name](spark, now, DATA).write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        return before, [tuple(r) for r in now.collect()]

    same = lambda x: sorted(map(repr, x))
    fit, toxicity.fit = toxicity.fit, lambda *a, **k: models.append(fit(*a, **k)) or models[-1]
    models = []
    try:
        before, got = after("toxicity")
    finally:
        toxicity.fit = fit
    want = [r for r in before if plain_score(r[1], models[0]) < 0.5]
    assert same(got) == same(want) and now.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_lines", "keys"]

    before, got = after("line_dedup")
    first = {}
    for r in before:
        for k in set(line_keys(r[1])) if r[0] is not None else ():
            if len(k) >= 10:
                first[k] = (min(first.get(k, (r[0],))[0], r[0]), first.get(k, (0, set()))[1] | {r[0]})
    want = []
    for r in before:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, line_keys(r[1]), strict=True) if r[0] is None or k not in first or len(first[k][1]) < 2 or first[k][0] == r[0]]
        text = "\n".join(kept)
        want.append((r[0], text, *r[2:4], len(text) if len(kept) < len(lines) else r[4], *r[5:]))
    assert same(got) == same(want)

    before, got = after("minhash_dedup")
    sets = [shingles(r[1]) for r in before]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and before[i][0] is not None and before[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    label = classes(range(len(sets)), links)
    least = {}
    for i, r in enumerate(before):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    want, seen = [], set()
    for i, r in enumerate(before):
        words = tuple((r[1] or "").lower().split())
        if r[0] is None or not sets[i]:
            want.append(r)
        elif least[label[i]] == r[0] and (r[0], words) not in seen:
            seen.add((r[0], words))
            want.append(r)
    assert same(got) == same(want)

    before, got = after("decontaminate")
    leaks = plain_leaks([r[1] for r in before], [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()])
    assert leaks and same(got) == same([r for k, r in enumerate(before) if k not in leaks])

    before, _ = after("packing")
    whole = WordBpe(default_tokenizer()).whole
    tokens = {}
    for r in before:
        tokens.setdefault(r[0], []).append(len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    pieces = now.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: sum(n) for i, n in tokens.items()}
    run = now.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert run.where("n > 2048 or n <> end").isEmpty()


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, DATA).count() == 0
    bare = spark.createDataFrame([(1, "some text of a few words here")], "doc_id long, text string")
    for name, stage in p.STAGES[:4]:
        assert [tuple(r) for r in stage(spark, bare, DATA).collect()] == [(1, "some text of a few words here")], name
