"""Near-duplicate vectors and documents and line dedup against brute force, with the odd rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np

from twinaxis.llm.common import Scratch, components, np_components
from twinaxis.llm.cuckoo import CuckooFilter
from twinaxis.llm.embedding_dedup import near_duplicate_vectors, pass_count
from twinaxis.llm.line_dedup import LineIndex, dedup_lines, drop_lines
from twinaxis.llm.minhash_dedup import near_duplicate_documents


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    out = components(Scratch(spark, "t"), spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7))
    got = {r["id"]: r["component_id"] for r in out.collect()}
    want = classes({x for ab in links for x in ab}, links)
    assert got == {i: c for i, c in want.items() if any(i in ab and ab[0] != ab[1] for ab in links)}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0
    lab = np_components(5, np.array([4, 3]), np.array([3, 1]))
    assert lab.tolist() == [0, 1, 2, 1, 1]


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for size in [1] * 300 + [2] * 40 + [5] * 10 + [700]:
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((at * 3 + 1, (base * rng.uniform(0.5, 2) + rng.standard_normal(16) * 0.08).astype(np.float32).tolist(), 0))
            at += 1
    odd = [(-5, None, 0), (-6, [0.0] * 16, 0), (-7, [float("nan")] * 16, 0), (-8, [1.0, None], 1), (-9, [float("inf")] + [1.0] * 15, 0), (-10, [], 0), (None, [1.0] * 16, 0), (-11, [1.0, 2.0], 0), (-12, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").repartition(5)
    got = {r["vec_id"]: r for r in near_duplicate_vectors(spark, df, tile=256).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    lab = np_components(len(v), *np.nonzero(hit))
    ids = [r[0] for r in rows]
    assert [got[i]["n_links"] for i in ids] == hit.sum(1).tolist()
    assert [got[i]["component_id"] for i in ids] == [ids[x] for x in lab]
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)
    assert [got[i]["n_links"] for i in (-5, -6, -7, -8, -9, -10, None)] == [0] * 7 and got[-11]["component_id"] == got[-12]["component_id"] == -12
    assert near_duplicate_vectors(spark, df.limit(0)).count() == 0
    assert pass_count(10**9, 32, 0.95) > pass_count(10**5, 32, 0.95) > pass_count(10, 32, 0.95) == 1


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for size in [1] * 120 + [2] * 30 + [4] * 10 + [150]:
        base = rng.choices(vocabulary, k=rng.randrange(30, 160))
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    texts += [texts[0]] * 40 + [None, "", " \n ", "two words", "TWO words", "a b c d", " x y", "é É"]
    texts.append(" ".join(rng.choices(vocabulary, k=60_000)))
    rows = [(i * 2, t, "keys", 1) for i, t in enumerate(texts)] + [(None, texts[0], "k", 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string, k1 int").repartition(6)
    got = {r["doc_id"]: r for r in near_duplicate_documents(spark, df).collect()}
    sets = {i * 2: shingles(t) for i, t in enumerate(texts)}
    index = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            index[g].add(i)
    links = []
    for i, s in sets.items():
        for j in {j for g in s for j in index[g] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    want = classes(sets, links)
    assert {i: got[i]["component_id"] for i in sets} == want
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert near_duplicate_documents(spark, df.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 30_000, dtype=np.uint64)
    f = CuckooFilter(5000)  # three generations
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 0.002
    g = CuckooFilter.from_bytes(f.to_bytes())
    g.delete(keys[:20_000])
    assert g.contains(keys[20_000:]).all() and g.contains(keys[:20_000]).mean() < 0.005
    assert sum(int(np.count_nonzero(t)) for t in g.tables) == 10_000


STRIP = " \t\n\x0b\x0c\r"


def line_keys(text):
    return [x.strip(STRIP).encode().lower().decode() for x in (text or "").split("\n")]


def brute_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for k in line_keys(t):
            if i is not None and len(k) >= 10:
                held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, line_keys(t), strict=True) if i is None or len(k) < 10 or len(held[k]) < 2 or min(held[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(9)
    lines = [f"Line number {i} É" for i in range(60)] + ["short", "", "  padded line here\t", "PADDED LINE HERE", "ééééééééé", "éééééééééé", " not stripped text"]
    rows = [(rng.randrange(10_000), "\n".join(rng.choices(lines, k=rng.randrange(0, 8)))) for _ in range(200)]
    rows += [(rows[0][0], "Line number 1 É\nLine number 1 É"), (20_000, None), (20_001, ""), (None, "Line number 2 É"), (20_002, "\n\n")]
    return rows + [(30_000 + i, "the line of everyone\nline of %d alone" % i) for i in range(300)]


def test_lines_against_brute_force(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "x", b"k") for i, t in rows], "doc_id long, text string, n_lines string, key binary").repartition(5)
    out = dedup_lines(spark, df, LineIndex(spark, keys_per_shard=50))
    assert set(out.columns) == {"doc_id", "text", "key", "n_lines", "n_dropped"}
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_lines(rows)
    assert dedup_lines(spark, df.limit(0)).count() == 0


def test_lines_are_reversible(spark):
    rows = [(i, t) for i, t in line_rows() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = LineIndex(spark, keys_per_shard=60)
    cut = sorted(i for i, _ in rows)[len(rows) // 2]
    index.insert(df.where(f"doc_id < {cut}"))
    index.insert(df.where(f"doc_id >= {cut}"))
    whole = {bytes(r["key"]): (r["n_docs"], r["first_doc"]) for r in index.repeated().collect()}
    fresh = LineIndex(spark)
    fresh.insert(df)
    assert whole == {bytes(r["key"]): (r["n_docs"], r["first_doc"]) for r in fresh.repeated().collect()}
    index.delete(df.where("doc_id % 3 = 0").select("doc_id"))
    left = [(i, t) for i, t in rows if i % 3]
    kept = df.where("doc_id % 3 <> 0")
    out = drop_lines(kept, index.refs, index.repeated())
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_lines(left)
    # No false negatives are left behind by the deletions.
    for r in index.filters.collect():
        f = CuckooFilter.from_bytes(bytes(r["filter"]))
        keys = [bytes(k["key"]) for k in index.refs.select("key").distinct().where(index._shard() == r["shard"]).collect()]
        assert f.contains(np.array([np.frombuffer(k, np.uint64)[0] for k in keys], np.uint64)).all()


def test_pass_count_meets_its_bound():
    for rows in (10**4, 10**6, 10**8):
        hit = (1 - math.acos(0.95) / math.pi) ** math.log2(rows / 32)
        assert (1 - hit) ** pass_count(rows, 32, 0.95) <= 1.01e-4


def test_pairs_inside_a_template_family(spark):
    """Texts of one template lie below the similarity to each other; a few share more."""
    rng = random.Random(11)
    rows, want = [], {}
    for f, common in enumerate((150, 168)):
        template = " ".join(f"t{f}w{i}" for i in range(common))
        for k in range(700):
            i = f * 10_000 + k
            # With its partner, one text in twenty shares a run of its own words.
            pair = k // 20 * 20 if k % 20 < 2 else None
            own = [f"o{rng.random()}" for _ in range(200 - common)]
            if pair is not None:
                run = [f"s{f}p{pair}x{j}" for j in range(173 - common)]
                own[: len(run)] = run
            rows.append((i, template + " " + " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for f in (0, 1):
        part = [i for i in ids if i // 10_000 == f]
        for x, a in enumerate(part):
            for b in part[x + 1 :]:
                both = len(sets[a] & sets[b])
                if 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    assert len(links) == 70
    want = classes(ids, links)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicate_documents(spark, df).collect()}
    assert got == want


def test_vectors_of_a_dense_cone(spark):
    rng = np.random.default_rng(4)
    n, dim, near = 6000, 64, 0.955
    middle = np.eye(dim)[0]
    side = rng.standard_normal((n, dim))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    # Every fiftieth vector leans to the one before it.
    lean = (near - 0.86) / 0.14
    other = side[1::50] - (side[1::50] * side[0::50]).sum(1)[:, None] * side[0::50]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    side[1::50] = lean * side[0::50] + math.sqrt(1 - lean**2) * other
    v = (math.sqrt(0.86) * middle + math.sqrt(0.14) * side).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n + i, x.tolist()) for i, x in enumerate(rng.standard_normal((6000, dim)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(spark, df).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    assert len(a) >= 100
    lab = np_components(n, a, b)
    assert [got[i] for i in range(n)] == lab.tolist()


def test_vectors_across_partition_edges(spark):
    """Few vectors, a range partition for nearly each: no pair is lost at the edges."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 8))
    rows = [(i, (base[i // 2] + rng.standard_normal(8) * 0.05).astype(np.float32).tolist()) for i in range(24)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert got == {i: i // 2 * 2 for i in range(24)}


def test_line_shards_grow_and_open_again(spark, tmp_path):
    at = f"file://{tmp_path}/lines"
    index = LineIndex(spark, keys_per_shard=50, path=at)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = [(1, "the very first line"), (2, "the very first line\nand another line")]
    index.insert(frame(first))
    assert index.shards == 1
    more = [(10 + i, f"line of document {i}\nthe very first line\nshared line {i // 2}") for i in range(1500)]
    index.insert(frame(more))
    assert index.shards >= 32 and index.n_keys == 2 + 1500 + 750
    sizes = [sum(int(np.count_nonzero(t)) for t in CuckooFilter.from_bytes(bytes(r["filter"])).tables) for r in index.filters.collect()]
    assert len(sizes) == index.shards and sum(sizes) == index.n_keys and max(sizes) < 120
    again = LineIndex(spark, path=at)
    assert (again.shards, again.n_keys, again.keys_per_shard) == (index.shards, index.n_keys, 50)
    again.delete(frame(first).select("doc_id"))
    last = [(0, "the very first line\nnew line here")]
    again.insert(frame(last))
    rows = more + last
    whole = LineIndex(spark, path=at)
    out = drop_lines(frame(rows), whole.refs, whole.repeated())
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_lines(rows)
    assert LineIndex(spark).repeated().count() == 0


def test_lines_of_a_very_long_text(spark):
    rows = [(1, "a line that comes back\n" * 40_000 + "x" * 300_000), (2, "a line that comes back"), (3, "x" * 300_000 + "\nown")]
    out = dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect())
    assert got == brute_lines(rows)


def plain_vectors(rows, threshold=0.95):
    """(n_links, component_id) of each id by brute force; links between rows of one id do not count."""
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([r[0] for r in rows])
    a, b = np.nonzero((v @ v.T >= threshold) & (ids[:, None] != ids))
    n = Counter(ids[a].tolist())
    label = classes(set(ids.tolist()), {(int(ids[x]), int(ids[y])) for x, y in zip(a, b, strict=True)})
    return {i: (n[i], label[i]) for i in ids.tolist()}


def test_repeated_ids(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 8))
    rows = [(1, base[0].tolist()), (1, base[0].tolist()), (2, base[0].tolist()), (7, base[1].tolist()), (7, base[1].tolist()), (8, base[2].tolist()), (8, base[3].tolist()), (9, base[3].tolist())]
    rows += [(20 + i % 40, (base[4] + rng.standard_normal(8) * 0.1).tolist()) for i in range(90)]
    for tile in (512, 16):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = near_duplicate_vectors(spark, df, tile=tile).collect()
        want = plain_vectors(rows)
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((i, *want[i]) for i, _ in rows)
        assert want[1] == (2, 1) and want[2] == (2, 1) and want[7] == (0, 7)


def test_vectors_of_great_and_small_length(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [2.0, -1.0]), (5, [1e308, 1e308])]
    got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1 if 3 / math.sqrt(10) >= 0.95 else 5}
    assert near_duplicate_vectors(spark, spark.createDataFrame([(1, [3, 4]), (2, [6, 8])], "vec_id long, embedding array<int>")).first()["component_id"] == 1


def cone(rng, n, dim, mean, near, every=50):
    """Vectors of pairwise cosine about mean around one direction; every so many a pair at near."""
    side = rng.standard_normal((n, dim))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    lean = (near - mean) / (1 - mean)
    other = side[1::every] - (side[1::every] * side[0::every]).sum(1)[:, None] * side[0::every]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    side[1::every] = lean * side[0::every] + math.sqrt(1 - lean**2) * other
    return math.sqrt(mean) * np.eye(dim)[0] + math.sqrt(1 - mean) * side


def test_passes_around_means_find_the_pairs_of_cones(spark):
    """With exact comparison put off, centred passes alone find the pairs of two cones."""
    rng = np.random.default_rng(5)
    dim = 32
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    v = np.concatenate([cone(rng, 5000, dim, 0.75, 0.956), cone(rng, 5000, dim, 0.8, 0.956) @ turn]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), rows_a_pass=0).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    found = total = 0
    for at in (0, 5000):
        part = u[at : at + 5000]
        for a, b in zip(*np.nonzero(np.triu(part @ part.T >= 0.95, 1)), strict=True):
            total += 1
            found += got[at + int(a)] == got[at + int(b)]
    assert total >= 200 and found >= 0.99 * total


def test_dense_rows_are_compared_across_classes_only(spark):
    from twinaxis.llm import embedding_dedup as e

    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(6)[0] + rng.standard_normal(6) * 0.2).tolist(), 0 if i < 5000 else i) for i in range(5300)]
    scratch = Scratch(spark, "t")
    out = e.dense_links(scratch, spark.createDataFrame(rows, "vec_id long, embedding array<double>, class long").repartition(3), 0.95)
    links = [(r["a"], r["b"]) for r in out.collect()]
    inside = [(0, i) for i in range(1, 5000)]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.95
    hit[:5000, :5000] = False
    want = classes(range(5300), [*inside, *zip(*(x.tolist() for x in np.nonzero(np.triu(hit, 1))), strict=True)])
    assert classes(range(5300), [*inside, *links]) == want


def test_the_sketch_loses_hardly_a_pair():
    from twinaxis.llm import minhash_dedup as m

    below = sum(math.comb(128, k) * 0.875**k * 0.125 ** (128 - k) for k in range(m.LEAST_BITS))
    assert below < 1e-7
    rng = np.random.default_rng(1)
    lost = met = 0
    for _ in range(300):
        both, own = rng.integers(0, 1 << 63, 150, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        x, y = (m.minhash(np.concatenate([both, o])) for o in np.split(own, 2))
        bits = [(s * np.uint32(0x9E3779B1)) >> np.uint32(15) & np.uint32(1) for s in (x, y)]
        lost += int((bits[0] == bits[1]).sum()) < m.LEAST_BITS
        met += any((x[t * m.DEPTH : t * m.DEPTH + m.LEAST_DEPTH] == y[t * m.DEPTH : t * m.DEPTH + m.LEAST_DEPTH]).all() for t in range(m.TREES))
    assert lost == 0 and met >= 297


def test_repeated_ids_and_long_texts_among_documents(spark):
    base = " ".join(f"w{i}" for i in range(50_000))
    rows = [(5, base), (5, "quite another text of some words"), (6, base + " end"), (7, "quite another text of some words"), (5, base)]
    got = near_duplicate_documents(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(5, 2, 5), (5, 49_996, 5), (5, 49_996, 5), (6, 49_997, 5), (7, 2, 5)]
