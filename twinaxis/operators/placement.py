"""Where leaves lie: weighted ranking, spreading over domains, tree distance, routes."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import TxId

MAX_HOPS = 8
#: Rows up to which a table of a deployment (machines, domains, nodes) goes to every task.
SMALL_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it is counted to be small; else Spark joins it like any other table."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def leaf_score(depth: Column, prefix: Column, name: Column, weight: Column) -> Column:
    """The first 48 bits of SHA-256 of depth byte, leaf prefix and target name, times the weight."""
    raw = F.concat(F.unhex(F.lpad(F.hex(depth), 2, "0")), prefix, name.cast("binary"))
    top = F.conv(F.substring(F.sha2(raw, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.when(weight > 0, top * weight.cast("decimal(18,0)")).otherwise(F.lit(0)).cast("decimal(38,0)")


def rank_targets(leaves: DataFrame, targets: DataFrame) -> DataFrame:
    """(depth, prefix, name, score, rank): all targets of each leaf, best first, names deciding ties.

    targets (name, weight) are the machines of a deployment: one row holds them
    all, refused beyond SMALL_ROWS, and is set beside each leaf.
    """
    if targets.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        raise ValueError(f"a deployment of over {SMALL_ROWS} targets cannot be ranked for each leaf")
    whole = targets.agg(F.collect_list(F.struct("name", "weight")).alias("targets"))
    both = leaves.select("depth", "prefix").crossJoin(F.broadcast(whole)).select("depth", "prefix", F.inline("targets"))
    scored = both.select("depth", "prefix", "name", leaf_score(F.col("depth"), F.col("prefix"), F.col("name"), F.col("weight")).alias("score"))
    w = Window.partitionBy("depth", "prefix").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(w))


def spread(ranked: DataFrame, domains: DataFrame, copies: int) -> DataFrame:
    """The first copies of a leaf taken round by round over distinct domains (name, domain)."""
    x = ranked.join(_small(domains), "name")
    own = Window.partitionBy("depth", "prefix", "domain").orderBy("rank")
    x = x.withColumn("round", F.row_number().over(own))
    order = Window.partitionBy("depth", "prefix").orderBy("round", "rank")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= copies)


def nearest(places: DataFrame, nodes: DataFrame, origin: str) -> DataFrame:
    """places (depth, prefix, name, place) with near: the order in which a reader at origin asks.

    By distance in the topology (nodes), place deciding ties; a place that the
    topology lacks, and all of them for an unknown origin, come last but stay.
    """
    names = places.select(F.col("name").alias("b")).distinct()
    far = distances(nodes, names.select(F.lit(origin).alias("a"), "b")).select(F.col("b").alias("name"), "distance")
    levels = nodes.agg(F.max("levels").alias("n")).first()["n"] or 0
    x = places.join(far, "name", "left").withColumn("distance", F.coalesce("distance", F.lit(levels + 1)))
    w = Window.partitionBy("depth", "prefix").orderBy("distance", "place")
    return x.withColumn("near", F.row_number().over(w))


FIELDS = {"version", "generation", "depth", "levels", "root"}
NODE_FIELDS = {"name", "level", "weight", "children"}


#: Bytes of a transaction id in a topology file: wall clock, logical clock, leaf prefix, its depth, sequence.
GENERATION = struct.Struct(">QI32sBI")


def generation_of(topology: dict) -> TxId | None:
    """The transaction id that tells one edition of a topology from another; read, never made up."""
    text = topology.get("generation", "")
    if not text:
        return None
    try:
        wall, logical, prefix, depth, seq = GENERATION.unpack(bytes.fromhex(text))
    except (ValueError, struct.error) as e:
        raise ValueError(f"generation {text!r} is no encoded transaction id") from e
    if depth > len(prefix):
        raise ValueError(f"generation {text!r} has a leaf depth over {len(prefix)}")
    out = TxId(wall, logical, prefix[:depth], depth, seq)
    if out == TxId(0):
        raise ValueError("the zero id stands for no generation and cannot be written")
    return out


def require_generation(topology: dict) -> TxId:
    """The generation; placement by a topology without one is refused."""
    out = generation_of(topology)
    if out is None:
        raise ValueError("a topology without a generation cannot place anything")
    return out


def nested_set(topology: dict) -> Iterator[tuple[str, str, int, int, int, int, int, list[tuple[int, str]]]]:
    """(name, level, level_index, lft, rgt, weight, depth, above) of a topology tree read from JSON; above has the
    level and name of all nodes from the root to the node itself."""
    if more := set(topology) - FIELDS:
        raise ValueError(f"unknown fields {sorted(more)}")
    generation_of(topology)
    levels = topology["levels"]
    if topology.get("version", 1) != 1:
        raise ValueError(f"version {topology['version']} is not known")
    if len(set(levels)) != len(levels) or not 1 <= topology.get("depth", 1) <= 32:
        raise ValueError("levels repeat, or the leaf depth is not within 1 to 32")
    seen: set[str] = set()
    count = 0
    out = []

    def visit(node: dict, above: int, way: list[tuple[int, str]]) -> int:
        nonlocal count
        if more := set(node) - NODE_FIELDS:
            raise ValueError(f"unknown fields {sorted(more)}")
        if node["level"] not in levels or levels.index(node["level"]) <= above:
            raise ValueError(f"{node['name']}: level {node['level']} does not lie below its parent's")
        if not node["name"] or node["name"] in seen:
            raise ValueError(f"the name {node['name']!r} is empty or taken")
        seen.add(node["name"])
        index, count = levels.index(node["level"]), count + 1
        left, children = count, node.get("children", [])
        way = [*way, (index, node["name"])]
        below = sum([visit(child, index, way) for child in children])
        weight = node.get("weight", below if children else 1)
        if weight < 0:
            raise ValueError(f"{node['name']}: the weight is negative")
        count += 1
        out.append((node["name"], node["level"], index, left, count, weight, len(levels), way))
        return weight

    visit(topology["root"], -1, [])
    yield from sorted(out, key=lambda r: r[3])


def load_topology(spark: SparkSession, path: str) -> DataFrame:
    """A topology file (JSON) as its nested set."""
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(list(nested_set(json.loads(text))), TOPOLOGY)


TOPOLOGY = "name string, level string, level_index int, lft int, rgt int, weight long, levels int, above array<struct<level: int, name: string>>"


def distances(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor, distance): levels from the deeper node up to the lowest common ancestor."""
    n = _small(nodes.select("name", "level_index", "above"))
    x = pairs.join(n.toDF("a", "ia", "pa"), "a").join(n.toDF("b", "ib", "pb"), "b")
    x = x.withColumn("c", F.element_at(F.array_intersect("pa", "pb"), -1))
    return x.select("a", "b", F.col("c.name").alias("ancestor"), (F.greatest("ia", "ib") - F.col("c.level")).alias("distance"))


def ancestors(nodes: DataFrame, level: str) -> DataFrame:
    """(name, ancestor): each node's ancestor at a level."""
    own = nodes.where(F.col("level") == level).select(F.col("level_index").alias("i")).first()
    if own is None:
        return nodes.select("name", F.lit(None).cast("string").alias("ancestor")).limit(0)
    up = F.filter("above", lambda x: x["level"] == own["i"])
    return nodes.select("name", F.get(up, 0)["name"].alias("ancestor")).where("ancestor is not null")


def route(keys: DataFrame, routes: DataFrame) -> DataFrame:
    """(key, depth, node): the route with the longest prefix of each key.

    One equi-join a depth that occurs; depths are at most 32.
    """
    depths = [r["depth"] for r in routes.select("depth").distinct().orderBy("depth").collect()]
    out = None
    for d in depths:
        own = routes.where(F.col("depth") == d).select("prefix", "depth", "node")
        hit = keys.select("key").withColumn("prefix", F.expr(f"substring(key, 1, {int(d)})")).join(own, "prefix").select("key", "depth", "node")
        out = hit if out is None else out.union(hit)
    if out is None:
        return keys.select("key", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("node")).limit(0)
    best = out.groupBy("key").agg(F.max(F.struct("depth", "node")).alias("m"))
    return best.select("key", "m.depth", "m.node")


def aggregate_routes(routes: DataFrame) -> DataFrame:
    """Routes (prefix, depth, node) with every 256 agreeing siblings replaced by their parent, once."""
    up = routes.where("depth > 1").withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
    full = up.groupBy("parent", "depth").agg(F.count_distinct("prefix").alias("n"), F.min("node").alias("node"), F.max("node").alias("last")).where("n = 256 and node = last")
    full = full.select("parent", "depth", "node")
    rest = up.join(full.select("parent", "depth"), ["parent", "depth"], "left_anti").select("prefix", "depth", "node").union(routes.where("depth <= 1").select("prefix", "depth", "node"))
    return rest.union(full.select("parent", (F.col("depth") - 1).cast("int"), "node"))


def follow(start: str, ask, max_hops: int = MAX_HOPS) -> str:
    """The node that answers: ask(node) gives None, or (epoch, node) to go to; epochs must not fall."""
    node, epoch = start, -1
    for _ in range(max_hops + 1):
        answer = ask(node)
        if answer is None:
            return node
        if answer[0] < epoch:
            raise ValueError(f"{node} redirects by epoch {answer[0]} after {epoch}")
        epoch, node = answer
    raise ValueError(f"more than {max_hops} redirects")
