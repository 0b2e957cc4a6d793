"""Graph operators over edge lists: degrees, components, reachability, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.util import pin


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest node.

    Alternating large and small stars: each round hangs every node on the least
    node it knows, so paths shrink geometrically and a hub never meets its
    neighbours in one task: minima are pre-aggregated and the joins may be split.
    Edges with a null end are ignored and self-loops only name their node.
    """
    raw = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    raw = pin(raw.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    loops = raw.where("u = v").select(F.col("u").alias("node"))
    now = raw.where("u > v")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pin(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).unionByName(loops).distinct()
    roots = roots.join(hung, "node", "left_anti").select("node", F.col("node").alias("component"))
    return hung.unionByName(roots)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in, instability) of edges (src, dst); instability is the outgoing share, four digits."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    return sums.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 4))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column node) that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def single_use(edges: DataFrame) -> DataFrame:
    """(node, user) of nodes with exactly one importer."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("user")).where("n = 1").select("node", "user")


def reachable(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, depth): nodes that edges reach from the seeds (column node), breadth first; each round joins the frontier only."""
    edges = pin(edges.select(F.col("src").alias("node"), "dst").distinct(), "arcs")
    seen = front = pin(seeds.select("node").distinct().select("node", F.lit(0).cast("long").alias("depth")), "front")
    for depth in range(1, max_rounds + 1):
        front = edges.join(front, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = pin(front.select("node", F.lit(depth).cast("long").alias("depth")), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError(f"more than {max_rounds} steps deep")


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, component, size) of strongly connected components of two nodes or more; self-loops are none.

    Colouring: every node takes the largest name that reaches it, and from each
    node that kept its own name those of its colour that lead to it are one
    component, found backwards. Found components leave, the rest goes on.
    """
    left = pin(edges.where("src != dst").select("src", "dst").distinct(), "arcs")
    found = None
    for _ in range(max_rounds):
        both = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))
        kept = pin(left.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi"), "trimmed")
        if kept.isEmpty():
            break
        if kept.count() < left.count():
            left = kept
            continue
        colour = pin(both.select("node", F.col("node").alias("c")), "colours")
        while True:
            new = kept.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("d"))
            new = pin(colour.join(new, "node", "left").select("node", F.greatest("c", F.coalesce("d", "c")).alias("c"), (F.coalesce("d", "c") > F.col("c")).alias("moved")), "colours")
            colour = new.select("node", "c")
            if new.where("moved").isEmpty():
                break
        inside = kept.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("e")), "dst").where("c = e")
        back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = c").select("node"))
        part = pin(back.join(colour, "node").select("node", "c"), "components")
        found = part if found is None else found.unionByName(part)
        done = part.select("node")
        left = pin(kept.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"), "arcs")
    if found is None:
        return edges.where("false").select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size"))
    sizes = found.groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "c").select("node", "component", "size")
