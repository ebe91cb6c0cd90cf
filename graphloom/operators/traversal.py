"""Traversals: frontiers of whole levels, never a query a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

MAX_DEPTH = 10


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    near, far = {"callees": ("src", "dst"), "callers": ("dst", "src")}[direction]
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), *[c for c in edges.columns if c not in ("src", "dst")])


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "callees", kinds: list[str] | None = None) -> DataFrame:
    """``(id, depth)``, or with ``kinds`` ``(id, depth, kind)``: all that ``starts`` (id) reaches in at most ``depth`` hops.

    Depth is the least number of hops, clamped to 10; starts are left out.
    ``kinds`` follows only edges whose ``kind`` is listed, and gives the least
    kind of the edges that reach a node first. An empty level ends the loop;
    each level is written to shared storage, so plans stay as small as one step.
    """
    steps = _oriented(edges, direction)
    extra = []
    if kinds is not None:
        steps, extra = steps.where(F.coalesce("kind", F.lit("direct")).isin(kinds)), [F.min("kind").alias("kind")]
    steps = steps.select("near", "far", *(["kind"] if extra else [])).where("near <> far")
    seen = starts.select("id").distinct()
    frontier, levels = seen, []
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        met = steps.join(frontier.select(F.col("id").alias("near")), "near").groupBy(F.col("far").alias("id")).agg(F.lit(d).alias("depth"), *extra)
        frontier = materialize(met.join(seen, "id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("id"))
    out = levels[0] if levels else frontier
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def shortest_path(edges: DataFrame, start, goal, max_hops: int = MAX_DEPTH) -> DataFrame:
    """``(hop, id)`` of a shortest path from ``start`` to ``goal`` over edges; no rows if none within ``max_hops``.

    Of several, each node's predecessor is the least.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    at = spark.createDataFrame([(start,)], f"id {kind.simpleString()}")
    reached = at.withColumn("depth", F.lit(0)).unionByName(bfs(edges, at, max_hops).select("id", "depth"))
    row = reached.where(F.col("id") == F.lit(goal)).select("depth").first()
    empty = spark.createDataFrame([], f"hop int, id {kind.simpleString()}")
    if row is None:
        return empty
    here, path = spark.createDataFrame([(row[0], goal)], f"hop int, id {kind.simpleString()}"), []
    path.append(here)
    for hop in range(row[0] - 1, -1, -1):
        before = reached.where(F.col("depth") == hop).select(F.col("id").alias("src"))
        here = edges.join(here.select(F.col("id").alias("dst")), "dst").join(before, "src").agg(F.min("src").alias("id")).select(F.lit(hop).alias("hop"), "id")
        here = materialize(here, "path")
        path.append(here)
    out = path[0]
    for p in path[1:]:
        out = out.unionByName(p)
    return out


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(id, component)`` of every vertex: the least member of its strongly connected component.

    Vertices on no cycle are peeled off; of the rest, each takes the least id
    that reaches it (forward colours, by repeated minima); those that reach
    their colour's root backwards are its component; and so on with the rest.
    """
    work = edges.select("src", "dst").where("src <> dst").distinct()
    everything = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    found: list[DataFrame] = []
    work = materialize(work, "scc")
    for _ in range(max_rounds):
        while True:  # trim what has no way in or no way out
            size = work.count()
            work = materialize(work.join(work.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(work.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "scc")
            if work.count() == size:
                break
        if not size:
            break
        colours = materialize(work.select(F.col("src").alias("id")).union(work.select(F.col("dst").alias("id"))).distinct().select("id", F.col("id").alias("colour")), "scc")
        while True:
            new = work.join(colours.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "colour").union(colours.select("id", "colour")).groupBy("id").agg(F.min("colour").alias("colour"))
            new = materialize(new, "scc")
            moved = not new.join(colours.withColumnRenamed("colour", "old"), "id").where("colour < old").isEmpty()
            colours = new
            if not moved:
                break
        inside = materialize(work.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")), "scc")
        back = materialize(colours.where("id = colour"), "scc")
        while True:
            more = inside.join(back.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour").distinct().join(back, "id", "left_anti")
            more = materialize(more, "scc")
            if more.isEmpty():
                break
            back = materialize(back.unionByName(more), "scc")
        found.append(back.select("id", F.col("colour").alias("component")))
        work = materialize(inside.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = everything.select("id", F.col("id").alias("component"))
    for f in found:
        out = out.join(f.withColumnRenamed("component", "c"), "id", "left").select("id", F.coalesce("c", "component").alias("component"))
    return out


def cycles(edges: DataFrame, least: int = 2) -> DataFrame:
    """``(component, size, members, severity)`` of strongly connected components of ``max(2, least)`` or more; 5 are CRITICAL."""
    groups = strong_components(edges).groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members"))
    return groups.where(F.col("size") >= max(2, least)).withColumn("severity", F.when(F.col("size") >= 5, "CRITICAL").otherwise("WARNING"))


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame, direction: str, rel_type: str | None = None) -> DataFrame:
    """Rows of ``nodes`` next to ``ids`` (id) by ``callees`` or ``callers`` direction, with the edge's confidence."""
    chosen = edges if rel_type is None else edges.where(F.col("rel_type") == rel_type)
    steps = _oriented(chosen, direction)
    return steps.join(ids.select(F.col("id").alias("near")), "near").select(F.col("near").alias("of"), F.col("far").alias("id"), "confidence").join(nodes, "id")


def degree_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, degree, size)``: base + min(60, 20 ln(degree + 1)), base 80 for classes and interfaces, else 50."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    base = F.when(F.col("label").isin("class", "interface"), 80.0).otherwise(50.0)
    return nodes.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (base + F.least(F.lit(60.0), F.log(F.coalesce("degree", F.lit(0)) + 1.0) * 20)).alias("size"))
