"""Execution flows: entry points, bounded traces, greedy de-duplication, kinds and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

#: Fixed values.
ENTRY_NAMES = ["main", "cli", "run", "app", "handler", "entrypoint"]
ENTRY_FILES = ["__main__.py", "cli.py", "main.py", "app.py", "manage.py", "wsgi.py", "asgi.py", "conftest.py"]
DECORATOR_MARKS = ["@app.route", "@router", "@click.command"]
SCRIPT_ENTRY_FILES = [
    "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "main.js", "app.ts", "app.tsx", "app.js", "server.ts", "server.js", "handler.ts", "handler.js", "route.ts", "route.tsx", "page.tsx", "page.ts", "layout.tsx",
    "layout.ts",
]
FLOW_SIZE = 25
#: Selection of flows: how many of the open ones through a node a round compares, and open flows a task.
FIRST = 8
FLOWS_A_TASK = 5000


def _ends(col, suffixes):
    out = F.lit(False)
    for s in suffixes:
        out = out | col.endswith(s)
    return out


def entry_points(nodes: DataFrame) -> DataFrame:
    """Functions and methods where execution starts: framework patterns, exports, names and files."""
    name, path, content, language = F.col("name"), F.col("file_path"), F.coalesce("content", F.lit("")), F.lower(F.coalesce("language", F.lit("")))
    marked = F.lit(False)
    for m in DECORATOR_MARKS:
        marked = marked | content.contains(m)
    migration = name.isin("upgrade", "downgrade") & (path.contains("/migrations/versions/") | path.contains("/alembic/versions/"))
    python = (language.isin("python", "py", "") | path.endswith(".py")) & (name.startswith("test_") | (name == "main") | marked | migration)
    script = (language.isin("typescript", "ts", "") | _ends(path, [".ts", ".tsx"])) & (name.isin("handler", "middleware") | (F.col("is_exported") & _ends(path, SCRIPT_ENTRY_FILES)))
    entry = python | script | F.col("is_exported") | name.isin(ENTRY_NAMES) | ((F.col("label") == "function") & _ends(path, ENTRY_FILES))
    return nodes.where(F.col("label").isin("function", "method")).where(entry)


def trace_flows(edges: DataFrame, entries: DataFrame, depth: int = 6, branching: int = 3, most: int = FLOW_SIZE) -> DataFrame:
    """``(entry, steps)``: what each entry (id) reaches breadth-first, the entry first.

    Each node adds at most ``branching`` targets not seen yet, by confidence,
    then ``ord`` of the edge (a column, or the target); a flow ends at ``most``
    nodes. Level by level for all flows at once: a flow is one row of bounded
    arrays, and each level is two shuffles. A node's best ``most + branching``
    targets suffice, as no more than ``most`` can be seen already.
    """
    order = F.col("ord") if "ord" in edges.columns else F.col("dst")
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), order, "dst")
    best = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), *([F.min("ord").alias("ord")] if "ord" in edges.columns else []))
    ranked = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + branching)
    targets = ranked.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "dst"))), lambda x: x["dst"]).alias("targets"))
    targets = materialize(targets, "flow-targets")
    flows = entries.select(F.col("id").alias("entry")).distinct().select("entry", F.array("entry").alias("steps"), F.array("entry").alias("frontier"))
    for _ in range(depth):
        asked = flows.select("entry", F.posexplode("frontier").alias("p", "src")).join(targets, "src").groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "targets"))), lambda x: x["targets"]).alias("lists"))
        add = lambda acc, t: F.concat(acc, F.slice(F.array_except(t, acc), 1, F.greatest(F.lit(0), F.least(F.lit(branching), F.lit(most) - F.size(acc)))))
        grown = flows.join(asked, "entry", "left").withColumn("grown", F.when(F.col("lists").isNull(), F.col("steps")).otherwise(F.aggregate("lists", F.col("steps"), add)))
        flows = materialize(grown.select("entry", F.col("grown").alias("steps"), F.slice("grown", F.size("steps") + 1, F.lit(most)).alias("frontier")), "flow-level")
    return flows.select("entry", "steps")


def dedup_flows(flows: DataFrame, overlap: float = 0.5, max_rounds: int = 1000) -> DataFrame:
    """The flows that greedy selection keeps: longest first (then ``entry``), one that shares more than ``overlap`` of the shorter with a kept one is dropped; then single steps go.

    Rounds reach the sequential result without a table of all pairs. Of two
    flows in conflict the later is the shorter, and any ``need`` of its nodes
    hold one of the earlier. So a flow that is among the ``FIRST`` earliest open
    ones at ``need`` of its nodes meets all its open earlier rivals there, and is
    kept if it has none; the earliest flow always is such a one. Open flows
    that conflict with those newly kept meet them at their ``need`` least used
    nodes, and are dropped. Both are checked on the whole flows.
    """
    sized = materialize(flows.select("entry", "steps", F.size("steps").alias("n")).where("n > 1"), "flows")
    steps = sized.select("entry", "n", F.explode(F.array_distinct("steps")).alias("node")).where("node is not null")
    used = steps.groupBy("node").agg(F.count("*").alias("used"))
    nodes = steps.join(used.hint("merge"), "node").groupBy("entry", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("used", "node"))), lambda x: x["node"]).alias("nodes"))
    need = F.least(F.size(F.filter(F.sequence(F.lit(1), "n"), lambda c: c / F.col("n") > overlap)), F.size("nodes"))
    state = materialize(nodes.withColumn("need", need), "flow-state")
    conflict = F.size(F.array_intersect("nodes", "rival_nodes")) / F.col("n") > overlap
    dropped: list[DataFrame] = []
    for _ in range(max_rounds):
        left = state.count()
        if not left:
            break
        parts = 1 + left // FLOWS_A_TASK  # fixed, as each flow becomes many rows
        open_ = state.repartition(parts, "entry")
        turn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "entry"))
        first = open_.select("entry", "n", F.explode("nodes").alias("node")).withColumn("r", turn).where(F.col("r") <= FIRST)
        first = materialize(first.select("entry", "node", "r"), "flow-first")
        at = first.groupBy("entry").agg(F.count("*").alias("at"))
        leading = materialize(open_.join(at.hint("merge"), "entry").where("at >= need"), "flow-leading")
        # at its other nodes a leading flow can't share more than these hold
        late = first.repartition(parts, "node").select("entry", "node", "r")
        early = first.repartition(parts, "node").select(F.col("entry").alias("rival"), "node", F.col("r").alias("rival_r"))
        met = late.join(early.hint("merge"), "node").where("rival_r < r").groupBy("entry", "rival").agg(F.count("*").alias("c"))
        met = met.join(leading.hint("merge"), "entry").where("c > at - need").select("entry", "n", "nodes", "rival")
        blocked = met.join(state.select(F.col("entry").alias("rival"), F.col("nodes").alias("rival_nodes")).hint("merge"), "rival").where(conflict).select("entry")
        keep = materialize(leading.join(blocked.hint("merge"), "entry", "left_anti").select("entry", "nodes"), "flow-kept")
        rest = open_.join(keep.select("entry").hint("merge"), "entry", "left_anti")
        probes = rest.select("entry", "n", "nodes", F.explode(F.slice("nodes", F.lit(1), F.col("need"))).alias("node"))
        kept_at = keep.select(F.explode("nodes").alias("rival_node"), F.col("nodes").alias("rival_nodes"))
        dropped.append(materialize(probes.join(kept_at.hint("merge"), (F.col("node") == F.col("rival_node")) & conflict, "left_semi").select("entry").distinct(), "flow-dropped"))
        state = materialize(rest.join(dropped[-1].hint("merge"), "entry", "left_anti"), "flow-state")
        if len(dropped) == 20:
            dropped = [materialize(reduce(DataFrame.union, dropped), "flow-dropped")]
    else:
        raise RuntimeError(f"flows did not settle in {max_rounds} rounds")
    if dropped:
        sized = sized.join(reduce(DataFrame.union, dropped).hint("merge"), "entry", "left_anti")
    return sized.select("entry", "steps")


def flow_kinds(flows: DataFrame, nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """``(entry, step_count, label, kind)``: the first four names, and whether the steps' communities are none, one or several."""
    steps = flows.select("entry", F.posexplode("steps").alias("n", "id"))
    named = steps.join(nodes.select("id", "name"), "id", "left").join(communities.select("id", "community"), "id", "left")
    out = named.groupBy("entry").agg(F.count("*").alias("step_count"), F.transform(F.slice(F.sort_array(F.collect_list(F.struct("n", "name"))), 1, 4), lambda x: x["name"]).alias("names"), F.count_distinct("community").alias("c"))
    kind = F.when(F.col("c") == 0, "unknown").when(F.col("c") == 1, "intra_community").otherwise("cross_community")
    return out.select("entry", "step_count", F.array_join("names", " → ").alias("label"), kind.alias("kind"))


def process_rows(flows: DataFrame) -> DataFrame:
    """``step_in_process`` edges (src, dst, step_number), steps numbered from 0."""
    return flows.select(F.posexplode("steps").alias("step_number", "src"), F.concat(F.lit("process:"), F.col("entry").cast("string")).alias("dst")).select("src", "dst", F.col("step_number").cast("long"))
