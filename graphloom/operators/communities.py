"""Communities of weighted graphs by Louvain moves over the cluster (or, if asked for, in one task or by label propagation); cohesion and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

#: The least gain of a move, edges weighing 1 on average.
LEAST_GAIN = 1e-9


def louvain(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Community numbers of vertices 0..n-1 by greedy modularity, vertices in order, ties to the lowest number."""
    member = np.arange(n)
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight]).astype(float)
    while True:
        size = int(max(a.max(), b.max())) + 1 if len(a) else 0
        order = np.argsort(a, kind="stable")
        a, b, w = a[order], b[order], w[order]
        edge = np.searchsorted(a, np.arange(size + 1))
        degree = np.bincount(a, w, size)
        total, comm, inside = w.sum(), np.arange(size), degree.copy()
        moved_any, moving = False, True
        while moving:
            moving = False
            for v in range(size):
                links: dict[int, float] = {}
                for u, x in zip(b[edge[v] : edge[v + 1]].tolist(), w[edge[v] : edge[v + 1]].tolist()):
                    if u != v:
                        c = int(comm[u])
                        links[c] = links.get(c, 0.0) + x
                own = int(comm[v])
                inside[own] -= degree[v]
                gain = lambda c: links.get(c, 0.0) - inside[c] * degree[v] / total  # noqa: B023, E731
                best, top = own, gain(own)
                for c in sorted(links):
                    g = gain(c)
                    if g > top + 1e-12:
                        best, top = c, g
                inside[best] += degree[v]
                if best != own:
                    comm[v], moving, moved_any = best, True, True
        names, comm = np.unique(comm, return_inverse=True)
        member = comm[member]
        if not moved_any:
            return member
        key, where = np.unique(comm[a] * len(names) + comm[b], return_inverse=True)
        w = np.bincount(where, w)
        a, b = key // len(names), key % len(names)


def communities(edges: DataFrame, method: str | None = None, least: int = 2, rounds: int = 20) -> DataFrame:
    """``(id, community)`` of weighted edges (src, dst, weight); communities by size, then least member, from 0; those under ``least`` are left out.

    ``method``: 'distributed' (the default, at every size) is ``modular``;
    'louvain' moves vertices one by one in a single task, which must hold all
    edges (about 100 bytes each); 'propagation' spreads labels by weight for at
    most ``rounds``, even if some still move. Fewer than 3 vertices have none.
    """
    both = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
    both = materialize(both, "community-edges")
    kind = both.schema["a"].dataType.simpleString()
    if method == "louvain":

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]))
            if len(ids) < 3:
                return pd.DataFrame({"id": ids[:0], "raw": np.zeros(0, np.int64)})
            found = louvain(np.searchsorted(ids, pdf.a), np.searchsorted(ids, pdf.b), pdf.w.to_numpy(), len(ids))
            return pd.DataFrame({"id": ids, "raw": found.astype(np.int64)})

        raw = both.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(lambda pdf: group(pdf.sort_values(["a", "b"])), f"id {kind}, raw long")
    elif method == "propagation":
        raw = propagate(both, rounds)
    else:
        raw = modular(both)
    raw = materialize(raw, "communities")
    sizes = raw.groupBy("raw").agg(F.count("*").alias("size"), F.min("id").alias("first")).where(F.col("size") >= least)
    # one row a community; ranked by a window over these only
    named = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")).cast("long") - 1)
    return raw.join(named.select("raw", "community").hint("merge"), "raw").select("id", "community")


def modular(both: DataFrame) -> DataFrame:
    """Louvain over the cluster, until no move of a vertex to a neighbouring community raises modularity, level by level.

    In a round every vertex names its best move. A community takes vertices in
    or gives them off, as the better of its best moves says, and of those that
    fit both ends each is made if it gains even after all better ones into the
    same community and out of the same: so the moves of a round never lower
    modularity, and the best one of all is always made.

    Vertices carry their community's total, so that a round reads few tables.
    Its joins are merge joins: broadcasts would pass the graph through the driver
    anew in every round.
    """
    n, scale = both.agg(F.count("*"), F.sum("w")).first()
    ends = both.select(F.col("a").alias("id")).union(both.select("b")).distinct()
    member = materialize(ends.select("id", F.col("id").alias("raw")), "members")
    if member.limit(3).count() < 3:
        return member.where("false")
    weight = F.col("w") * F.lit(float(n / scale) if scale else 1.0)
    sym = materialize(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), weight.alias("w")).union(both.select("b", "a", weight)), "sym")
    total = F.lit(2.0 * n)
    first = F.struct(-F.col("gain"), F.col("id"))
    before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.desc("gain"), "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    while True:
        own = sym.groupBy("src").agg(F.sum("w").alias("k"))
        nodes, moved = materialize(own.select(F.col("src").alias("id"), "k", F.col("src").alias("c"), F.col("k").alias("tot")), "nodes"), False
        while True:
            near = nodes.select(F.col("id").alias("dst"), F.col("c").alias("to"), F.col("tot").alias("to_tot"))
            links = sym.where("src <> dst").join(near.hint("merge"), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("l"), F.max("to_tot").alias("to_tot"))
            rated = links.join(nodes.hint("merge"), "id").withColumn("worth", F.col("l") - F.col("k") * (F.col("to_tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total)
            unlinked = -F.col("k") * (F.col("tot") - F.col("k")) / total
            best = rated.groupBy("id").agg(F.first("k").alias("k"), F.first("c").alias("c"), F.first(unlinked).alias("unlinked"), F.max(F.when(F.col("to") == F.col("c"), F.col("worth"))).alias("stay"), F.min(F.when(F.col("to") != F.col("c"), F.struct(-F.round("worth", 9), "to"))).alias("go"))
            gain = F.round(-F.col("go").getField("col1") - F.coalesce("stay", "unlinked"), 9)
            moves = materialize(best.select("id", "k", "c", F.col("go.to").alias("to"), gain.alias("gain")).where(F.col("gain") > LEAST_GAIN), "moves")
            if moves.isEmpty():
                break
            off, into = moves.select(F.col("c").alias("at"), first.alias("off"), F.lit(None).alias("into")), moves.select(F.col("to").alias("at"), F.lit(None).alias("off"), first.alias("into"))
            ways = off.union(into).groupBy("at").agg(F.min("off").alias("off"), F.min("into").alias("into")).select("at", F.expr("off is not null and (into is null or off < into)").alias("gives"))
            gives, takes = ways.where("gives").select(F.col("at").alias("c")), ways.where("not gives").select(F.col("at").alias("to"))
            fit = moves.join(gives.hint("merge"), "c", "left_semi").join(takes.hint("merge"), "to", "left_semi")
            made = fit.select("id", "to", F.col("gain") - F.col("k") * (before("to") + before("c")) / total > LEAST_GAIN).toDF("id", "to", "made").where("made").select("id", "to")
            now = materialize(nodes.join(made.hint("merge"), "id", "left").select("id", "k", F.coalesce("to", "c").alias("c")), "nodes")
            nodes, moved = materialize(now.join(now.groupBy("c").agg(F.sum("k").alias("tot")).hint("merge"), "c").select("id", "k", "c", "tot"), "nodes"), True
        if not moved:
            return member
        member = materialize(member.join(nodes.select(F.col("id").alias("raw"), "c").hint("merge"), "raw").select("id", F.col("c").alias("raw")), "members")
        at = lambda end: nodes.select(F.col("id").alias(end), F.col("c").alias(f"{end}_c")).hint("merge")  # noqa: B023, E731
        sym = materialize(sym.join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")), "sym")


def propagate(both: DataFrame, rounds: int) -> DataFrame:
    """Each vertex takes the label of most weight around it, itself included with its strongest edge; ties to the least."""
    sym = materialize(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(both.select("b", "a", "w")), "sym")
    sym = sym.union(sym.groupBy("src").agg(F.max("w").alias("w")).select("src", F.col("src").alias("dst"), "w"))
    labels = sym.select(F.col("src").alias("id")).distinct().withColumn("raw", F.col("id"))
    for _ in range(rounds):
        votes = sym.join(labels.withColumnsRenamed({"id": "dst", "raw": "label"}).hint("merge"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        new = materialize(votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("raw")).withColumnRenamed("src", "id"), "labels")
        still = new.join(labels.withColumnRenamed("raw", "old").hint("merge"), "id").where("raw <> old").isEmpty()
        labels = new
        if still:
            break
    return labels


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``(community, size, inner, cohesion)``: inner edges, parallel ones counted, over n (n - 1)."""
    m = membership.select("id", "community")
    inner = edges.join(m.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(m.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner"))
    sizes = m.groupBy("community").agg(F.count("*").alias("size"))
    n = F.col("size")
    return sizes.join(inner, "community", "left").select("community", "size", F.coalesce("inner", F.lit(0)).alias("inner"), F.when(n > 1, F.coalesce("inner", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("cohesion"))


def community_labels(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(community, label)``: the two most common parent folders, joined by +, capitalised; Cluster if none."""
    folder = F.element_at(F.concat(F.array(F.lit("")), F.slice(F.split("file_path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("file_path", "/")) - 1))), -1)
    counted = membership.join(nodes.select("id", folder.alias("folder"), "ord"), "id").where("folder <> ''").groupBy("community", "folder").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "o", "folder"))).where("r <= 2")
    joined = top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "folder"))), lambda x: x["folder"]), "+").alias("l"))
    title = F.concat(F.upper(F.substring("l", 1, 1)), F.lower(F.expr("substring(l, 2)")))
    return membership.select("community").distinct().join(joined, "community", "left").select("community", F.coalesce(title, F.lit("Cluster")).alias("label"))
