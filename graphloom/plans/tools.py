"""The named analytic queries over one graph, each a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import analysis, coupling, intervals, search, traversal
from graphloom.operators.dead_code import is_test_file
from graphloom.sources.storage import GraphStore

from .cypher import cypher

#: Dispatch kinds of asynchronous calls.
ASYNC_KINDS = ["thread_executor", "process_executor", "detached_task", "enqueued_job", "callback_registry"]
MEMBER_LABELS = ["enum_member", "class_attribute", "module_constant"]


class GraphTools:
    """``nodes`` and ``edges`` in the graph's schema; ``vectors`` (id, vec) and a stored text ``index`` of the nodes are optional."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None):
        self.nodes, self.edges, self.vectors, self.index = nodes, edges, vectors, index
        self.calls = edges.where("rel_type = 'calls'")
        self.spark = nodes.sparkSession

    @classmethod
    def of(cls, store: GraphStore) -> GraphTools:
        """Over a stored graph, with its vectors and its text index if they are there."""
        vectors = store.embeddings() if store.meta().get("embedding_model") else None
        return cls(store.nodes(), store.edges(), vectors, store.text_index())

    # --- finding symbols

    def resolve(self, symbol: str, limit: int = 1) -> DataFrame:
        """``(id, score)``: exact names first, full text if there are none."""
        exact = search.exact_name(self.nodes, symbol, limit)
        return exact if not exact.isEmpty() else search.search_nodes(self.nodes, symbol, limit, self.index).select("id", "score")

    def _one(self, symbol: str) -> DataFrame:
        return self.resolve(symbol, 1).select("id")

    def query(self, text: str, limit: int = 20, vector: Sequence[float] | None = None) -> DataFrame:
        """``(id, score, name, file_path, label, process)`` by full text (or close names) and vectors, fused."""
        k = min(3 * limit, 300)
        fts = search.search_nodes(self.nodes, text, k, self.index)
        close = search.fuzzy(self.nodes, "id", "name", text, k)
        near = search.vector_topk(self.vectors, "id", "vec", vector, k) if vector is not None and self.vectors is not None else fts.select("id", "score").limit(0)
        hits = search.hybrid(fts, close, near, limit)
        return hits.join(self.nodes.select("id", "name", "file_path", "label"), "id").join(self.process_of(), "id", "left")

    def process_of(self) -> DataFrame:
        """``(id, process)``: the first process of each node, by name."""
        steps = self.edges.where("rel_type = 'step_in_process'").select(F.col("src").alias("id"), F.col("dst").alias("pid"))
        return steps.join(self.nodes.where("label = 'process'").select(F.col("id").alias("pid"), "name"), "pid").groupBy("id").agg(F.min_by("name", "pid").alias("process"))

    # --- neighbourhoods

    def context(self, symbol: str) -> DataFrame:
        """``(section, id, name, confidence, tag)``: callers, callees, types, heritage, importers, accessors and up to four alternates."""
        one = self._one(symbol)
        parts = []
        for section, rel, way in (("callers", "calls", "callers"), ("callees", "calls", "callees"), ("types", "uses_type", "callees"), ("parents", "extends", "callees"), ("parents", "implements", "callees"), ("children", "extends", "callers"), ("importers", "imports", "callers"), ("accessors", "accesses", "callers")):
            parts.append(traversal.neighbours(self.edges, self.nodes, one, way, rel).select(F.lit(section).alias("section"), "id", "name", "confidence"))
        alternates = self.resolve(symbol, 5).join(one, "id", "left_anti").join(self.nodes.select("id", "name"), "id").select(F.lit("alternates").alias("section"), "id", "name", F.lit(None).cast("double").alias("confidence"))
        out = alternates
        for p in parts:
            out = out.unionByName(p)
        tag = F.when(F.col("confidence") < 0.5, "(?)").when(F.col("confidence") < 0.9, "(~)").otherwise("")
        return out.withColumn("tag", tag)

    def impact(self, symbol: str, depth: int = 3) -> DataFrame:
        """``(id, name, file_path, depth, group)``: callers by depth; of a member, its accessors."""
        one = self._one(symbol)
        member = not self.nodes.join(one, "id", "left_semi").where(F.col("label").isin(MEMBER_LABELS)).isEmpty()
        met = self.edges.where("rel_type = 'accesses'").join(one.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit(1).alias("depth")).distinct() if member else traversal.bfs(self.calls, one, depth, "callers")
        group = F.when(F.col("depth") == 1, "will break").when(F.col("depth") == 2, "may break").otherwise("review")
        return met.join(self.nodes.select("id", "name", "file_path"), "id").select("id", "name", "file_path", "depth", group.alias("group"))

    def _kinds(self) -> DataFrame:
        return self.calls.select("src", "dst", F.coalesce(F.get_json_object("metadata", "$.dispatch_kind"), F.lit("direct")).alias("kind"))

    def concurrent_with(self, symbol: str, depth: int = 3) -> DataFrame:
        """``(id, depth, kind)``: what the symbol starts asynchronously, over asynchronous hops only."""
        return traversal.bfs(self._kinds(), self._one(symbol), max(1, depth), "callees", ASYNC_KINDS)

    def call_path(self, start: str, goal: str, max_hops: int = 10) -> DataFrame:
        """``(hop, id, name, kind)`` of a shortest call path; kind is that of the hop into the node."""
        a, b = self._one(start).first(), self._one(goal).first()
        if a is None or b is None:
            return self.spark.createDataFrame([], "hop int, id string, name string, kind string")
        path = traversal.shortest_path(self.calls, a[0], b[0], max_hops)
        before = path.select((F.col("hop") + 1).alias("hop"), F.col("id").alias("src"))
        hops = path.join(before, "hop", "left").join(self._kinds().withColumnRenamed("dst", "id").groupBy("src", "id").agg(F.min("kind").alias("kind")), ["src", "id"], "left")
        return hops.join(self.nodes.select("id", "name"), "id").select("hop", "id", "name", "kind")

    def explain(self, symbol: str) -> DataFrame:
        """``(section, name)``: roles, community, up to five callers and callees, processes."""
        one = self._one(symbol).cache()
        node = self.nodes.join(one, "id", "left_semi")
        roles = node.select(F.explode(F.array_compact(F.array(F.when(F.col("is_entry_point"), "entry point"), F.when(F.col("is_exported"), "exported"), F.when(F.col("is_dead"), "unreachable"), F.when(is_test_file(F.col("file_path")), "test")))).alias("name")).select(F.lit("role").alias("section"), "name")
        near = lambda section, way, rel, n: traversal.neighbours(self.edges, self.nodes, one, way, rel).orderBy(F.desc("confidence"), "id").limit(n).select(F.lit(section).alias("section"), "name")
        return roles.union(near("community", "callees", "member_of", 1)).union(near("caller", "callers", "calls", 5)).union(near("callee", "callees", "calls", 5)).union(near("process", "callees", "step_in_process", 50))

    # --- reports

    def dead_code(self) -> DataFrame:
        """``(file_path, symbols)``: unreachable symbols of each file by line."""
        dead = self.nodes.where("is_dead")
        return dead.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "name", "label"))).alias("symbols")).orderBy("file_path")

    def detect_changes(self, diff: str) -> DataFrame:
        """Symbols that a unified diff touches."""
        hunks = intervals.diff_hunks(intervals.diff_text(self.spark, diff))
        return intervals.overlapping(self.nodes.where(F.col("label") != "file"), hunks).select("id", "name", "label", "file_path", "start_line", "end_line")

    def cypher(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        return cypher(text, self.nodes, self.edges, params, index=self.index)

    def _pairs(self) -> DataFrame:
        place = self.nodes.where("label = 'file'").select("id", "file_path")
        e = self.edges.where("rel_type = 'coupled_with'").select("src", "dst", "strength", "co_changes")
        return e.join(place.withColumnsRenamed({"id": "src", "file_path": "a"}), "src").join(place.withColumnsRenamed({"id": "dst", "file_path": "b"}), "dst").select("a", "b", "strength", "co_changes")

    def coupling(self, file_path: str, min_strength: float = 0.3) -> DataFrame:
        """``(other, strength, co_changes, hidden)``: files that change with one, strongest first."""
        place = self.nodes.where("label = 'file'").select("id", "file_path")
        imports = self.edges.where("rel_type = 'imports'").select("src", "dst").join(place.withColumnsRenamed({"id": "src", "file_path": "s"}), "src").join(place.withColumnsRenamed({"id": "dst", "file_path": "d"}), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        of = self.spark.createDataFrame([(file_path,)], "id string")
        return coupling.coupled_with(self._pairs(), of, imports, min_strength).drop("id").orderBy(F.desc("strength"), "other")

    def communities(self, crossing: bool = False) -> DataFrame:
        """``(id, name, members, cohesion)``; with ``crossing``, processes whose steps lie in several communities."""
        if crossing:
            member = self.edges.where("rel_type = 'member_of'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
            steps = self.edges.where("rel_type = 'step_in_process'").select(F.col("src").alias("id"), F.col("dst").alias("process"))
            return steps.join(member, "id").groupBy("process").agg(F.sort_array(F.collect_set("community")).alias("communities")).where(F.size("communities") > 1)
        sizes = self.edges.where("rel_type = 'member_of'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("members"))
        return self.nodes.where("label = 'community'").join(sizes, "id", "left").select("id", "name", F.coalesce("members", F.lit(0)).alias("members"), F.bround("cohesion", 4).alias("cohesion"))

    def cycles(self, least: int = 2) -> DataFrame:
        """Groups of symbols that reach each other by calls, heritage or types."""
        symbols = self.nodes.where("label in ('function', 'method', 'class')").select("id")
        e = self.edges.where("rel_type in ('calls', 'extends', 'implements', 'uses_type')").select("src", "dst")
        inside = e.join(symbols.withColumnRenamed("id", "src"), "src", "left_semi").join(symbols.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return traversal.cycles(inside, least).orderBy(F.desc("size"), "component")

    def review_risk(self, diff: str) -> DataFrame:
        hunks = intervals.diff_hunks(intervals.diff_text(self.spark, diff))
        member = self.edges.where("rel_type = 'member_of'").select(F.col("src").alias("id"), F.col("dst").alias("community"))
        return analysis.review_risk(self.nodes.where("label in ('function', 'method', 'class')"), self.calls, self._pairs(), member, hunks)

    def test_impact(self, diff: str) -> DataFrame:
        hunks = intervals.diff_hunks(intervals.diff_text(self.spark, diff))
        return analysis.test_impact(self.nodes.where("label in ('function', 'method', 'class')"), self.calls, hunks)

    def file_context(self, file_path: str) -> DataFrame:
        """``(section, name, value)``: a file's symbols, imports both ways, five most coupled files, unreachable symbols, communities and members' accessors."""
        here = self.nodes.where(F.col("file_path") == file_path)
        ids = here.where("label = 'file'").select("id")
        row = lambda df, section, name, value: df.select(F.lit(section).alias("section"), F.col(name).alias("name"), value.cast("double").alias("value"))
        one = F.lit(1)
        symbols = row(here.where(~F.col("label").isin("file", *MEMBER_LABELS)), "symbol", "name", F.col("start_line"))
        out_ = row(traversal.neighbours(self.edges, self.nodes, ids, "callees", "imports"), "imports", "file_path", one)
        into = row(traversal.neighbours(self.edges, self.nodes, ids, "callers", "imports"), "imported by", "file_path", one)
        partners = row(self.coupling(file_path, 0.0).limit(5), "coupled", "other", F.col("strength"))
        dead = row(here.where("is_dead"), "unreachable", "name", F.col("start_line"))
        groups = row(traversal.neighbours(self.edges, self.nodes, here.select("id"), "callees", "member_of").groupBy("name").agg(F.count("*").alias("n")), "community", "name", F.col("n"))
        touched = self.edges.where("rel_type = 'accesses'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
        members = row(here.where(F.col("label").isin(MEMBER_LABELS)).join(touched, "id", "left"), "member", "name", F.coalesce("n", F.lit(0)))
        return symbols.union(out_).union(into).union(partners).union(dead).union(groups).union(members)


def list_repos(repos: DataFrame, meta: DataFrame) -> DataFrame:
    """Registered repositories (slug, path) with their last index times and whether they lag."""
    return repos.join(analysis.staleness(meta.withColumnRenamed("repo", "slug")), "slug", "left").orderBy("slug")


def across_repos(nodes: DataFrame, name: str, per_repo: int = 3, most: int = 50) -> DataFrame:
    """``(repo, id, hits)``: up to ``per_repo`` symbols of a name in each repository of ``nodes`` (repo, id, name), and how many it has (``most`` at most)."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo")
    found = nodes.where(F.col("name") == name).select("repo", "id", F.least(F.lit(most), F.count("*").over(w)).alias("hits"), F.row_number().over(w.orderBy("id")).alias("r"))
    return found.where(F.col("r") <= per_repo).drop("r")
