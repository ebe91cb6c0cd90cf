"""From source files and history to a graph: extraction, resolution, algorithms."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.schema import as_edges, as_nodes, node_id
from graphloom.operators import analysis, communities, coupling, dead_code, flows, intervals, resolve
from graphloom.sources import files as source_files
from graphloom.sources import python_extract, script_extract
from graphloom.sources.storage import GraphStore, materialize, replaced, shared_dir

_SYMBOL = "array<struct<name:string,kind:string,start_line:bigint,end_line:bigint,content:string,signature:string,class_name:string,decorators:array<string>,bases:array<string>>>"
_CALL = "array<struct<name:string,line:bigint,receiver:string,receiver_type:string,arguments:array<string>,is_reference:boolean,metadata:string,dispatch_kind:string>>"
PARSED = (
    f"path string, language string, ord bigint, symbols {_SYMBOL}, imports array<struct<module:string,names:array<string>,is_relative:boolean,alias:string>>, calls {_CALL}, "
    "type_refs array<struct<name:string,role:string,line:bigint,param:string>>, heritage array<struct<child_name:string,kind:string,parent_name:string>>, exports array<string>, "
    "members array<struct<name:string,parent:string,kind:string,line:bigint>>, accesses array<struct<owner:string,name:string,line:bigint,mode:string>>"
)


def parse(sources: DataFrame) -> DataFrame:
    """One row a file with its eight lists (``sources``: path, content, language, ord); a file that doesn't parse has empty ones."""
    blocked = frozenset(resolve.BLOCKLIST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, language, order in zip(pdf.path, pdf.content, pdf.language, pdf.ord):
                out = python_extract.extract(content or "", blocked) if language == "python" else script_extract.extract(content or "")
                calls = []
                for c in out["calls"]:
                    extra = python_extract.call_metadata(c)
                    calls.append({k: c[k] for k in ("name", "line", "receiver", "receiver_type", "arguments", "is_reference", "dispatch_kind")} | {"metadata": json.dumps(extra, sort_keys=True) if extra else ""})
                rows.append({"path": path, "language": language, "ord": order} | out | {"calls": calls})
            yield pd.DataFrame(rows, columns=["path", "language", "ord", *python_extract.KEYS])

    return sources.select("path", "content", "language", "ord").mapInPandas(run, PARSED)


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def symbol_rows(parsed: DataFrame) -> DataFrame:
    """Symbols and members as node rows with decorators, bases and the file's exports applied."""
    s = parsed.select("path", "language", "exports", F.col("ord").alias("file_ord"), F.posexplode("symbols").alias("k", "s")).select("path", "language", "exports", "file_ord", "k", "s.*")
    symbol = F.when(F.col("class_name") != "", F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))
    symbols = s.select(
        node_id(F.col("kind"), F.col("path"), symbol).alias("id"), F.col("kind").alias("label"), "name", F.col("path").alias("file_path"), "start_line", "end_line", "content", "signature", "language", "class_name", F.array_contains("exports", F.col("name")).alias("is_exported"), "decorators",
        "bases", (F.col("file_ord") * 1_000_000 + F.col("k")).alias("ord"),
    )
    m = parsed.select("path", "language", F.col("ord").alias("file_ord"), F.posexplode("members").alias("k", "m")).select("path", "language", "file_ord", "k", "m.*")
    inner = F.when(F.col("parent") != "", F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
    none = F.expr("cast(array() as array<string>)")
    members = m.select(
        node_id(F.col("kind"), F.col("path"), inner).alias("id"), F.col("kind").alias("label"), "name", F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit("").alias("content"), F.lit("").alias("signature"), "language",
        F.col("parent").alias("class_name"), F.lit(False).alias("is_exported"), none.alias("decorators"), none.alias("bases"), (F.col("file_ord") * 1_000_000 + 500_000 + F.col("k")).alias("ord"),
    )
    both = symbols.unionByName(members)
    last = both.groupBy("id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "id"]), "ord").alias("r"))  # last write wins
    return last.select("id", "r.*")


def build(sources: DataFrame, commits: DataFrame | None = None) -> Graph:
    """The whole graph of ``sources`` (path, content, language, ord) and ``commits`` (commit_id, file_path).

    Stages that several later ones read are written to shared storage: parsing
    runs once. Order matters: calls need imports, kinds need communities,
    unreachable symbols need entry points.
    """
    parsed = materialize(parse(sources), "parsed")
    symbols = materialize(symbol_rows(parsed), "symbols")
    graph = emit(sources, parsed, symbols, symbols, sources.select("path", "language"))
    if commits is not None:
        graph = Graph(graph.nodes, materialize(graph.edges.unionByName(coupling_edges(commits, sources.select("path"))), "edges"))
    return refresh(graph)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path, F.lit(":"))


def coupling_edges(commits: DataFrame, files: DataFrame) -> DataFrame:
    pairs = coupling.coupling(commits.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    return as_edges(pairs.select(F.lit("coupled_with").alias("rel_type"), file_id(F.col("a")).alias("src"), file_id(F.col("b")).alias("dst"), "strength", "co_changes"))


def emit(sources: DataFrame, parsed: DataFrame, symbols: DataFrame, known: DataFrame, known_files: DataFrame) -> Graph:
    """Nodes and edges of ``sources``, resolved against ``known`` symbols and ``known_files`` (path, language), its own among them."""
    files = sources.select("path", "language", "content", "ord")
    folders, contains = analysis.folder_tree(files)
    folder_id = lambda c: F.concat(F.lit("folder:"), c, F.lit(":"))
    last_part = F.element_at(F.split("path", "/"), -1)
    file_nodes = files.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("label"), last_part.alias("name"), F.col("path").alias("file_path"), "content", "language", "ord")
    folder_nodes = folders.select(folder_id(F.col("path")).alias("id"), F.lit("folder").alias("label"), last_part.alias("name"), F.col("path").alias("file_path"))
    leaves = files.select(F.col("path").alias("dst"), F.lit(True).alias("is_file"))
    tree = contains.join(leaves, "dst", "left").select(F.lit("contains").alias("rel_type"), folder_id(F.col("src")).alias("src"), F.when(F.col("is_file"), file_id(F.col("dst"))).otherwise(folder_id(F.col("dst"))).alias("dst"))
    owners = symbols.where("label in ('class', 'enum', 'interface')").select(F.col("name").alias("class_name"), "file_path", F.col("id").alias("owner")).groupBy("class_name", "file_path").agg(F.min("owner").alias("owner"))
    is_member = F.col("label").isin("enum_member", "class_attribute")
    defines = symbols.join(owners, ["class_name", "file_path"], "left").select(F.lit("defines").alias("rel_type"), F.when(is_member & F.col("owner").isNotNull(), F.col("owner")).otherwise(file_id(F.col("file_path"))).alias("src"), F.col("id").alias("dst"))

    imports = parsed.select("path", F.posexplode("imports").alias("k", "i")).select(F.concat_ws("#", "path", "k").alias("import_id"), F.col("path").alias("file_path"), "i.*")
    resolved = materialize(resolve.resolve_imports(imports, known_files), "imports")
    import_edges = resolve.import_edges(resolved).select(F.lit("imports").alias("rel_type"), file_id(F.col("src")).alias("src"), file_id(F.col("dst")).alias("dst"), "symbols")
    imported = materialize(resolved.select("file_path", F.explode(F.concat("names", F.when(F.size("names") == 0, F.array(F.lit("*"))).otherwise(F.expr("cast(array() as array<string>)")))).alias("name"), F.col("target").alias("target_file")), "imported")

    callable_ = known.where(F.col("label").isin(resolve.LABEL_ORDER)).select("id", "name", "label", "file_path", "class_name", "ord")
    raw_calls = parsed.select("path", F.col("ord").alias("file_ord"), F.posexplode("calls").alias("call_ord", "c")).select(F.concat_ws("#", "path", "call_ord").alias("pid"), F.col("path").alias("file_path"), "file_ord", "call_ord", "c.*")
    spans = symbols.where("label in ('function', 'method', 'class')")
    owner_class = symbols.where("label = 'method'").select(F.col("id").alias("symbol"), F.col("class_name").alias("caller_class"))
    placed = intervals.containing_symbol(raw_calls, spans).join(owner_class, "symbol", "left").withColumn("src", F.coalesce("symbol", file_id(F.col("file_path")))).withColumn("caller_class", F.coalesce("caller_class", F.lit("")))
    decorated = symbols.where(F.size("decorators") > 0).select(F.col("id").alias("src"), F.explode("decorators").alias("name"), "file_path", "ord")
    calls = materialize(resolve.call_edges(placed, callable_, imported, decorated), "calls")
    call_rows = calls.select(F.lit("calls").alias("rel_type"), "src", "dst", "confidence", F.when(F.col("via") != "", F.lit('{"via": "reference"}')).otherwise(F.col("metadata")).alias("metadata"))

    heritage = parsed.select(F.col("path").alias("file_path"), F.explode("heritage").alias("h")).select("file_path", "h.*")
    kin, protocols = resolve.heritage_edges(heritage, callable_)
    kin_rows = kin.select(F.col("kind").alias("rel_type"), F.col("child").alias("src"), F.col("parent").alias("dst"))
    refs = parsed.select("path", F.posexplode("type_refs").alias("k", "t")).select(F.concat_ws("#", "path", "k").alias("pid"), F.col("path").alias("file_path"), "t.*")
    typed = intervals.containing_symbol(refs, symbols.where("label in ('function', 'method')")).where("symbol is not null").withColumnRenamed("symbol", "src")
    type_rows = resolve.type_edges(typed, callable_).select(F.lit("uses_type").alias("rel_type"), "src", "dst", "role", F.concat(F.lit("uses_type:"), F.col("src"), F.lit("->"), F.col("dst"), F.lit(":"), F.col("role")).alias("rel_id"))
    uses = parsed.select("path", F.posexplode("accesses").alias("k", "a")).select(F.concat_ws("#", "path", "k").alias("pid"), F.col("path").alias("file_path"), "a.*")
    touched = intervals.containing_symbol(uses, spans).withColumnRenamed("symbol", "src")
    members = known.where(F.col("label").isin("enum_member", "class_attribute", "module_constant"))
    access_rows = resolve.member_edges(touched, members, imported).select(F.lit("accesses").alias("rel_type"), "src", "dst", "confidence", F.col("mode").alias("access_mode"), F.concat(F.col("src"), F.lit("->accesses->"), F.col("dst"), F.lit("@"), F.col("line"), F.lit(":"), F.col("mode")).alias("rel_id"))
    parts = [tree, defines, import_edges, call_rows, kin_rows, type_rows, access_rows]
    edges = as_edges(parts[0])
    for p in parts[1:]:
        edges = edges.unionByName(as_edges(p))
    properties = F.to_json(F.struct("decorators", "bases", F.col("protocol").isNotNull().alias("is_protocol")))
    symbol_nodes = symbols.join(protocols.withColumn("protocol", F.lit(True)), "id", "left").withColumn("properties", properties)
    nodes = as_nodes(file_nodes).unionByName(as_nodes(folder_nodes)).unionByName(as_nodes(symbol_nodes))
    return Graph(materialize(nodes, "nodes"), materialize(edges, "edges"))


def refresh(graph: Graph) -> Graph:
    """Communities, flows and unreachable symbols computed anew over the rest of the graph."""
    nodes = graph.nodes.where("label not in ('community', 'process')")
    edges = graph.edges.where("rel_type not in ('member_of', 'step_in_process')")
    weighted = edges.where("rel_type in ('calls', 'extends', 'implements', 'uses_type')").join(nodes.where("label in ('function', 'method', 'class')").select(F.col("id").alias("src")), "src", "left_semi").join(nodes.where("label in ('function', 'method', 'class')").select(F.col("id").alias("dst")), "dst", "left_semi")
    weighted = weighted.select("src", "dst", F.when(F.col("rel_type") == "calls", 1.0).otherwise(0.5).alias("weight"))
    found = materialize(communities.communities(weighted), "membership")
    label = communities.community_labels(found, nodes)
    cid = F.concat(F.lit("community::"), F.lit("community_"), F.col("community").cast("string"))
    community_nodes = communities.cohesion(weighted, found).join(label.withColumnRenamed("label", "title"), "community").select(cid.alias("id"), F.lit("community").alias("label"), F.col("title").alias("name"), "cohesion", F.to_json(F.struct(F.col("size").alias("symbol_count"))).alias("properties"))
    member_rows = found.select(F.lit("member_of").alias("rel_type"), F.col("id").alias("src"), cid.alias("dst"))
    entries = flows.entry_points(nodes).select("id")
    traced = flows.trace_flows(edges.where("rel_type = 'calls'").select("src", "dst", "confidence", "ord").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), entries)
    kept = materialize(flows.dedup_flows(traced), "flows")
    kinds = flows.flow_kinds(kept, nodes.select("id", "name"), found)
    pid = F.concat(F.lit("process::"), F.col("entry"))
    process_nodes = kinds.select(pid.alias("id"), F.lit("process").alias("label"), F.col("label").alias("name"), F.to_json(F.struct("step_count", "kind")).alias("properties"))
    step_rows = kept.select(F.lit("step_in_process").alias("rel_type"), F.posexplode("steps").alias("step_number", "src"), pid.alias("dst")).withColumn("rel_id", F.concat_ws(":", F.lit("step"), "src", "dst", "step_number"))
    flagged = nodes.drop("is_entry_point").join(entries.withColumn("is_entry_point", F.lit(True)), "id", "left").withColumn("is_entry_point", F.coalesce("is_entry_point", F.lit(False)))
    nodes_out = unreachable(Graph(flagged, edges)).nodes.unionByName(as_nodes(community_nodes)).unionByName(as_nodes(process_nodes))
    edges_out = edges.unionByName(as_edges(member_rows)).unionByName(as_edges(step_rows))
    return Graph(materialize(nodes_out, "nodes"), materialize(edges_out, "edges"))


def reindex(store: GraphStore, changed: DataFrame, removed: list[str], small: bool = False) -> None:
    """Bring a stored graph up to ``changed`` files (as sources) and ``removed`` paths.

    Edges into these files from others are kept where both ends live on; the
    changed files are parsed and resolved against all stored symbols. A small
    change recomputes unreachable symbols only, else communities and flows too.
    The paths of one flush are few by rule, so they come to the driver. The store
    is written once, at the end: a failure on the way leaves it as it was.
    """
    store = store.begin()
    paths = sorted({r.path for r in changed.select("path").collect()} | set(removed))
    nodes = store.nodes()
    there = nodes.where(F.col("file_path").isin(paths)).select("id")
    inbound = materialize(store.edges().join(there.withColumnRenamed("id", "dst"), "dst", "left_semi").join(there.withColumnRenamed("id", "src"), "src", "left_anti"), "inbound")
    rest, links = store.without_files(paths)
    parsed = materialize(parse(changed), "parsed")
    symbols = materialize(symbol_rows(parsed), "symbols")
    stored = materialize(rest.where(~F.col("label").isin("file", "folder", "community", "process")), "stored")
    lists = F.from_json("properties", "decorators array<string>, bases array<string>")
    known = symbols.unionByName(stored.withColumn("x", lists).withColumns({"decorators": F.col("x.decorators"), "bases": F.col("x.bases")}).select(*symbols.columns))
    files = rest.where("label = 'file'").select(F.col("file_path").alias("path"), "language").union(changed.select("path", "language"))
    fresh = emit(changed, parsed, symbols, known, materialize(files, "files"))
    now = materialize(replaced(rest, fresh.nodes, "id"), "nodes")
    alive = now.select("id")
    restored = inbound.join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi").join(alive.withColumnRenamed("id", "src"), "src", "left_semi")
    added = fresh.edges.unionByName(restored.select(*fresh.edges.columns)).dropDuplicates(["rel_id"])
    joined = Graph(now, materialize(replaced(links, added, "rel_id"), "edges"))
    done = unreachable(joined) if small else refresh(joined)
    store.write(done.nodes, done.edges, {"incremental": "small" if small else "full"})


def unreachable(graph: Graph) -> Graph:
    """The graph with flags of unreachable symbols recomputed."""
    nodes = graph.nodes.withColumn("x", F.from_json("properties", "decorators array<string>, bases array<string>, is_protocol boolean"))
    judged = dead_code.dead_symbols(nodes.select("id", "label", "name", "file_path", "class_name", "is_entry_point", "is_exported", "x.decorators", "x.bases", F.coalesce("x.is_protocol", F.lit(False)).alias("is_protocol")), graph.edges)
    return Graph(materialize(as_nodes(nodes.drop("x", "is_dead").join(judged, "id", "left").withColumn("is_dead", F.coalesce("is_dead", F.lit(False)))), "nodes"), materialize(as_edges(graph.edges), "edges"))


def diff_revisions(spark: SparkSession, root: str, revisions: str) -> DataFrame:
    """``analysis.branch_diff`` of ``base..current``, or of a base and the working tree: each side checked out, built by the whole pipeline, and compared."""
    base, current = source_files.ref_range(revisions)
    made, graphs = [], []
    try:
        for ref in (base, current):
            place = root
            if ref is not None:
                place = source_files.checked_out(root, ref, f"{shared_dir(spark).rstrip('/')}/checkout-{uuid.uuid4().hex}")
                made.append(place)
            graphs.append(build(source_files.read_sources(spark, place, tracked=source_files.git_tracked(spark, place))))
    finally:
        for place in made:
            source_files.drop_checkout(root, place)
    return analysis.branch_diff(*graphs)
