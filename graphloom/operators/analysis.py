"""Reports over a graph: overviews, health, review risk, test impact, staleness and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dead_code import is_test_file
from .intervals import overlapping
from .traversal import bfs

SYMBOLS = ["function", "method", "class"]


def counts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, n)``: rows a label or relationship type."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def most_called(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """``(name, callers)``; symbols of one name are merged."""
    return edges.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy("name").agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "name").limit(limit)


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the score and its five parts, each from 0 to 100 (dead code 25 %, coupling, modularity, confidence 20 % each, coverage 15 %).

    One aggregate a table; single rows are joined. Rounding is half-even at one decimal.
    """
    callable_ = F.col("label").isin("function", "method")
    symbol = F.col("label").isin(SYMBOLS) & (F.col("start_line") > 0)
    covered = edges.where("rel_type = 'step_in_process'").select(F.col("src").alias("id")).distinct().withColumn("covered", F.lit(True))
    n = nodes.join(covered, "id", "left").agg(
        F.count_if(symbol).alias("symbols"), F.count_if(symbol & F.col("is_dead")).alias("dead"), F.count_if(F.col("label") == "community").alias("communities"), F.count_if(callable_).alias("callables"), F.count_if(callable_ & F.col("covered")).alias("covered")
    )
    coupled = F.col("rel_type") == "coupled_with"
    e = edges.agg(F.count_if(coupled).alias("coupled"), F.count_if(coupled & (F.col("strength") > 0.7)).alias("strong"), F.avg(F.when(F.col("rel_type") == "calls", F.col("confidence"))).alias("confidence"))
    one = lambda c: F.bround(c.cast("double"), 1)
    floor1 = lambda c: F.greatest(F.lit(1), F.col(c))
    comm = F.col("communities")
    parts = n.crossJoin(e).select(
        one(F.greatest(F.lit(0.0), 100 - F.col("dead") / floor1("symbols") * 100)).alias("dead_code"),
        F.when(F.col("coupled") == 0, 100.0).otherwise(one(F.greatest(F.lit(0.0), 100 - F.col("strong") / floor1("coupled") * 200))).alias("coupling"),
        F.when(comm == 0, 20.0).when(comm <= 15, F.least(F.lit(100.0), one(comm / 15 * 100))).otherwise(one(F.greatest(F.lit(50.0), 100 - (comm - 15) * 2.0))).alias("modularity"),
        one(F.least(F.lit(100.0), F.coalesce("confidence", F.lit(0.8)) * 100)).alias("confidence"),
        one(F.least(F.lit(100.0), F.col("covered") / floor1("callables") * 100)).alias("coverage"),
    )
    return parts.withColumn("score", one(F.col("dead_code") * 0.25 + F.col("coupling") * 0.20 + F.col("modularity") * 0.20 + F.col("confidence") * 0.20 + F.col("coverage") * 0.15))


def review_risk(symbols: DataFrame, calls: DataFrame, coupling: DataFrame, membership: DataFrame, hunks: DataFrame) -> DataFrame:
    """One row: risk of a change given as hunks.

    min(10, changed entry points + partners of changed files (>= 0.5) that did
    not change + dependents div 10 + 2 if several communities). Dependents sum,
    over changed symbols, the callers within 2 hops, repeats included.
    """
    changed = overlapping(symbols, hunks).cache()
    files = hunks.select(F.col("file_path").alias("id")).distinct()
    partners = coupling.where("strength >= 0.5").select("a", "b").union(coupling.where("strength >= 0.5").select("b", "a")).toDF("id", "other")
    missing = partners.join(files, "id", "left_semi").join(files.select(F.col("id").alias("other")), "other", "left_anti").select("other").distinct().agg(F.count("*").alias("missing"))
    hop = calls.select(F.col("dst").alias("at"), F.col("src").alias("id")).distinct()
    one = changed.select(F.col("id").alias("of")).join(hop.withColumnRenamed("at", "of"), "of").where("id <> of")
    two = one.join(hop.select("at", F.col("id").alias("next")), F.col("id") == F.col("at")).select("of", F.col("next").alias("id")).where("id <> of")
    dependents = one.select("of", "id").union(two).distinct().agg(F.count("*").alias("dependents"))
    own = changed.agg(F.count_if("is_entry_point").alias("entries"), F.count("*").alias("symbols"))
    groups = membership.join(changed.select("id"), "id", "left_semi").agg(F.count_distinct("community").alias("communities"))
    row = own.crossJoin(missing).crossJoin(dependents).crossJoin(groups)
    score = F.least(F.lit(10), F.col("entries") + F.col("missing") + F.expr("dependents div 10") + F.when(F.col("communities") > 1, 2).otherwise(0))
    return row.withColumn("score", score.cast("long")).withColumn("level", F.when(F.col("score") <= 3, "LOW").when(F.col("score") <= 6, "MEDIUM").otherwise("HIGH"))


def test_impact(symbols: DataFrame, calls: DataFrame, hunks: DataFrame, depth: int = 4) -> DataFrame:
    """``(id, name, file_path, reach)``: tests that call changed symbols, direct within 2 hops, else transitive; changed tests themselves are direct."""
    changed = overlapping(symbols, hunks).select("id").cache()
    met = bfs(calls, changed, depth, "callers").select("id", "depth").unionByName(changed.select("id", F.lit(0).alias("depth")))
    tests = symbols.where(is_test_file(F.col("file_path")))
    return tests.join(met, "id").select("id", "name", "file_path", F.when(F.col("depth") <= 2, "direct").otherwise("transitive").alias("reach"))


def pipeline_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, symbols, relationships, communities, processes, dead symbols."""
    no = ["file", "folder", "community", "process", "enum_member", "class_attribute", "module_constant"]
    of = lambda label: F.count_if(F.col("label") == label)
    n = nodes.agg(of("file").alias("files"), F.count_if(~F.col("label").isin(no)).alias("symbols"), of("community").alias("communities"), of("process").alias("processes"), F.count_if("is_dead").alias("dead"))
    return n.crossJoin(edges.agg(F.count("*").alias("relationships")))


def staleness(meta: DataFrame, lag_seconds: int = 60) -> DataFrame:
    """``meta`` (repo, incremental_at, global_at as ISO text) with ``lag`` and ``stale``: global phases behind the last incremental."""
    at = lambda c: F.unix_timestamp(F.try_to_timestamp(F.col(c)))
    lag = at("incremental_at") - at("global_at")
    return meta.withColumn("lag", lag).withColumn("stale", F.coalesce(lag > lag_seconds, F.lit(False)))


def drift(facts: DataFrame) -> DataFrame:
    """``facts`` with ``level``: FRESH, STALE_MINOR, STALE_MAJOR or UNKNOWN.

    Columns: host_alive, incremental_age, head_equal, head_known, is_ancestor,
    commits_behind, changed_files, total_files, sentinels_checked,
    sentinels_changed, dirs_checked, dirs_changed. The first tier that can tell
    decides: a live host, the distance of heads, sentinel files, folders.
    """
    live = F.when(F.col("host_alive") & (F.col("incremental_age") <= 300) & F.col("head_equal"), "FRESH")
    major = ~F.col("is_ancestor") | (F.col("commits_behind") > 50) | (F.col("changed_files") > 0.5 * F.col("total_files"))
    heads = F.when(F.col("head_known") & ~F.col("head_equal"), F.when(major, "STALE_MAJOR").otherwise("STALE_MINOR"))
    sentinels = F.when((F.col("sentinels_checked") > 0) & (F.col("sentinels_changed") > 0), "STALE_MINOR")
    folders = F.when(F.col("dirs_checked") > 0, F.when(F.col("dirs_changed") > 0, "STALE_MINOR").otherwise("FRESH"))
    return facts.withColumn("level", F.coalesce(live, heads, sentinels, folders, F.lit("UNKNOWN")))


def dirty_closure(nodes: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """``(id)``: nodes of dirty files (file_path) and their call neighbours in both directions."""
    own = nodes.join(files, "file_path", "left_semi").select("id")
    out = calls.join(own.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"))
    into = calls.join(own.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"))
    return own.union(out).union(into).distinct()


def duration_seconds(text: Column) -> Column:
    """``30s``, ``5m``, ``1h``; null otherwise."""
    n, unit = F.regexp_extract(text, r"^(\d+)([smh])$", 1), F.regexp_extract(text, r"^(\d+)([smh])$", 2)
    return F.when(unit != "", n.cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).otherwise(3600))


def folder_tree(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(folders(path, depth), contains(src, dst))`` of ``files`` (path): every ancestor folder; the root has none."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chain = files.select("path", ups.alias("u"))
    folders = chain.select(F.explode(F.slice("u", 1, F.size("u") - 1)).alias("path")).distinct().withColumn("depth", F.size(F.split("path", "/")))
    links = chain.where(F.size("u") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("u") - 1), lambda i: F.struct(F.get("u", i - 1).alias("src"), F.get("u", i).alias("dst")))).alias("l")).select("l.*").distinct()
    return folders, links


#: The lines of a node's text after its head, in order: relationship, its end that the node is, the node's labels, the line's title.
TEXT_LINES = [
    ("calls", "src", ["function", "method"], "calls"),
    ("calls", "dst", ["function", "method"], "called by"),
    ("uses_type", "src", ["function", "method"], "uses types"),
    ("extends", "src", ["class"], "extends"),
    ("implements", "src", ["class"], "implements"),
    ("defines", "src", ["file"], "defines"),
    ("imports", "src", ["file"], "imports"),
    ("contains", "src", ["folder"], "contains"),
    ("member_of", "dst", ["community"], "members"),
    ("step_in_process", "dst", ["process"], "steps"),
]


def node_texts(nodes: DataFrame, edges: DataFrame, most: int = 8192) -> DataFrame:
    """``(id, text)`` to embed, of at most ``most`` characters: kind, name, class and file, then by label the signature, a class's methods, and the sorted names around it.

    A line takes no more names than fit into a text, so a hot node's are never gathered whole.
    """
    keys = [(i, f"{rel} {end} {label}", title) for i, (rel, end, labels, title) in enumerate(TEXT_LINES, 1) for label in labels]
    line = F.create_map(*[F.lit(x) for i, key, _ in keys for x in (key, i)])
    title = F.create_map(*[F.lit(x) for x in (0, "methods")], *[F.lit(x) for i, (*_, t) in enumerate(TEXT_LINES, 1) for x in (i, t)])
    label_of, name_of = nodes.select("id", "label"), nodes.select(F.col("id").alias("other"), "name")
    near = None
    for end, far in (("src", "dst"), ("dst", "src")):
        wanted = [rel for rel, e, *_ in TEXT_LINES if e == end]
        part = edges.where(F.col("rel_type").isin(wanted)).select(F.col(end).alias("id"), F.col(far).alias("other"), F.concat_ws(" ", "rel_type", F.lit(end)).alias("k"))
        near = part if near is None else near.unionByName(part)
    placed = near.join(label_of, "id").select("id", "other", line[F.concat_ws(" ", "k", "label")].alias("line")).where("line is not null").distinct()
    named = placed.join(name_of, "other").select("id", "line", "name")
    owner = nodes.where("label = 'class'").select("id", F.col("name").alias("class_name"), "file_path")
    methods = nodes.where("label = 'method' and class_name <> ''").select("class_name", "file_path", "name").join(owner, ["class_name", "file_path"]).select("id", F.lit(0).alias("line"), "name")
    ranked = named.unionByName(methods).withColumn("r", F.row_number().over(Window.partitionBy("id", "line").orderBy("name"))).where(F.col("r") <= most // 2 + 1)
    lists = ranked.groupBy("id", "line").agg(F.array_sort(F.collect_list("name")).alias("names")).select("id", "line", F.concat(title[F.col("line")], F.lit(": "), F.array_join("names", ", ")).alias("text"))
    bodies = lists.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    blank = lambda prefix, c, labels=None: F.when((F.col(c) != "") & (F.lit(True) if labels is None else F.col("label").isin(labels)), F.concat(F.lit(prefix), F.col(c)))
    head = F.concat_ws(" ", "label", "name", blank("of class ", "class_name", ["method"]), blank("in ", "file_path"))
    signature = blank("signature: ", "signature", ["function", "method", "interface", "type_alias", "enum"])
    return nodes.join(bodies, "id", "left").select("id", F.substring(F.concat_ws("\n", head, signature, "body"), 1, most).alias("text"))


def executable_hunks(hunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Hunks (file_path, start, end) but those of Python files that touch comments, docstrings or blank lines only.

    ``sources``: path, content, language. Files not given, or that don't
    parse, keep all their hunks.
    """
    import pandas as pd

    from graphloom.sources.python_extract import executable_lines

    wanted = hunks.groupBy("file_path").agg(F.collect_list(F.struct("start", "end")).alias("h"))
    rows = wanted.join(sources.where("language = 'python'").select(F.col("path").alias("file_path"), "content"), "file_path", "left")

    def keep(batches):
        for pdf in batches:
            out = []
            for path, spans, content in zip(pdf.file_path, pdf.h, pdf.content):
                try:
                    live = executable_lines(content) if content is not None else None
                except (SyntaxError, ValueError):
                    live = None
                out += [(path, s["start"], s["end"]) for s in spans if live is None or any(x in live for x in range(s["start"], s["end"] + 1))]
            yield pd.DataFrame(out, columns=["file_path", "start", "end"])

    return rows.mapInPandas(keep, "file_path string, start long, end long")


def narrowed_test_file(path: Column, config: dict[str, list[str]] | None) -> Column:
    """Whether a path is a test under a runner's settings: below its test paths, outside its skipped folders and ignored files."""
    hit = is_test_file(path)
    if not config:
        return hit
    if config.get("testpaths"):
        inside = F.lit(False)
        for p in config["testpaths"]:
            inside = inside | (path == p.strip("/")) | path.startswith(p.strip("/") + "/")
        hit = hit & inside
    from graphloom.sources.files import glob_regex

    for pattern in config.get("norecursedirs") or []:
        hit = hit & ~F.exists(F.split(path, "/"), lambda s: s.rlike(glob_regex(pattern)))
    if config.get("collect_ignore"):
        hit = hit & ~path.isin(config["collect_ignore"])
    return hit


def drift_inputs(files: DataFrame, sentinels: int = 64, folders: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Of ``files`` (path, mtime): the ``sentinels`` changed last, oldest of these first, and the counts of up to ``folders`` folders."""
    newest = files.orderBy(F.desc("mtime"), "path").limit(sentinels).orderBy("mtime", "path")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    counted = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files")).orderBy("folder").limit(folders)
    return newest, counted


def serialised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One JSON text a node and an edge, with camel-case keys; a missing confidence counts as 1."""
    camel = lambda c: c.split("_")[0] + "".join(x.capitalize() for x in c.split("_")[1:])
    node = F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in ("id", "label", "name", "file_path", "start_line", "end_line", "signature", "language", "class_name", "is_dead", "is_entry_point", "is_exported")]))
    edge = F.to_json(F.struct(F.col("rel_id").alias("id"), F.col("rel_type").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "strength", F.col("step_number").alias("stepNumber")))
    return nodes.select(node.alias("json")), edges.select(edge.alias("json"))


def branch_diff(base, current) -> DataFrame:
    """``(entity, kind, id)`` between two index builds of one repository, by id, in order."""
    from .intervals import structural_diff

    return structural_diff(base.nodes, current.nodes, base.edges, current.edges).orderBy("entity", "kind", "id")
