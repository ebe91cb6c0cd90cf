"""Extractors, file rules, the store and the index build."""

import pytest

from graphloom.plans import code_queries, indexing
from graphloom.sources import files, python_extract, script_extract
from graphloom.sources.storage import GraphStore


def test_python_calls_and_flags():
    out = python_extract.extract(
        "import asyncio\nfrom concurrent.futures import ThreadPoolExecutor\n\n@shared_task\ndef job():\n    pass\n\nasync def f(x: 'User') -> Account:\n    with ThreadPoolExecutor() as pool:\n        pool.submit(job)\n    try:\n        await g(job)\n    except ValueError:\n        h()\n    for i in k():\n        job.delay()\n    asyncio.create_task(g())\n    return g()\n"
    )
    calls = {(c["name"], c["receiver"]): c for c in out["calls"]}
    assert calls["submit", "pool"]["dispatch_kind"] == "thread_executor" and calls["submit", "pool"]["context_managers"] == ["ThreadPoolExecutor()"]
    assert calls["delay", "job"]["dispatch_kind"] == "enqueued_job" and calls["delay", "job"]["in_loop"]
    assert calls["create_task", "asyncio"]["dispatch_kind"] == "detached_task"
    assert calls["h", ""]["in_except"] and not calls["h", ""]["in_try"]
    assert calls["ValueError", ""]["line"] == 13
    first = next(c for c in out["calls"] if c["name"] == "g")
    assert first["awaited"] and first["in_try"] and first["return_consumption"] == "awaited" and first["arguments"] == ["job"]
    assert {(t["name"], t["role"]) for t in out["type_refs"]} == {("User", "param"), ("Account", "return")}


def test_python_members_and_broken_source():
    out = python_extract.extract("from enum import Enum\n__all__ = ['A']\nLIMIT = 3\nclass A(Enum):\n    X = 1\n    _y_ = 2\n@dataclass\nclass B:\n    a: int\n    b = field()\n    c = 1\ndef f():\n    B.a += LIMIT\n    return A.X\n")
    assert [(m["kind"], m["parent"], m["name"]) for m in out["members"]] == [("module_constant", "", "LIMIT"), ("enum_member", "A", "X"), ("class_attribute", "B", "a"), ("class_attribute", "B", "b")]
    assert {(a["owner"], a["name"], a["mode"]) for a in out["accesses"]} == {("B", "a", "both"), ("", "LIMIT", "read"), ("A", "X", "read")}
    assert out["exports"] == ["A"] and [s["kind"] for s in out["symbols"]] == ["enum", "class", "function"]
    assert not any(python_extract.extract("def broken(:").values())


def test_script():
    out = script_extract.extract("import { a, b as c } from './m';\nexport class P extends Q implements R {\n  run(x: User): Result {\n    try { await this.go(cb); } catch (e) {}\n    return new Thing(x);\n  }\n}\nexport const f = (y) => g(y);\ninterface I extends J { z: string }\ntype T = string;\nconst s = 'call(1)'; // call(2)\n")
    assert {(s["kind"], s["class_name"], s["name"]) for s in out["symbols"]} == {("class", "", "P"), ("method", "P", "run"), ("function", "", "f"), ("interface", "", "I"), ("type_alias", "", "T")}
    calls = {c["name"]: c for c in out["calls"]}
    assert set(calls) == {"go", "Thing", "g"} and calls["go"]["in_try"] and calls["go"]["awaited"] and calls["go"]["arguments"] == ["cb"]
    assert out["imports"][0]["names"] == ["a", "b"] and set(out["exports"]) == {"P", "f"}
    assert {(h["kind"], h["parent_name"]) for h in out["heritage"]} == {("extends", "Q"), ("implements", "R"), ("extends", "J")}
    assert {(t["name"], t["role"]) for t in out["type_refs"]} == {("User", "param"), ("Result", "return")}


def test_ignore_rules(spark):
    paths = ["src/a.py", "node_modules/x.js", "pkg.egg-info/y.py", "build/z.py", "docs/keep.py", "docs/drop.py", "tmp/a/b.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path for r in df.where(~files.ignored(df.path, "docs/*\n!docs/keep.py\ntmp/\n# note\n")).collect()}
    assert got == {"src/a.py", "docs/keep.py"}


def test_git_log_lines(spark):
    lines = ["COMMIT:a", "x.py", "y.py", "", "COMMIT:b", "x.py"]
    got = files.parse_log(spark.createDataFrame(list(enumerate(lines)), "n long, line string")).collect()
    assert sorted((r.commit_id, r.file_path) for r in got) == [("a", "x.py"), ("a", "y.py"), ("b", "x.py")]


def test_index_and_store(spark, tmp_path):
    graph = indexing.build(code_queries.sample_sources(spark))
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert sum(r.label == "file" for r in nodes.values()) == 6
    assert nodes["function:port/lantern.py:douse"].is_dead and not nodes["function:port/berth.py:spare"].is_dead
    kinds = {r.rel_type for r in graph.edges.select("rel_type").distinct().collect()}
    assert {"contains", "defines", "imports", "calls", "uses_type"} <= kinds
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(graph.nodes, graph.edges)
    store.check_version()
    assert store.nodes().count() == len(nodes) and store.node("function:port/berth.py:spare").count() == 1
    inbound = store.inbound_from_elsewhere("port/berth.py").count()
    store.delete_files(["port/berth.py"])
    assert store.node("function:port/berth.py:spare").count() == 0 and inbound > 0
    store.delete_edges("calls")
    assert store.edges().where("rel_type = 'calls'").count() == 0
    store.upsert(graph.nodes.where("file_path = 'port/berth.py'"), graph.edges.where("rel_type = 'calls'"))
    assert store.nodes().count() == len(nodes)


def test_reindex(spark, tmp_path):
    sources = code_queries.sample_sources(spark)
    graph = indexing.build(sources)
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(graph.nodes, graph.edges)
    text = "class Berth:\n    depth = 9\n\n\ndef spare(depth: int, draught: int) -> int:\n    return extra(depth)\n\n\ndef extra(depth):\n    return depth\n"
    changed = spark.createDataFrame([("port/berth.py", text, "python", 7)], "path string, content string, language string, ord long")
    indexing.reindex(store, changed, ["port/lantern.py"], small=True)
    calls = {(r.src, r.dst) for r in store.edges().where("rel_type = 'calls'").collect()}
    assert ("function:port/roster.py:moor", "function:port/berth.py:spare") in calls  # restored
    assert ("function:port/berth.py:spare", "function:port/berth.py:extra") in calls
    assert store.nodes().where("file_path = 'port/lantern.py'").count() == 0
    assert not store.node("function:port/berth.py:extra").first().is_dead
    indexing.reindex(store, changed, [])
    whole = indexing.build(sources.where("path not in ('port/berth.py', 'port/lantern.py')").unionByName(changed))
    plain = lambda df: {(r.rel_type, r.src, r.dst) for r in df.where("rel_type in ('calls', 'imports', 'contains', 'uses_type', 'defines')").collect()}
    assert plain(store.edges()) == plain(whole.edges)


def test_store_flags_and_vectors(spark, tmp_path):
    from graphloom.functions.schema import as_edges, as_nodes
    from graphloom.operators import analysis, search

    nodes = as_nodes(spark.createDataFrame([("function:a:f", "function", "f"), ("community::c", "community", "c")], "id string, label string, name string"))
    edges = as_edges(spark.createDataFrame([("member_of", "function:a:f", "community::c"), ("calls", "function:a:f", "function:a:f")], "rel_type string, src string, dst string"))
    store = GraphStore(spark, str(tmp_path / "g"))
    store.write(nodes, edges)
    store.update_dead(spark.createDataFrame([("function:a:f", True)], "id string, is_dead boolean"))
    assert store.node("function:a:f").first().is_dead
    store.delete_synthetic()
    assert store.nodes().count() == 1 and [r.rel_type for r in store.edges().collect()] == ["calls"]
    texts = analysis.node_texts(store.nodes(), store.edges())
    store.store_embeddings(search.embed(texts, lambda some: [[len(t), 1.0] for t in some], 2), "m1")
    store.store_embeddings(spark.createDataFrame([("x", [1.0, 2.0])], "id string, vec array<float>"), "m1")
    assert store.embeddings().count() == 2
    store.store_embeddings(spark.createDataFrame([("y", [1.0, 2.0])], "id string, vec array<float>"), "m2")
    assert [r.id for r in store.embeddings().collect()] == ["y"]
    assert search.embed(texts, lambda some: 1 / 0, 2).count() == 0
    assert '"isDead":true' in analysis.serialised(store.nodes(), store.edges())[0].first().json
    other = spark.createDataFrame([("a/x.py", 3.0), ("a/y.py", 5.0), ("b.py", 4.0)], "path string, mtime double")
    newest, counted = analysis.drift_inputs(other, 2)
    assert [r.path for r in newest.collect()] == ["b.py", "a/y.py"] and {(r.folder, r.files) for r in counted.collect()} == {("a", 2), ("", 1)}


def test_store_versions_and_meta(spark, tmp_path):
    from graphloom.functions.schema import as_edges, as_nodes
    from graphloom.sources.storage import KEPT_VERSIONS, ConcurrentWrite

    node = lambda *ids: as_nodes(spark.createDataFrame([(f"function:a:{i}", "function", i) for i in ids], "id string, label string, name string"))
    none = as_edges(spark.createDataFrame([], "rel_type string, src string, dst string"))
    path = str(tmp_path / "g")
    store = GraphStore(spark, path)
    assert store.meta() == {} and store.nodes().count() == 0 and store.text_index() is None
    store.write(node("f"), none)
    first, second = GraphStore(spark, path), GraphStore(spark, path)
    mine, yours = first.nodes(), second.nodes()
    first.write(mine.unionByName(node("g")), none)
    with pytest.raises(ConcurrentWrite):
        second.write(yours.unionByName(node("h")), none)
    second.write(second.nodes().unionByName(node("h")), none)  # begun anew
    assert sorted(r.name for r in store.nodes().collect()) == ["f", "g", "h"]
    assert mine.count() == 1  # an older version is still there
    store.write_meta({"stats": {"files": 3, "symbols": "many", "odd": True}, "head": "a"})
    store.write_meta({"stats": {"symbols": 4}, "sentinel_files": [{"path": "x", "mtime": "1.5"}, {"path": "y"}, 7]})
    found = store.meta()
    assert found["stats"] == {"files": 3, "symbols": 4} and found["head"] == "a" and found["sentinel_files"] == [{"path": "x", "mtime": 1.5}]
    last = sorted((tmp_path / "g" / "meta" / "repo=local").glob("*.json"))[-1]
    (last.parent / f"{int(last.stem) + 1:012d}.json").write_text('{"tables": {"no')  # a writer that died
    assert store.meta() == found
    store.write_meta({"head": "b"})
    assert store.meta() == found | {"head": "b"}
    for i in range(KEPT_VERSIONS + 1):
        store.delete_edges("calls")
    assert len(list((tmp_path / "g" / "edges" / "repo=local").glob("0*"))) == KEPT_VERSIONS


def test_stored_text_index_answers_as_the_texts_do(spark, tmp_path):
    from graphloom.operators import search
    from graphloom.plans.cypher import CypherError
    from graphloom.plans.tools import GraphTools

    rows = [("function:a.py:spare", "function", "spare", "a.py", "def spare(depth): return depth"), ("function:tests/test_a.py:t", "function", "t", "tests/test_a.py", "spare(1) spare(2)"), ("function:a.py:moor", "function", "moor", "a.py", ""), ("class:a.py:Berth", "class", "Berth", "a.py", "class Berth: depth = spare"), ("folder:spare", "folder", "spare", "", "")]
    nodes = indexing.as_nodes(spark.createDataFrame(rows, "id string, label string, name string, file_path string, content string"))
    edges = indexing.as_edges(spark.createDataFrame([], "rel_type string, src string, dst string"))
    store = GraphStore(spark, str(tmp_path / "graph"))
    store.write(nodes, edges)
    assert store.text_index() is None
    store.build_text_index()
    for text in ("spare berth", "nothing_of_the_kind"):
        scores = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
        assert scores(search.search_nodes(store.nodes(), text, 20, store.text_index())) == scores(search.search_nodes(nodes, text, 20))
    plan = store.text_index()[0].where("term in ('spare')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,spare)]" in plan or "In(term" in plan
    call = "CALL QUERY_FTS_INDEX('Function', 'function_fts', $q) YIELD node, score RETURN node.name AS name, score ORDER BY score DESC, name LIMIT 3"
    with_index = [tuple(r) for r in GraphTools.of(store).cypher(call, {"q": "spare"}).collect()]
    assert with_index and with_index == [tuple(r) for r in GraphTools(nodes, edges).cypher(call, {"q": "spare"}).collect()]
    assert with_index[0][0] == "spare"
    for wrong in ("CALL OTHER('a', 'b', 'c') RETURN node.id", "CALL QUERY_FTS_INDEX('Function', 'class_fts', 'x') RETURN node.id", "CALL QUERY_FTS_INDEX('Function') RETURN node.id"):
        with pytest.raises(CypherError):
            GraphTools.of(store).cypher(wrong)
    store.write(nodes, edges)
    assert store.text_index() is None  # nodes were written since


def test_node_texts_by_label(spark):
    from graphloom.operators import analysis

    rows = [("f", "function", "run", "a.py", "def run()", ""), ("m", "method", "go", "a.py", "def go(self)", "Cart"), ("n", "method", "ax", "a.py", "", "Cart"), ("o", "method", "zz", "b.py", "", "Cart"), ("c", "class", "Cart", "a.py", "ignored", ""), ("b", "class", "Base", "b.py", "", ""), ("file", "file", "a.py", "a.py", "", ""), ("dir", "folder", "src", "src", "", ""), ("t", "type_alias", "Id", "a.py", "Id = int", ""), ("k", "community", "core", "", "", ""), ("p", "process", "run flow", "", "", ""), ("x", "enum_member", "RED", "a.py", "RED = 1", "Hue")]
    nodes = indexing.as_nodes(spark.createDataFrame(rows, "id string, label string, name string, file_path string, signature string, class_name string"))
    links = [("calls", "f", "m"), ("calls", "f", "n"), ("calls", "m", "f"), ("uses_type", "m", "c"), ("extends", "c", "b"), ("defines", "file", "f"), ("defines", "file", "c"), ("contains", "dir", "file"), ("member_of", "f", "k"), ("member_of", "m", "k"), ("step_in_process", "f", "p"), ("calls", "f", "gone")]
    edges = indexing.as_edges(spark.createDataFrame(links, "rel_type string, src string, dst string"))
    got = {r.id: r.text for r in analysis.node_texts(nodes, edges).collect()}
    assert got == {
        "f": "function run in a.py\nsignature: def run()\ncalls: ax, go\ncalled by: go",
        "m": "method go of class Cart in a.py\nsignature: def go(self)\ncalls: run\ncalled by: run\nuses types: Cart",
        "n": "method ax of class Cart in a.py\ncalled by: run",
        "o": "method zz of class Cart in b.py",
        "c": "class Cart in a.py\nmethods: ax, go\nextends: Base",
        "b": "class Base in b.py",
        "file": "file a.py in a.py\ndefines: Cart, run",
        "dir": "folder src in src\ncontains: a.py",
        "t": "type_alias Id in a.py\nsignature: Id = int",
        "k": "community core\nmembers: go, run",
        "p": "process run flow\nsteps: run",
        "x": "enum_member RED in a.py",
    }
    short = {r.id: r.text for r in analysis.node_texts(nodes, edges, 25).collect()}
    assert short == {k: v[:25] for k, v in got.items()}


def test_refs_and_checkouts(tmp_path):
    import subprocess

    assert files.ref_range("main..feature/x") == ("main", "feature/x") and files.ref_range("HEAD~2") == ("HEAD~2", None)
    for wrong in ("", "..x", "x..", "-f", "a;b", "a b", "main..--output=x", "main\n"):
        with pytest.raises(ValueError):
            files.ref_range(wrong)
    assert files.safe_path("src/a b.py") == "src/a b.py"
    with pytest.raises(ValueError):
        files.safe_path("src/$(x)")
    root = tmp_path / "r"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("one = 1\n", "one = 2\n"):
        (root / "a.py").write_text(text)
        git("add", "a.py")
        git("commit", "-qm", "x")
    place = files.checked_out(str(root), "HEAD~1", str(tmp_path / "old"))
    assert (tmp_path / "old" / "a.py").read_text() == "one = 1\n"
    files.drop_checkout(str(root), place)
    assert not (tmp_path / "old").exists()
