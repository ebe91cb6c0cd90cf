import pytest

from graphloom.plans import code_queries, indexing, tools


@pytest.fixture(scope="module")
def graph(spark):
    g = indexing.build(code_queries.sample_sources(spark))
    return tools.GraphTools(g.nodes, g.edges)


def test_symbol_queries(graph):
    assert [r.id for r in graph.resolve("Berth.widen").collect()] == ["method:port/berth.py:Berth.widen"]
    assert {(r.name, r.depth, r.group) for r in graph.impact("spare").collect()} == {("moor", 1, "will break"), ("takes", 1, "will break"), ("announce", 2, "may break")}
    sections = {(r.section, r.name) for r in graph.context("moor").collect()}
    assert {("callers", "announce"), ("callees", "spare"), ("callees", "book")} <= sections
    assert [r.name for r in graph.call_path("announce", "spare").orderBy("hop").collect()] == ["announce", "moor", "spare"]
    assert graph.concurrent_with("moor").count() == 0
    assert "spare" in {r.name for r in graph.query("spare").collect()}


def test_reports(graph):
    assert "port/lantern.py" in {r.file_path for r in graph.dead_code().collect()}
    diff = "diff --git a/port/berth.py b/port/berth.py\n@@ -11 +11 @@\n+x\n"
    assert {r.name for r in graph.detect_changes(diff).collect()} == {"spare"}
    assert graph.test_impact(diff).count() == 0 and graph.review_risk(diff).first().level == "LOW"
    assert {("symbol", "moor"), ("imports", "port/berth.py"), ("imported by", "port/bulletin.py")} <= {(r.section, r.name) for r in graph.file_context("port/roster.py").collect()}
    assert graph.cycles().count() == 0
    with pytest.raises(ValueError):
        graph.detect_changes("x" * 100_001)
    assert graph.cypher("MATCH (n:Function) RETURN count(n) AS n").first().n == 7
