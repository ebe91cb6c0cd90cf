import pytest

from graphloom.functions.schema import as_edges, as_nodes
from graphloom.plans.cypher import CypherError, cypher


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("f1", "function", "a", "x.py", True), ("f2", "function", "b", "x.py", False), ("f3", "function", "c", "y.py", False), ("t", "class", "T", "y.py", False)], "id string, label string, name string, file_path string, is_dead boolean")
    edges = spark.createDataFrame([("calls", "f1", "f2", 1.0), ("calls", "f2", "f3", 0.5), ("calls", "f3", "f1", 0.8), ("uses_type", "f1", "t", 1.0)], "rel_type string, src string, dst string, confidence double")
    return as_nodes(nodes), as_edges(edges)


def run(small, text, **params):
    return [tuple(r) for r in cypher(text, *small, params).collect()]


def test_directions_and_parameters(small):
    assert run(small, "MATCH (n:Function {name: $who})-[r:calls]->(m) RETURN m.name", who="a") == [("b",)]
    assert run(small, "MATCH (n:Function)<-[:CodeRelation]-(m) WHERE n.name = 'a' RETURN m.name") == [("c",)]
    assert sorted(run(small, "MATCH (n {name: 'a'})-[r]-(m) RETURN m.name")) == [("T",), ("b",), ("c",)]


def test_optional_collect_and_paths(small):
    assert run(small, "MATCH (n:Function) OPTIONAL MATCH (n)-[:uses_type]->(t:Class) RETURN n.name AS n, collect(t.name) AS t ORDER BY n") == [("a", ["T"]), ("b", []), ("c", [])]
    assert sorted(run(small, "MATCH (n {name: 'a'})-[:calls*1..2]->(m) RETURN m.name")) == [("b",), ("c",)]
    assert run(small, "MATCH (n:Function) WITH n.file_path AS f, count(*) AS k WHERE k > 1 RETURN f, k") == [("x.py", 2)]
    assert run(small, "MATCH (n:Function) RETURN DISTINCT n.file_path AS f ORDER BY f SKIP 1 LIMIT 1") == [("y.py",)]
    assert run(small, "UNWIND [1, 2, 3] AS x RETURN sum(x) AS s") == [(6,)]
    assert run(small, "MATCH (n:Function) WHERE n.name STARTS WITH 'a' OR n.name IN ['c'] RETURN n.name ORDER BY n.name DESC") == [("c",), ("a",)]


def test_a_relationship_is_used_once(small):
    assert run(small, "MATCH (a)-[r:calls]->(b), (c)-[s:calls]->(d) WHERE a.id = c.id RETURN count(*)") == [(0,)]


@pytest.mark.parametrize("text", ["CREATE (n) RETURN n", "MATCH (n) SET n.x = 1 RETURN n", "MATCH (n RETURN n", "MATCH (n) RETURN m.name", "RETURN 1 /* " + "x" * 100_001])
def test_refusals(small, text):
    with pytest.raises(CypherError):
        run(small, text)


def test_comments_are_no_writes(small):
    assert run(small, "MATCH (n:Class) // DELETE\nRETURN n.name") == [("T",)]
