"""Iterative and order-dependent operators against small sequential models."""

import itertools
import random
from collections import defaultdict, deque

import pytest

from graphloom.operators import communities, coupling, flows, traversal
from graphloom.plans import catalog
from graphloom.sources import tables


def graph(seed, n, m):
    draw = random.Random(seed)
    return sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(m)})


def hops(edges, start, most):
    seen, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        if seen[u] < most:
            for a, b in edges:
                if a == u and b not in seen:
                    seen[b] = seen[u] + 1
                    queue.append(b)
    return {k: v for k, v in seen.items() if k != start}


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs(spark, seed):
    edges = graph(seed, 30, 60)
    df = spark.createDataFrame(edges, "src long, dst long")
    start = spark.createDataFrame([(edges[0][0],)], "id long")
    got = {r.id: r.depth for r in traversal.bfs(df, start, 4).collect()}
    assert got == hops(edges, edges[0][0], 4)
    assert {r.id for r in traversal.bfs(df, start, 99, "callers").collect()} == set(hops([(b, a) for a, b in edges], edges[0][0], 10))


def test_bfs_of_nothing(spark):
    df = spark.createDataFrame([], "src long, dst long")
    assert traversal.bfs(df, spark.createDataFrame([(1,)], "id long"), 3).count() == 0
    assert traversal.shortest_path(df, 1, 2).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_strong_components(spark, seed):
    edges = graph(seed, 16, 26)
    reach = {u: set(hops(edges, u, 99)) | {u} for u in range(16)}
    ids = {x for e in edges for x in e}
    want = {u: min(v for v in ids if v in reach[u] and u in reach[v]) for u in ids}
    got = {r.id: r.component for r in traversal.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def sequential_flow(out, entry, depth, branching, most):
    result, queue = [entry], deque([(entry, 0)])
    while queue and len(result) < most:
        at, d = queue.popleft()
        if d >= depth:
            continue
        new = [t for t in out[at] if t not in result][: min(branching, most - len(result))]
        result += new
        queue += [(t, d + 1) for t in new]
    return result


def test_flows_follow_the_queue(spark):
    draw = random.Random(9)
    edges = [(a, b, draw.randint(1, 5) / 5) for a, b in graph(9, 40, 220) if a != b]
    out = defaultdict(list)
    for a, b, _ in sorted(edges, key=lambda e: (e[0], -e[2], e[1])):
        out[a].append(b)
    got = {r.entry: list(r.steps) for r in flows.trace_flows(spark.createDataFrame(edges, "src long, dst long, confidence double"), spark.range(10)).collect()}
    assert got == {e: sequential_flow(out, e, 6, 3, 25) for e in range(10)}


def test_flow_dedup_is_greedy(spark):
    draw = random.Random(5)
    sets = [(i, draw.sample(range(14), draw.randint(1, 6))) for i in range(25)]
    kept = []
    for i, s in sorted(sets, key=lambda x: (-len(x[1]), x[0])):
        if all(len(set(s) & set(k)) / min(len(s), len(k)) <= 0.5 for _, k in kept):
            kept.append((i, s))
    got = {r.entry for r in flows.dedup_flows(spark.createDataFrame(sets, "entry long, steps array<long>")).collect()}
    assert got == {i for i, s in kept if len(s) > 1}


def greedily(sets, overlap):
    kept = []
    for i, s in sorted(sets, key=lambda x: (-len(x[1]), x[0])):
        if all(len(set(s) & set(k)) / min(len(s), len(k)) <= overlap for _, k in kept):
            kept.append((i, s))
    return {i for i, s in kept if len(s) > 1}


@pytest.mark.parametrize("overlap, first", [(0.5, 1), (0.3, 2)])
def test_flow_dedup_in_rounds_that_see_few_flows(spark, monkeypatch, overlap, first):
    draw = random.Random(11)
    sets = [(i, draw.sample(range(9 if i % 2 else 40), draw.randint(1, 8))) for i in range(40)] + [(40, [1, 1, 2, 3])]
    monkeypatch.setattr(flows, "FIRST", first, raising=False)
    monkeypatch.setattr(flows, "FLOWS_A_TASK", 15, raising=False)
    got = {r.entry for r in flows.dedup_flows(spark.createDataFrame(sets, "entry long, steps array<long>"), overlap).collect()}
    assert got == greedily(sets, overlap)


def test_flow_dedup_writes_no_table_of_pairs(spark, monkeypatch):
    sets = [(i, [1, 2, 3, 4]) for i in range(120)] + [(200 + i, [1, 1000 + i, 2000 + i]) for i in range(120)]
    write, sizes = flows.materialize, []

    def counted(df, label):
        sizes.append((out := write(df, label)).count())
        return out

    monkeypatch.setattr(flows, "materialize", counted)
    got = {r.entry for r in flows.dedup_flows(spark.createDataFrame(sets, "entry long, steps array<long>")).collect()}
    assert got == {0} | {200 + i for i in range(120)}
    assert max(sizes) <= sum(len(s) for _, s in sets)


def test_supplier_calls_take_a_line_once_by_its_least_flag(spark, tmp_path):
    lines = [(1, 1, 5, "R"), (1, 1, 5, "A"), (1, 1, 5, None), (1, 2, 6, "N"), (1, 2, 6, "N"), (1, 3, 5, "B"), (None, 1, 7, "A"), (None, 2, 8, None), (2, None, None, "A"), (2, None, None, "A"), (2, 1, 6, "C"), (2, 2, 5, "C")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    calls = tables.supplier_calls(spark, str(tmp_path))
    assert {(r.src, r.dst, r.n, r.kind) for r in calls.collect()} == {(5, 6, 1, "A"), (6, 5, 2, "C"), (7, 8, 1, "A")}
    assert "partial_min(l_returnflag" not in calls._jdf.queryExecution().executedPlan().toString()  # no sort of what a task scans


def test_flow_queries_take_all_suppliers_and_whole_flows(spark):
    sf = "/root/testdata/sf0.01"
    suppliers = {r.s_suppkey: r for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    out = defaultdict(list)
    for e in sorted(tables.supplier_calls(spark, sf).collect(), key=lambda e: (e.src, -e.confidence, e.dst)):
        out[e.src].append(e.dst)
    want = {s: sequential_flow(out, s, 6, 3, 25) for s in suppliers}
    assert {r.entry: list(r.steps) for r in catalog.QUERIES["flow_trace"](spark, sf).collect()} == want
    kept = []
    for s in sorted(want, key=lambda s: (-len(want[s]), s)):
        if all(len(set(want[s]) & set(want[k])) / min(len(want[s]), len(want[k])) <= 0.5 for k in kept):
            kept.append(s)
    assert {r.entry: list(r.steps) for r in catalog.QUERIES["flow_dedup"](spark, sf).collect()} == {s: want[s] for s in kept if len(want[s]) > 1}
    kinds = {s: (len(f), " → ".join(suppliers[x].s_name for x in f[:4]), "intra_community" if len({suppliers[x].s_nationkey for x in f}) == 1 else "cross_community") for s, f in want.items()}
    assert {r.entry: (r.step_count, r.label, r.kind) for r in catalog.QUERIES["flow_kind"](spark, sf).collect()} == kinds


def test_two_clusters(spark):
    a, b = ["validate", "hash", "check"], ["query", "format", "cache"]
    edges = [(x, y, 1.0) for g in (a, b) for x, y in itertools.permutations(g, 2)] + [("validate", "query", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    for method in ("louvain", "propagation"):
        groups = defaultdict(set)
        for r in communities.communities(df, method).collect():
            groups[r.community].add(r.id)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (a, b)))
    assert communities.communities(df.limit(1)).count() == 0


def test_communities_are_modular_at_any_size(spark, monkeypatch):
    draw = random.Random(6)
    edges = [(a, b, draw.randint(1, 4) / 4) for a, b in graph(6, 40, 70) if a < b] + [(i, i + 1, 1.0) for i in range(39)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    monkeypatch.setattr(communities, "LOUVAIN_EDGES", 0, raising=False)  # a former switch to another method
    found = {r.id: r.community for r in communities.communities(df, least=1).collect()}
    degree, two = defaultdict(float), 2 * sum(w for *_, w in edges)
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w

    def modularity(of):
        tot = defaultdict(float)
        for v, c in of.items():
            tot[c] += degree[v]
        return sum(2 * w for a, b, w in edges if of[a] == of[b]) / two - sum(t * t for t in tot.values()) / two**2

    whole = modularity(found)
    assert found.keys() == degree.keys() and whole > 0.4
    groups = set(found.values())  # no two communities are better as one
    assert all(modularity({v: a if c == b else c for v, c in found.items()}) <= whole + 1e-9 for a, b in itertools.combinations(groups, 2))
    one_task = {r.id: r.community for r in communities.communities(df, "louvain", least=1).collect()}
    assert whole > modularity(one_task) - 0.05


def broadcasts(module, monkeypatch):
    """Whether each table that ``module`` writes is planned with a broadcast."""
    seen = []
    write = module.materialize

    def watched(df, label):
        seen.append("Broadcast" in df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(module, "materialize", watched)
    return seen


@pytest.mark.parametrize("method", [None, "propagation"])
def test_rounds_of_communities_broadcast_nothing(spark, monkeypatch, method):
    df = spark.createDataFrame([(a, b, 1.0) for a, b in graph(7, 12, 24)], "src long, dst long, weight double")
    seen = broadcasts(communities, monkeypatch)
    found = communities.communities(df, method)
    assert len(seen) > 4 and not any(seen)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_coupling_of_the_fixture(spark):
    commits = [(f"c{i}", f) for i in range(4) for f in ("auth", "models")] + [("c4", "auth"), ("c5", "models"), ("c6", "views"), ("c6", "utils")]
    df = spark.createDataFrame(commits, "commit_id string, file_path string")
    got = {(r.a, r.b): r.strength for r in coupling.coupling(df, min_cochanges=1).collect()}
    assert got == {("auth", "models"): 0.8, ("utils", "views"): 1.0}
    assert {(r.a, r.b) for r in coupling.coupling(df).collect()} == {("auth", "models")}
    big = spark.createDataFrame([("c", f"f{i}") for i in range(51)], "commit_id string, file_path string")
    assert coupling.coupling(big, min_cochanges=1).count() == 0
