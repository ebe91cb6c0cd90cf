"""Queries on code graphs: small fixtures given as rows, and Cypher over a code-like graph of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.schema import as_edges, as_nodes
from graphloom.operators import analysis, dead_code, flows, intervals, resolve
from graphloom.plans import indexing
from graphloom.plans.cypher import cypher
from graphloom.plans.graph_queries import _EDGES
from graphloom.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def values(rows: list[tuple]) -> str:
    """SQL VALUES of plain rows; the same rows feed Spark."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


SYMBOLS = [
    ("function:cargo/crane.py:hoist", "function", "hoist", "cargo/crane.py", 1, 10, "", 0),
    ("function:cargo/crane.py:weigh", "function", "weigh", "cargo/crane.py", 12, 20, "", 1),
    ("function:cargo/shift.py:begin_shift", "function", "begin_shift", "cargo/shift.py", 1, 15, "", 2),
    ("function:cargo/tags.py:tag", "function", "tag", "cargo/tags.py", 1, 5, "", 3),
    ("class:cargo/crate.py:Crate", "class", "Crate", "cargo/crate.py", 1, 30, "", 4),
    ("method:cargo/crate.py:Crate.seal", "method", "seal", "cargo/crate.py", 3, 9, "Crate", 5),
    ("method:cargo/crate.py:Crate.unpack", "method", "unpack", "cargo/crate.py", 11, 19, "Crate", 6),
    ("function:tests/test_crane.py:test_hoist", "function", "test_hoist", "tests/test_crane.py", 1, 6, "", 7),
    ("function:yard/deep/tags.py:tag", "function", "tag", "yard/deep/tags.py", 1, 5, "", 8),
]
_SYMBOL_COLUMNS = "id, label, name, file_path, start_line, end_line, class_name, ord"
_SYMBOL_SCHEMA = "id string, label string, name string, file_path string, start_line long, end_line long, class_name string, ord long"
CALLS = [
    ("c1", "weigh", "cargo/crane.py", "", ""), ("c2", "hoist", "cargo/shift.py", "", ""), ("c3", "tag", "cargo/shift.py", "", ""), ("c4", "unpack", "cargo/crate.py", "self", "Crate"), ("c5", "print", "cargo/shift.py", "", ""), ("c6", "nowhere", "cargo/shift.py", "", ""),
    ("c7", "seal", "cargo/shift.py", "crate", ""), ("c8", "hoist", "tests/test_crane.py", "", ""),
]
IMPORTED = [("cargo/shift.py", "hoist", "cargo/crane.py"), ("tests/test_crane.py", "*", "cargo/crane.py")]
CALL_EDGES = [("function:cargo/shift.py:begin_shift", "function:cargo/crane.py:hoist"), ("function:cargo/crane.py:hoist", "function:cargo/crane.py:weigh"), ("function:tests/test_crane.py:test_hoist", "function:cargo/shift.py:begin_shift"), ("function:cargo/shift.py:begin_shift", "method:cargo/crate.py:Crate.seal")]
DIFF = "diff --git a/cargo/crane.py b/cargo/crane.py\n--- a/cargo/crane.py\n+++ b/cargo/crane.py\n@@ -5,2 +5,3 @@ def hoist\n+x\n@@ -14 +15 @@\n+y\ndiff --git a/cargo/crate.py b/cargo/crate.py\n@@ -10,0 +10,0 @@\n"
HUNKS = [("cargo/crane.py", 5, 7), ("cargo/crane.py", 15, 15), ("cargo/crate.py", 10, 10)]
_FIXTURE = f"s({_SYMBOL_COLUMNS}) AS ({values(SYMBOLS)}), h(file_path, a, b) AS ({values(HUNKS)}), ce(src, dst) AS ({values(CALL_EDGES)}), ch AS (SELECT DISTINCT s.* FROM s JOIN h ON s.file_path = h.file_path AND s.start_line <= h.b AND s.end_line >= h.a WHERE s.start_line > 0)"


def _symbols(spark) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, _SYMBOL_SCHEMA)


def _hunks(spark) -> DataFrame:
    return intervals.diff_hunks(intervals.diff_text(spark, DIFF))


@query(f"WITH {_FIXTURE} SELECT id, name, file_path FROM ch")
def diff_overlap(spark, sf_dir):
    """Symbols that a unified diff touches."""
    return intervals.overlapping(_symbols(spark), _hunks(spark)).select("id", "name", "file_path")


@query(f"""WITH s({_SYMBOL_COLUMNS}) AS ({values(SYMBOLS)}), c(call_id, name, file_path, receiver, cls) AS ({values(CALLS)}), i(file_path, name, target) AS ({values(IMPORTED)}),
l AS (SELECT *, CASE label WHEN 'function' THEN 1 WHEN 'method' THEN 2 ELSE 3 END AS lr FROM s), live AS (SELECT * FROM c WHERE name NOT IN ('print')),
t AS (SELECT call_id, id, 1 AS tier, CASE WHEN l.class_name = cls THEN 0 ELSE 1 END AS k1, 0 AS k2, lr, ord FROM live JOIN l ON l.name = live.name AND l.file_path = live.file_path WHERE receiver IN ('self', 'this') AND label = 'method'
UNION ALL SELECT call_id, id, 2, 0, 0, lr, ord FROM live JOIN l ON l.name = live.name AND l.file_path = live.file_path
UNION ALL SELECT call_id, id, 3, 0, 0, lr, ord FROM live JOIN i ON i.file_path = live.file_path AND i.name IN (live.name, '*') JOIN l ON l.name = live.name AND l.file_path = i.target
UNION ALL SELECT call_id, id, 4, CASE WHEN split_part(l.file_path, '/', 1) = split_part(live.file_path, '/', 1) THEN -1 ELSE 0 END, length(l.file_path), lr, ord FROM live JOIN l ON l.name = live.name),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY tier, k1, k2, lr, ord) AS n FROM t)
SELECT call_id, id AS target, CASE tier WHEN 4 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, tier FROM r WHERE n = 1""")
def resolve_cascade(spark, sf_dir):
    """Calls resolved by the first tier that finds a symbol."""
    calls = spark.createDataFrame(CALLS, "call_id string, name string, file_path string, receiver string, caller_class string")
    return resolve.resolve_calls(calls, _symbols(spark), spark.createDataFrame(IMPORTED, "file_path string, name string, target_file string"))


IMPORTS = [
    ("i1", "fleet/crew/deck.py", ".ranks", ["Sailor"], True, "python"), ("i2", "fleet/crew/deck.py", "..ropes", ["tag"], True, "python"), ("i3", "fleet/crew/deck.py", "crew.galley", ["x"], False, "python"), ("i4", "quay/gauge.ts", "./tide", ["level"], True, "typescript"), ("i5", "quay/a/b.ts", "../tide", ["level"], True, "typescript"),
    ("i6", "quay/gauge.ts", "./winch", ["t"], True, "typescript"), ("i7", "fleet/crew/deck.py", "os", ["os"], False, "python"), ("i8", "fleet/crew/deck.py", ".", ["ranks"], True, "python"), ("i9", "fleet/crew/deck.py", ".ranks", ["Mate"], True, "python"),
]
FILES = [("fleet/crew/__init__.py", "python"), ("fleet/crew/deck.py", "python"), ("fleet/crew/ranks.py", "python"), ("fleet/ropes.py", "python"), ("fleet/crew/galley/__init__.py", "python"), ("quay/gauge.ts", "typescript"), ("quay/tide.ts", "typescript"), ("quay/winch/index.ts", "typescript"), ("quay/a/b.ts", "typescript")]


@query(f"""WITH e(src, dst, symbols) AS ({values([("fleet/crew/deck.py", "fleet/crew/ranks.py", "Mate,Sailor"), ("fleet/crew/deck.py", "fleet/ropes.py", "tag"), ("fleet/crew/deck.py", "fleet/crew/galley/__init__.py", "x"), ("quay/gauge.ts", "quay/tide.ts", "level"), ("quay/a/b.ts", "quay/tide.ts", "level"), ("quay/gauge.ts", "quay/winch/index.ts", "t"), ("fleet/crew/deck.py", "fleet/crew/__init__.py", "ranks")])}) SELECT src, dst, symbols FROM e""")
def resolve_imports(spark, sf_dir):
    """Relative, absolute and script imports as file edges."""
    imports = spark.createDataFrame([r[:5] for r in IMPORTS], "import_id string, file_path string, module string, names array<string>, is_relative boolean")
    return resolve.import_edges(resolve.resolve_imports(imports, spark.createDataFrame(FILES, "path string, language string")))


_NODES = [
    ("n1", "function", "main", "src/main.py", "", True, False, [], [], False), ("n2", "function", "hoist", "cargo/crane.py", "", False, False, [], [], False), ("n3", "function", "spare_hook", "cargo/crane.py", "", False, False, [], [], False), ("n4", "method", "__init__", "cargo/crate.py", "Crate", False, False, [], [], False),
    ("n5", "function", "test_hoist", "src/tests/test_crane.py", "", False, False, [], [], False), ("n6", "function", "lost_tag", "cargo/tags.py", "", False, False, [], [], False), ("n7", "class", "Closer", "src/p.py", "", False, False, [], ["Protocol"], True), ("n8", "method", "close", "src/p.py", "Closer", False, False, [], [], False),
    ("n9", "class", "Pool", "src/q.py", "", False, False, [], [], False), ("n10", "method", "close", "src/q.py", "Pool", False, False, [], [], False), ("n11", "method", "drain", "src/q.py", "Pool", False, False, [], [], False), ("n12", "function", "job", "src/w.py", "", False, False, ["app.task"], [], False),
    ("n13", "function", "cached", "src/w.py", "", False, False, ["functools.cache"], [], False), ("n14", "class", "Base", "src/b.py", "", False, False, [], [], False), ("n15", "method", "run", "src/b.py", "Base", False, False, [], [], False), ("n16", "class", "Child", "src/b.py", "", False, False, [], ["Base"], False),
    ("n17", "method", "run", "src/b.py", "Child", False, False, [], [], False), ("n18", "function", "public", "src/__init__.py", "", False, False, [], [], False),
]
_LINKS = [("n1", "n2", "calls"), ("n1", "n15", "calls"), ("n16", "n14", "extends"), ("n2", "n14", "uses_type")]


@query(f"""WITH n(id, label, name, p, cls, entry, exported, decs, bases, proto) AS ({values([(*r[:7], ",".join(r[7]), ",".join(r[8]), r[9]) for r in _NODES])}), l(src, dst, t) AS ({values(_LINKS)}),
d AS (SELECT *, NOT EXISTS (SELECT 1 FROM l WHERE dst = id AND t = 'calls') AND NOT (label = 'class' AND EXISTS (SELECT 1 FROM l WHERE dst = id AND t = 'uses_type'))
  AND NOT (entry OR exported OR name IN ('__init__', '__new__') OR starts_with(name, 'test_') OR contains(p, '/tests/') OR (ends_with(p, '__init__.py') AND NOT starts_with(name, '_')) OR decs LIKE 'app.%') AS dead FROM n),
o AS (SELECT m.id FROM d m JOIN d c ON c.label = 'class' AND c.name = m.cls JOIN l ON l.src = c.id AND l.t = 'extends' JOIN d b ON b.id = l.dst JOIN d bm ON bm.label = 'method' AND bm.cls = b.name AND bm.name = m.name AND NOT bm.dead WHERE m.label = 'method' AND m.dead),
q AS (SELECT p.name AS proto, m.name FROM d p JOIN d m ON m.label = 'method' AND m.cls = p.name WHERE p.label = 'class' AND p.proto AND NOT starts_with(m.name, '__')),
k AS (SELECT DISTINCT m.cls, q.proto FROM d m JOIN q ON q.name = m.name WHERE m.label = 'method' AND m.cls <> q.proto GROUP BY m.cls, q.proto HAVING count(DISTINCT m.name) = (SELECT count(*) FROM q x WHERE x.proto = q.proto)),
z AS (SELECT id FROM o UNION SELECT m.id FROM d m JOIN k ON k.cls = m.cls JOIN q ON q.proto = k.proto AND q.name = m.name WHERE m.label = 'method' UNION SELECT m.id FROM d m JOIN q ON q.proto = m.cls)
SELECT id, dead AND id NOT IN (SELECT id FROM z) AS is_dead FROM d""")
def dead_nodes(spark, sf_dir):
    """Unreachable symbols, with exemptions, overrides and protocols."""
    nodes = spark.createDataFrame(_NODES, "id string, label string, name string, file_path string, class_name string, is_entry_point boolean, is_exported boolean, decorators array<string>, bases array<string>, is_protocol boolean")
    return dead_code.dead_symbols(nodes, spark.createDataFrame(_LINKS, "src string, dst string, rel_type string"))


_CLASSES = [("a", "A", "class", "x.py", 0), ("a2", "A", "class", "y.py", 1), ("b", "B", "class", "x.py", 2), ("c", "C", "class", "y.py", 3), ("i", "I", "interface", "z.ts", 4), ("p", "P", "class", "y.py", 5)]
_HERITAGE = [("B", "extends", "A", "x.py"), ("C", "implements", "I", "y.py"), ("P", "extends", "Protocol", "y.py"), ("P", "extends", "Unknown", "y.py")]


@query(f"""WITH s(id, name, label, f, ord) AS ({values(_CLASSES)}), h(child, kind, parent, f) AS ({values(_HERITAGE)}),
r AS (SELECT c.id AS child, kind, p.id AS parent, row_number() OVER (PARTITION BY h.child, kind, h.parent, h.f ORDER BY c.f <> h.f, c.ord, p.f <> h.f, p.ord) AS n FROM h JOIN s c ON c.name = h.child JOIN s p ON p.name = h.parent)
SELECT child, kind, parent FROM r WHERE n = 1""")
def heritage_patch(spark, sf_dir):
    """Heritage by name, same file first; an unknown Protocol parent only marks its child."""
    symbols = spark.createDataFrame(_CLASSES, "id string, name string, label string, file_path string, ord long")
    return resolve.heritage_edges(spark.createDataFrame(_HERITAGE, "child_name string, kind string, parent_name string, file_path string"), symbols)[0]


@query(f"""WITH m(src, dst, line, mode, confidence) AS ({values([("f1", "Status.A", 3, "read", 1.0), ("f2", "Status.A", 9, "write", 0.8), ("f2", "LIMIT", 4, "read", 0.8), ("f1", "LIMIT2", 5, "both", 1.0)])}) SELECT src, dst, CAST(line AS BIGINT) AS line, mode, CAST(confidence AS DOUBLE) AS confidence FROM m""")
def member_access(spark, sf_dir):
    """Accesses of members by owner and of constants by name."""
    members = spark.createDataFrame([("Status.A", "A", "Status", "a.py", "enum_member"), ("LIMIT", "LIMIT", "", "a.py", "module_constant"), ("LIMIT2", "LIMIT2", "", "a.py", "module_constant")], "id string, name string, class_name string, file_path string, label string")
    uses = spark.createDataFrame([("f1", "Status", "A", 3, "read", "a.py"), ("f2", "Status", "A", 9, "write", "b.py"), ("f2", "", "LIMIT", 4, "read", "b.py"), ("f1", "", "LIMIT2", 5, "both", "a.py"), (None, "Status", "A", 1, "read", "a.py"), ("f2", "", "LIMIT2", 7, "read", "b.py")], "src string, owner string, name string, line long, mode string, file_path string")
    return resolve.member_edges(uses, members, spark.createDataFrame([("b.py", "LIMIT", "a.py")], "file_path string, name string, target_file string"))


_ENTRY = [("e1", "function", "main", "src/x.py", "python", "", False), ("e2", "function", "helper", "src/x.py", "python", "", False), ("e3", "function", "show", "src/cli.py", "python", "", False), ("e4", "method", "show", "src/cli.py", "python", "", False), ("e5", "function", "page", "web/page.tsx", "tsx", "", True), ("e6", "function", "upgrade", "db/alembic/versions/1.py", "python", "", False), ("e7", "function", "list_users", "api.py", "python", "@router.get('/u')", False), ("e8", "function", "handler", "srv.ts", "typescript", "", False), ("e9", "class", "main", "src/x.py", "python", "", False)]


@query(f"""WITH n(id, label, name, p, lang, content, exported) AS ({values(_ENTRY)}) SELECT id FROM n WHERE label IN ('function', 'method') AND (exported OR name IN ('main', 'cli', 'run', 'app', 'handler', 'entrypoint') OR (label = 'function' AND (ends_with(p, 'cli.py') OR ends_with(p, 'main.py') OR ends_with(p, 'app.py')))
OR ((lang = 'python' OR ends_with(p, '.py')) AND (starts_with(name, 'test_') OR contains(content, '@app.route') OR contains(content, '@router') OR contains(content, '@click.command') OR (name IN ('upgrade', 'downgrade') AND contains(p, '/alembic/versions/')))) OR (lang = 'typescript' AND name IN ('handler', 'middleware')))""")
def entry_points(spark, sf_dir):
    """Where execution starts."""
    return flows.entry_points(spark.createDataFrame(_ENTRY, "id string, label string, name string, file_path string, language string, content string, is_exported boolean")).select("id")


@query(f"""WITH RECURSIVE {_FIXTURE}, w(id, d) AS (SELECT id, 0 FROM ch UNION SELECT ce.src, w.d + 1 FROM w JOIN ce ON ce.dst = w.id WHERE w.d < 4), m AS (SELECT id, min(d) AS d FROM w GROUP BY id)
SELECT s.id, s.name, s.file_path, CASE WHEN m.d <= 2 THEN 'direct' ELSE 'transitive' END AS reach FROM s JOIN m ON m.id = s.id WHERE starts_with(s.file_path, 'tests/')""")
def test_impact(spark, sf_dir):
    """Tests that reach changed symbols."""
    return analysis.test_impact(_symbols(spark), spark.createDataFrame(CALL_EDGES, "src string, dst string"), _hunks(spark))


_COUPLED = [("cargo/crane.py", "cargo/scale.py", 0.8), ("cargo/crane.py", "cargo/crate.py", 0.9), ("src/a.py", "cargo/crate.py", 0.4)]
_MEMBERS = [("function:cargo/crane.py:hoist", 0), ("function:cargo/crane.py:weigh", 0), ("class:cargo/crate.py:Crate", 1)]


@query(f"""WITH {_FIXTURE}, cp(a, b, strength) AS ({values(_COUPLED)}), mb(id, community) AS ({values(_MEMBERS)}), f AS (SELECT DISTINCT file_path FROM h),
ms AS (SELECT DISTINCT other FROM (SELECT a AS id, b AS other FROM cp WHERE strength >= 0.5 UNION SELECT b, a FROM cp WHERE strength >= 0.5) WHERE id IN (SELECT * FROM f) AND other NOT IN (SELECT * FROM f)),
o AS (SELECT ch.id AS src, ce.src AS id FROM ch JOIN ce ON ce.dst = ch.id WHERE ce.src <> ch.id), dp AS (SELECT src, id FROM o UNION SELECT o.src, ce.src FROM o JOIN ce ON ce.dst = o.id WHERE ce.src <> o.src),
r AS (SELECT (SELECT count(*) FROM ch WHERE name = 'hoist') AS entries, (SELECT count(*) FROM ch) AS symbols, (SELECT count(*) FROM ms) AS missing, (SELECT count(*) FROM dp) AS dependents, (SELECT count(DISTINCT community) FROM mb WHERE id IN (SELECT id FROM ch)) AS communities)
SELECT *, CAST(least(10, entries + missing + dependents // 10 + CASE WHEN communities > 1 THEN 2 ELSE 0 END) AS BIGINT) AS score, CASE WHEN entries + missing + dependents // 10 + CASE WHEN communities > 1 THEN 2 ELSE 0 END <= 3 THEN 'LOW' WHEN entries + missing + dependents // 10 + CASE WHEN communities > 1 THEN 2 ELSE 0 END <= 6 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM r""")
def review_risk(spark, sf_dir):
    """A10: risk of a change."""
    symbols = _symbols(spark).withColumn("is_entry_point", F.col("name") == "hoist")
    return analysis.review_risk(symbols, spark.createDataFrame(CALL_EDGES, "src string, dst string"), spark.createDataFrame(_COUPLED, "a string, b string, strength double"), spark.createDataFrame(_MEMBERS, "id string, community long"), _hunks(spark))


_META = [("a", "2024-01-01T00:10:00", "2024-01-01T00:08:30"), ("b", "2024-01-01T00:10:00", "2024-01-01T00:09:30"), ("c", "2024-01-01T00:10:00", None), ("d", "nonsense", "2024-01-01T00:09:30")]


@query(f"""WITH m(repo, i, g) AS ({values(_META)}) SELECT repo, CAST(date_diff('second', try_cast(g AS TIMESTAMP), try_cast(i AS TIMESTAMP)) AS BIGINT) AS lag, coalesce(date_diff('second', try_cast(g AS TIMESTAMP), try_cast(i AS TIMESTAMP)) > 60, false) AS stale FROM m""")
def staleness_lag(spark, sf_dir):
    """Repositories whose global phases lag behind."""
    return analysis.staleness(spark.createDataFrame(_META, "repo string, incremental_at string, global_at string")).select("repo", "lag", "stale")


_DRIFT = [("a", True, 100, True, True, True, 0, 0, 10, 0, 0, 0, 0), ("b", False, 100, False, True, True, 5, 2, 10, 0, 0, 0, 0), ("c", False, 100, False, True, True, 60, 2, 10, 0, 0, 0, 0), ("d", False, 100, False, True, False, 1, 1, 10, 0, 0, 0, 0), ("e", False, 0, True, True, True, 0, 0, 10, 5, 1, 0, 0), ("f", False, 0, True, True, True, 0, 0, 10, 5, 0, 4, 0), ("g", False, 0, True, False, True, 0, 0, 10, 0, 0, 0, 0)]


@query(f"""WITH d(repo, alive, age, eq, known, anc, behind, changed, total, sc, sx, dc, dx) AS ({values(_DRIFT)}) SELECT repo, CASE WHEN alive AND age <= 300 AND eq THEN 'FRESH' WHEN known AND NOT eq THEN CASE WHEN NOT anc OR behind > 50 OR changed > 0.5 * total THEN 'STALE_MAJOR' ELSE 'STALE_MINOR' END WHEN sc > 0 AND sx > 0 THEN 'STALE_MINOR' WHEN dc > 0 THEN CASE WHEN dx > 0 THEN 'STALE_MINOR' ELSE 'FRESH' END ELSE 'UNKNOWN' END AS level FROM d""")
def drift_tiers(spark, sf_dir):
    """How far a graph is behind its repository."""
    facts = spark.createDataFrame(_DRIFT, "repo string, host_alive boolean, incremental_age long, head_equal boolean, head_known boolean, is_ancestor boolean, commits_behind long, changed_files long, total_files long, sentinels_checked long, sentinels_changed long, dirs_checked long, dirs_changed long")
    return analysis.drift(facts).select("repo", "level")


@query(f"""WITH f(path) AS ({values([(p,) for p, _ in FILES])}), p AS (SELECT string_split(path, '/') AS s FROM f), c AS (SELECT s, unnest(range(1, len(s))) AS i FROM p) SELECT DISTINCT array_to_string(s[1:i], '/') AS src, array_to_string(s[1:i + 1], '/') AS dst FROM c""")
def folder_tree(spark, sf_dir):
    """Folders that contain folders and files."""
    return analysis.folder_tree(spark.createDataFrame([(p,) for p, _ in FILES], "path string"))[1]


#: A small repository: a harbour in Python, with a page of gauges in TypeScript.
SOURCES = [
    (
        "port/berth.py",
        "class Berth:\n    depth: int = 9\n\n    def takes(self, draught: int) -> bool:\n        return spare(self.depth, draught) > 0\n\n    def widen(self, metres: int) -> None:\n        self.depth = self.depth + metres\n\n\n"
        "def spare(depth: int, draught: int) -> int:\n    return depth - draught\n",
        "python",
    ),
    ("port/roster.py", "from .berth import Berth, spare\n\n\ndef moor(berth: Berth, draught: int):\n    if spare(berth.depth, draught) > 1:\n        return book(berth)\n    return None\n\n\ndef book(berth: Berth):\n    return [berth]\n", "python"),
    ("port/bulletin.py", "from port.roster import moor\n\n\ndef announce(berth, draught):\n    print(moor(berth, draught))\n", "python"),
    ("port/lantern.py", "def douse():\n    return False\n", "python"),
    ("quay/gauge.ts", "import { level } from './tide';\n\nexport function gauge(port: string): number {\n  return level(port) * 2;\n}\n", "typescript"),
    ("quay/tide.ts", "export function level(port: string): number {\n  return port.length;\n}\n", "typescript"),
]
#: The lines of the sample, their definitions, and the definition each line stands in, by patterns over the text.
_LINES = f"""src(path, content, lang) AS ({values(SOURCES)}), ln AS (SELECT path, unnest(string_split(content, chr(10))) AS t, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM src),
df AS (SELECT path, n, regexp_extract(t, '^ *(?:export )?(?:class|def|function) ([A-Za-z_]+)', 1) AS name, t LIKE 'class %' AS is_class, t LIKE '    def %' AS is_method FROM ln WHERE regexp_matches(t, '^ *(export )?(class|def|function) ')),
sy AS (SELECT path, n, name, CASE WHEN is_class THEN 'class' WHEN is_method THEN 'method' ELSE 'function' END AS label,
  CASE WHEN is_method THEN (SELECT arg_max(c.name, c.n) FROM df c WHERE c.path = df.path AND c.is_class AND c.n < df.n) || '.' || name ELSE name END AS full_name FROM df)"""


def sample_sources(spark) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(sorted(SOURCES))], "path string, content string, language string, ord long")


@query(f"""WITH {_LINES} SELECT path AS file_path, label, name FROM sy UNION ALL SELECT path, 'class_attribute', regexp_extract(t, '^    ([a-z_]+): [a-z]+ = ', 1) FROM ln WHERE regexp_matches(t, '^    [a-z_]+: [a-z]+ = ')""")
def python_symbols(spark, sf_dir):
    """Symbols of a small repository; in SQL, lines that begin a definition."""
    return indexing.symbol_rows(indexing.parse(sample_sources(spark))).select("file_path", "label", "name")


@query(f"""WITH {_LINES}, cl AS (SELECT path, n, unnest(regexp_extract_all(t, '([a-z]+)\\(', 1)) AS callee FROM ln WHERE (path, n) NOT IN (SELECT path, n FROM df)),
fr AS (SELECT cl.path, cl.callee, arg_max(sy.label || ':' || sy.path || ':' || sy.full_name, sy.n) AS src FROM cl JOIN sy ON sy.path = cl.path AND sy.n < cl.n AND sy.label <> 'class' GROUP BY cl.path, cl.n, cl.callee),
im AS (SELECT path, t FROM ln WHERE regexp_matches(t, '(^from|^import) '))
SELECT DISTINCT src, sy.label || ':' || sy.path || ':' || sy.full_name AS dst, CASE WHEN sy.path = fr.path OR EXISTS (SELECT 1 FROM im WHERE im.path = fr.path AND regexp_matches(im.t, '\\b' || fr.callee || '\\b')) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM fr JOIN sy ON sy.name = fr.callee AND sy.label = 'function'""")
def index_calls(spark, sf_dir):
    """The whole index build of a small repository: its call edges (a call of print makes none); in SQL, names before a bracket, joined to the definitions."""
    return indexing.build(sample_sources(spark)).edges.where("rel_type = 'calls'").select("src", "dst", "confidence")


# --- Cypher over the tables: suppliers are functions, nations files and communities, customers methods of their segment


def code_like(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = lambda n: tables.table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    functions = t("supplier").select(key("s", "s_suppkey").alias("id"), F.lit("function").alias("label"), F.col("s_name").alias("name"), key("n", "s_nationkey").alias("file_path"), F.col("s_suppkey").alias("start_line"), (F.col("s_acctbal") < 0).alias("is_dead"), (F.col("s_suppkey") % 10 == 0).alias("is_entry_point"))
    files = t("nation").select(key("n", "n_nationkey").alias("id"), F.lit("file").alias("label"), F.col("n_name").alias("name"))
    groups = t("nation").select(key("c", "n_nationkey").alias("id"), F.lit("community").alias("label"), F.col("n_name").alias("name"))
    methods = t("customer").select(key("m", "c_custkey").alias("id"), F.lit("method").alias("label"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("class_name"))
    nodes = as_nodes(functions).unionByName(as_nodes(files)).unionByName(as_nodes(groups)).unionByName(as_nodes(methods))
    calls = tables.supplier_calls(spark, sf_dir).select(F.lit("calls").alias("rel_type"), key("s", "src").alias("src"), key("s", "dst").alias("dst"), "confidence")
    member = t("supplier").select(F.lit("member_of").alias("rel_type"), key("s", "s_suppkey").alias("src"), key("c", "s_nationkey").alias("dst"))
    a, b = t("nation").alias("a"), t("nation").alias("b")
    near = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.concat(F.lit("n"), F.col("a.n_nationkey")).alias("src"), F.concat(F.lit("n"), F.col("b.n_nationkey")).alias("dst"), ((F.col("a.n_nationkey") * 7 + F.col("b.n_nationkey")) % 10 / 10).alias("strength"))
    edges = as_edges(calls).unionByName(as_edges(member)).unionByName(as_edges(near.drop("strength").withColumn("rel_type", F.lit("imports")))).unionByName(as_edges(near.withColumn("rel_type", F.lit("coupled_with"))))
    return nodes, edges


_NEAR = "nr AS (SELECT a.n_name AS a, b.n_name AS b, (a.n_nationkey * 7 + b.n_nationkey) % 10 / 10 AS strength FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"


def preset(name: str, text: str, sql: str, columns: list[str]):
    def run(spark, sf_dir):
        nodes, edges = code_like(spark, sf_dir)
        return cypher(text, nodes, edges).toDF(*columns)

    run.__name__, run.__doc__ = name, f"§2.15: {text}"
    QUERIES[name], ORACLE_SQL[name] = run, sql


preset("cypher_dead_code", "MATCH (n:Function) WHERE n.is_dead = true RETURN n.name, n.file_path, n.start_line", "SELECT s_name AS name, 'n' || s_nationkey AS file_path, s_suppkey AS start_line FROM supplier WHERE s_acctbal < 0", ["name", "file_path", "start_line"])
preset("cypher_most_called", "MATCH ()-[r:CodeRelation]->(t:Function) WHERE r.rel_type = 'calls' RETURN t.name, count(r) AS calls ORDER BY calls DESC, t.name LIMIT 20", f"WITH {_EDGES} SELECT s_name AS name, count(*) AS calls FROM e JOIN supplier ON s_suppkey = e.dst GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", ["name", "calls"])
preset("cypher_import_map", "MATCH (a:File)-[r:CodeRelation]->(b:File) WHERE r.rel_type = 'imports' RETURN a.name AS source, b.name AS target", f"WITH {_NEAR} SELECT a AS source, b AS target FROM nr", ["source", "target"])
preset("cypher_coupled_files", "MATCH (a:File)-[r:CodeRelation]->(b:File) WHERE r.rel_type = 'coupled_with' RETURN a.name, b.name, r.strength ORDER BY r.strength DESC", f"WITH {_NEAR} SELECT a, b, CAST(strength AS DOUBLE) AS strength FROM nr", ["a", "b", "strength"])
preset("cypher_entry_points", "MATCH (n:Function) WHERE n.is_entry_point = true RETURN n.name, n.file_path", "SELECT s_name AS name, 'n' || s_nationkey AS file_path FROM supplier WHERE s_suppkey % 10 = 0", ["name", "file_path"])
preset("cypher_largest_classes", "MATCH (m:Method) WHERE m.class_name <> '' RETURN m.class_name AS class, count(m) AS methods ORDER BY methods DESC LIMIT 10", "SELECT c_mktsegment AS class, count(*) AS methods FROM customer GROUP BY 1 ORDER BY 2 DESC LIMIT 10", ["class", "methods"])
preset(
    "cypher_cross_community",
    "MATCH (a)-[r:CodeRelation]->(b) WHERE r.rel_type = 'calls' AND a.id <> b.id MATCH (a)-[:CodeRelation]->(c1:Community), (b)-[:CodeRelation]->(c2:Community) WHERE c1.id <> c2.id RETURN a.name, b.name, c1.name, c2.name",
    f"WITH {_EDGES} SELECT x.s_name AS a, y.s_name AS b, p.n_name AS c1, q.n_name AS c2 FROM e JOIN supplier x ON x.s_suppkey = e.src JOIN supplier y ON y.s_suppkey = e.dst JOIN nation p ON p.n_nationkey = x.s_nationkey JOIN nation q ON q.n_nationkey = y.s_nationkey WHERE x.s_nationkey <> y.s_nationkey",
    ["a", "b", "c1", "c2"],
)
preset("cypher_optional_having", "MATCH (c:Community) OPTIONAL MATCH (n:Function)-[r:CodeRelation]->(c) WHERE n.is_dead = true WITH c, count(n) AS dead WHERE dead > 0 RETURN c.name AS name, dead ORDER BY dead DESC, name", "SELECT n_name AS name, count(*) AS dead FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 0 GROUP BY 1", ["name", "dead"])
preset("cypher_union", "MATCH (n:Function) RETURN label(n) AS kind, count(n) AS n, sum(CASE WHEN n.is_dead = true THEN 1 ELSE 0 END) AS dead UNION ALL MATCH (n:Method) RETURN label(n) AS kind, count(n) AS n, sum(CASE WHEN n.is_dead = true THEN 1 ELSE 0 END) AS dead", "SELECT 'function' AS kind, count(*) AS n, CAST(sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS dead FROM supplier UNION ALL SELECT 'method', count(*), 0 FROM customer", ["kind", "n", "dead"])


@query(f"""WITH {_EDGES}, {_NEAR}, p AS (SELECT round_even(greatest(0.0, 100 - sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) / greatest(1, count(*)) * 100.0::DOUBLE), 1) AS dead_code FROM supplier WHERE s_suppkey > 0),
c AS (SELECT round_even(greatest(0.0, 100 - sum(CASE WHEN strength > 0.7 THEN 1 ELSE 0 END)::DOUBLE / count(*) * 200), 1) AS coupling FROM nr), m AS (SELECT round_even(greatest(50.0, 100 - ((SELECT count(*) FROM nation) - 15) * 2.0), 1) AS modularity), k AS (SELECT round_even(least(100.0, avg(confidence) * 100), 1) AS confidence FROM e)
SELECT CAST(dead_code AS DOUBLE) AS dead_code, CAST(coupling AS DOUBLE) AS coupling, CAST(modularity AS DOUBLE) AS modularity, CAST(confidence AS DOUBLE) AS confidence, 0.0::DOUBLE AS coverage, round_even(CAST(dead_code * 0.25 + coupling * 0.20 + modularity * 0.20 + confidence * 0.20 AS DOUBLE), 1) AS score FROM p, c, m, k""")
def health_score(spark, sf_dir):
    """The health score of the code-like graph."""
    return analysis.health(*code_like(spark, sf_dir))


_PATHS = ["src/a.py", "node_modules/x.js", "web/App.tsx", "pkg.egg-info/y.py", "build/z.py", "docs/keep.py", "docs/drop.py", "lib/t.min.js", "lib/t.mjs", "README.md", "a/tests/t.py", "conftest.py", "test_x/b.py", "attests/c.py", "vendor/keep.py", "target/keep.ts", "env/keep.py", ".env/drop.py", "x/.eggs/drop.py", "htmlcov/drop.js", "a/lib.so", "a/b.js.map", "c.bundle.js", "uv.lock", "egg-info/drop.py", "a/UPPER.PY", "a/mod.pyo", "dist.py", "distx/keep.py"]
#: Names and endings of ignored parts of a path, as the rules state them.
_IGNORED_NAMES = "node_modules __pycache__ .git .venv venv .env dist build .idea .vscode .mypy_cache .pytest_cache .ruff_cache .tox egg-info .eggs coverage htmlcov .DS_Store .coverage package-lock.json yarn.lock uv.lock poetry.lock".split()
_IGNORED_ENDS = ".egg-info .pyc .pyo .so .dylib .min.js .bundle.js .map".split()


@query(f"""WITH p(path) AS ({values([(x,) for x in _PATHS])}), e AS (SELECT path, regexp_extract(path, '(\\.[^./]+)$', 1) AS ext, string_split(path, '/') AS s FROM p)
SELECT path, CASE ext WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript' END AS language,
(list_has_any(s, {_IGNORED_NAMES}) OR len(list_filter(s, lambda x: len(list_filter({_IGNORED_ENDS}, lambda e: ends_with(x, e))) > 0)) > 0 OR (starts_with(path, 'docs/') AND path <> 'docs/keep.py')) AS ignored,
(list_has_any(s, ['tests', 'test']) OR regexp_matches(path, '(^|/)test_') OR ends_with(path, 'conftest.py')) AS is_test FROM e""")
def file_rules(spark, sf_dir):
    """Languages, ignore rules with an ignore file, and test files."""
    from graphloom.sources import files

    df = spark.createDataFrame([(x,) for x in _PATHS], "path string")
    return df.select("path", files.language(F.col("path")).alias("language"), files.ignored(F.col("path"), "docs/*\n!docs/keep.py\n").alias("ignored"), dead_code.is_test_file(F.col("path")).alias("is_test"))


_REPOS = [("/w/app",), ("/x/app",), ("/w/app/sub",), ("/w/lib",)]
_ASKED = [("/w/app/src/a.py",), ("/w/app/sub/b.py",), ("/w/other/c.py",), ("/x/app",)]


@query(f"""WITH r(path) AS ({values(_REPOS)}), s AS (SELECT path, CASE WHEN path = min(path) OVER (PARTITION BY list_last(string_split(path, '/'))) THEN list_last(string_split(path, '/')) ELSE list_last(string_split(path, '/')) || '-' || substr(sha256(path), 1, 8) END AS slug FROM r), q(path) AS ({values(_ASKED)}),
m AS (SELECT q.path, s.slug, row_number() OVER (PARTITION BY q.path ORDER BY length(s.path) DESC) AS k FROM q JOIN s ON q.path = s.path OR starts_with(q.path, s.path || '/')) SELECT q.path, m.slug, CASE WHEN m.slug IS NOT NULL THEN m.slug || '::' || q.path END AS qualified FROM q LEFT JOIN m ON m.path = q.path AND m.k = 1""")
def repo_routing(spark, sf_dir):
    """Slugs of repositories and the owner of a path by longest prefix."""
    from graphloom.sources import files

    named = files.slugs(spark.createDataFrame(_REPOS, "path string"))
    owned = files.owner_of(spark.createDataFrame(_ASKED, "path string"), named)
    return owned.select("path", "slug", F.when(F.col("slug").isNotNull(), files.qualified(F.col("slug"), F.col("path"))).alias("qualified"))


@query(f"""WITH {_EDGES}, {_NEAR} SELECT (SELECT count(*) FROM nation) AS files, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS symbols, (SELECT count(*) FROM nation) AS communities, 0::BIGINT AS processes, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS dead, (SELECT count(*) FROM e) + (SELECT count(*) FROM supplier) + 2 * (SELECT count(*) FROM nr) AS relationships""")
def pipeline_counters(spark, sf_dir):
    """Counters of an index build."""
    return analysis.pipeline_counters(*code_like(spark, sf_dir))


@query("""SELECT 'c' || s_nationkey AS community, count(*) AS members FROM supplier GROUP BY 1""")
def cypher_members(spark, sf_dir):
    """Members collected and counted by a query."""
    nodes, edges = code_like(spark, sf_dir)
    return cypher("MATCH (n:Function)-[:MemberOf]->(c:Community) WITH c.id AS community, collect(DISTINCT n.id) AS m RETURN community, size(m) AS members", nodes, edges).select("community", F.col("members").cast("bigint").alias("members"))


@query(f"""WITH {_EDGES}, o AS (SELECT e.src AS k, 'calls' AS w, x.s_name AS nm FROM e JOIN supplier x ON x.s_suppkey = e.dst UNION SELECT e.dst, 'called by', x.s_name FROM e JOIN supplier x ON x.s_suppkey = e.src),
l AS (SELECT k, w || ': ' || string_agg(nm, ', ' ORDER BY nm) AS t, w FROM o GROUP BY k, w), j AS (SELECT k, string_agg(t, chr(10) ORDER BY w = 'called by') AS near FROM l GROUP BY k)
SELECT 's' || s_suppkey AS id, 'function ' || s_name || ' in n' || s_nationkey || coalesce(chr(10) || near, '') AS text FROM supplier LEFT JOIN j ON k = s_suppkey""")
def node_texts(spark, sf_dir):
    """Texts of nodes with the sorted names around them."""
    nodes, edges = code_like(spark, sf_dir)
    return analysis.node_texts(nodes.where("label = 'function'"), edges.where("rel_type = 'calls'"))


@query(f"""WITH p(d, s) AS ({values([("30s", 30), ("5m", 300), ("2h", 7200), ("7d", None)])}) SELECT d, CAST(s AS BIGINT) AS seconds FROM p""")
def durations(spark, sf_dir):
    """§2.13: durations as text."""
    df = spark.createDataFrame([("30s",), ("5m",), ("2h",), ("7d",)], "d string")
    return df.select("d", analysis.duration_seconds(F.col("d")).alias("seconds"))


@query(f"""WITH {_FIXTURE} SELECT s.id, s.name, s.file_path, 'direct' AS reach FROM s WHERE false""")
def test_impact_comments(spark, sf_dir):
    """Hunks of comments and docstrings alone reach no test."""
    text = '"""Doc."""\n\n\ndef hoist():\n    # why\n    """Doc\n    more."""\n    return 1\n'
    sources = spark.createDataFrame([("cargo/crane.py", text, "python")], "path string, content string, language string")
    hunks = spark.createDataFrame([("cargo/crane.py", 1, 2), ("cargo/crane.py", 5, 7)], "file_path string, start long, end long")
    return analysis.test_impact(_symbols(spark), spark.createDataFrame(CALL_EDGES, "src string, dst string"), analysis.executable_hunks(hunks, sources))
