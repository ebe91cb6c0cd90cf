"""Read-only Cypher over node and edge tables: a parser, and a translation to DataFrame operations.

Covered: MATCH and OPTIONAL MATCH with comma-separated patterns, labels,
property maps, directed, reverse and undirected relationships, bounded
variable length; WHERE; WITH; RETURN, DISTINCT, aggregates with implicit
grouping; ORDER BY, SKIP, LIMIT; UNION and UNION ALL; UNWIND of lists;
parameters. Each relationship of a pattern is a join; no relationship is
used twice within one MATCH.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.schema import EDGES, NODES
from graphloom.operators import search

#: Words that are refused outside comments, and the longest query.
WRITE_WORDS = re.compile(r"\b(DELETE|DROP|CREATE|SET|REMOVE|MERGE|DETACH|INSTALL|LOAD|COPY)\b", re.I)
COMMENTS = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
MAX_LENGTH, MAX_HOPS = 100_000, 10

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<par>\$\w+)|(?P<id>`[^`]+`|[A-Za-z_]\w*)|(?P<op><=|>=|<>|=~|\.\.|[-+*/%=<>()\[\]{},.:|]))""")
_WORDS = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "ORDER", "SKIP", "LIMIT", "UNION", "UNWIND"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class CypherError(ValueError):
    """A query that isn't read-only, too long, or outside the grammar."""


def guard(text: str, most: int = MAX_LENGTH) -> str:
    """The query without comments, if it's short and read-only."""
    if len(text) > most:
        raise CypherError(f"query longer than {most} characters")
    plain = COMMENTS.sub("", text)
    if found := WRITE_WORDS.search(plain):
        raise CypherError(f"only read queries: {found[0]} is not allowed")
    return plain


@dataclass
class NodePattern:
    var: str
    labels: list[str]
    props: dict[str, Any]
    named: bool


@dataclass
class RelPattern:
    var: str
    types: list[str]
    props: dict[str, Any]
    way: str
    hops: tuple[int, int] | None


@dataclass
class Clause:
    kind: str
    patterns: list[list] = field(default_factory=list)
    where: Any = None
    items: list[tuple[Any, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)
    skip: Any = None
    limit: Any = None
    var: str = ""
    value: Any = None


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                if not text[at:].strip():
                    break
                raise CypherError(f"cannot read: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
            at = m.end()
        self.i, self.fresh = 0, 0

    def peek(self, *values: str) -> bool:
        if self.i >= len(self.tokens):
            return False
        kind, value = self.tokens[self.i][:2]
        return (value.upper() if kind == "id" else value) in values if kind != "str" else False

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> str:
        got = self.take(value)
        if got is None:
            at = self.tokens[self.i][1] if self.i < len(self.tokens) else "the end"
            raise CypherError(f"expected {value} at {at}")
        return got

    def name(self) -> str:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "id":
            self.i += 1
            return self.tokens[self.i - 1][1].strip("`")
        raise CypherError("expected a name")

    def query(self) -> list[tuple[str, list[Clause]]]:
        parts = [("", self.single())]
        while self.take("UNION"):
            parts.append(("all" if self.take("ALL") else "distinct", self.single()))
        if self.i < len(self.tokens):
            raise CypherError(f"unexpected {self.tokens[self.i][1]}")
        return parts

    def single(self) -> list[Clause]:
        out = []
        while True:
            if self.take("OPTIONAL"):
                self.need("MATCH")
                out.append(self.match("optional"))
            elif self.take("MATCH"):
                out.append(self.match("match"))
            elif self.take("UNWIND"):
                value = self.expr()
                self.need("AS")
                out.append(Clause("unwind", value=value, var=self.name()))
            elif self.take("CALL"):
                out.append(self.procedure())
            elif self.take("WITH"):
                out.append(self.projection("with"))
            elif self.take("RETURN"):
                out.append(self.projection("return"))
                return out
            else:
                raise CypherError("expected MATCH, CALL, WITH, UNWIND or RETURN")

    def procedure(self) -> Clause:
        """CALL QUERY_FTS_INDEX(table, index, text) [YIELD node, score]."""
        if self.name().upper() != "QUERY_FTS_INDEX":
            raise CypherError("the only procedure is QUERY_FTS_INDEX")
        self.need("(")
        args = [self.expr()]
        while self.take(","):
            args.append(self.expr())
        self.need(")")
        if len(args) != 3 or any(a[0] not in ("lit", "par") for a in args):
            raise CypherError("QUERY_FTS_INDEX takes a table, its index and a text")
        if self.take("YIELD"):
            names = [self.name()]
            while self.take(","):
                names.append(self.name())
            if set(names) - {"node", "score"}:
                raise CypherError("QUERY_FTS_INDEX yields node and score")
        return Clause("call", value=args)

    def match(self, kind: str) -> Clause:
        c = Clause(kind, [self.path()])
        while self.take(","):
            c.patterns.append(self.path())
        if self.take("WHERE"):
            c.where = self.expr()
        return c

    def path(self) -> list:
        out = [self.node()]
        while self.peek("-", "<"):
            back = bool(self.take("<"))
            self.need("-")
            var, types, props, hops = "", [], {}, None
            if self.take("["):
                if not self.peek(":", "]", "*", "{"):
                    var = self.name()
                if self.take(":"):
                    types.append(self.name())
                    while self.take("|"):
                        self.take(":")
                        types.append(self.name())
                if self.take("*"):
                    hops = self.range()
                if self.peek("{"):
                    props = self.map()
                self.need("]")
            self.need("-")
            forth = bool(self.take(">"))
            self.fresh += 1
            out += [RelPattern(var or f"_r{self.fresh}", types, props, "<" if back and not forth else ">" if forth and not back else "-", hops), self.node()]
        return out

    def range(self) -> tuple[int, int]:
        low = int(self.tokens[self.i][1]) if self.tokens[self.i][0] == "num" else None
        self.i += low is not None
        if self.take(".."):
            high = int(self.tokens[self.i][1]) if self.tokens[self.i][0] == "num" else MAX_HOPS
            self.i += self.tokens[self.i][0] == "num"
            return (1 if low is None else low, min(high, MAX_HOPS))
        return (1, MAX_HOPS) if low is None else (low, low)

    def node(self) -> NodePattern:
        self.need("(")
        var, labels, props = "", [], {}
        if not self.peek(":", ")", "{"):
            var = self.name()
        while self.take(":"):
            labels.append(self.name())
            while self.take("|"):
                labels.append(self.name())
        if self.peek("{"):
            props = self.map()
        self.need(")")
        self.fresh += 1
        return NodePattern(var or f"_n{self.fresh}", labels, props, bool(var))

    def map(self) -> dict[str, Any]:
        out = {}
        self.need("{")
        while not self.take("}"):
            key = self.name()
            self.need(":")
            out[key] = self.expr()
            self.take(",")
        return out

    def projection(self, kind: str) -> Clause:
        c = Clause(kind, distinct=bool(self.take("DISTINCT")))
        while True:
            begin = self.tokens[self.i][2]
            e = ("star",) if self.take("*") else self.expr()
            text = self.text[begin : self.tokens[self.i - 1][3]].strip()
            c.items.append((e, self.name() if self.take("AS") else text))
            if not self.take(","):
                break
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                c.order.append((e, not (self.take("DESC", "DESCENDING") or (self.take("ASC", "ASCENDING") and False))))
                if not self.take(","):
                    break
        if self.take("SKIP"):
            c.skip = self.expr()
        if self.take("LIMIT"):
            c.limit = self.expr()
        if kind == "with" and self.take("WHERE"):
            c.where = self.expr()
        return c

    def expr(self):
        return self.chain(lambda: self.chain(lambda: self.chain(self.negation, "AND"), "XOR"), "OR")

    def chain(self, below, *ops: str):
        left = below()
        while op := self.take(*ops):
            left = ("op", op.upper(), left, below())
        return left

    def negation(self):
        return ("not", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if op := self.take("=", "<>", "<=", ">=", "<", ">", "=~", "IN", "CONTAINS"):
                left = ("op", op.upper(), left, self.sum())
            elif op := self.take("STARTS", "ENDS"):
                self.need("WITH")
                left = ("op", op.upper(), left, self.sum())
            elif self.take("IS"):
                left = ("null", bool(self.take("NOT")), left)
                self.need("NULL")
            else:
                return left

    def sum(self):
        return self.chain(lambda: self.chain(self.unary, "*", "/", "%"), "+", "-")

    def unary(self):
        return ("neg", self.unary()) if self.take("-") else self.postfix()

    def postfix(self):
        out = self.atom()
        while True:
            if self.take("."):
                out = ("prop", out, "*" if self.take("*") else self.name())
            elif self.take("["):
                out = ("index", out, self.expr())
                self.need("]")
            else:
                return out

    def atom(self):
        if self.i >= len(self.tokens):
            raise CypherError("unexpected end")
        kind, value, *_ = self.tokens[self.i]
        if kind == "num":
            self.i += 1
            return ("lit", float(value) if "." in value else int(value))
        if kind == "str":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "par":
            self.i += 1
            return ("par", value[1:])
        if self.take("("):
            out = self.expr()
            self.need(")")
            return out
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.expr())
                self.take(",")
            return ("list", items)
        if self.take("CASE"):
            subject = None if self.peek("WHEN") else self.expr()
            cases = []
            while self.take("WHEN"):
                test = self.expr()
                self.need("THEN")
                cases.append((test if subject is None else ("op", "=", subject, test), self.expr()))
            other = self.expr() if self.take("ELSE") else ("lit", None)
            self.need("END")
            return ("case", cases, other)
        for word, constant in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return ("lit", constant)
        name = self.name()
        if self.take("("):
            distinct, args = bool(self.take("DISTINCT")), []
            while not self.take(")"):
                args.append(("star",) if self.take("*") else self.cast_argument(name))
                self.take(",")
            return ("call", name.lower(), distinct, args)
        return ("var", name)

    def cast_argument(self, name: str):
        e = self.expr()
        if name.lower() == "cast" and self.take("AS"):
            return ("typed", e, self.name())
        return e


def snake(label: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", label).lower()


class Translator:
    """Columns of a bound variable v are named ``v.field`` in the working table; values of WITH keep their own name."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, params: dict[str, Any], index: tuple[DataFrame, DataFrame] | None = None):
        self.nodes, self.edges, self.params, self.index = nodes, edges, params, index
        self.kinds: dict[str, str] = {}
        self.table: DataFrame | None = None
        self.columns: set[str] = set()

    # --- expressions

    def column(self, e, names: dict[str, str] | None = None) -> Column:
        kind, go = e[0], lambda x: self.column(x, names)
        if kind == "lit":
            return F.lit(e[1])
        if kind == "par":
            if e[1] not in self.params:
                raise CypherError(f"no parameter {e[1]}")
            return F.lit(self.params[e[1]])
        if kind == "list":
            return F.array(*map(go, e[1]))
        if kind == "var":
            if names and e[1] in names:
                return F.col(f"`{names[e[1]]}`")
            if e[1] not in self.kinds:
                raise CypherError(f"unknown variable {e[1]}")
            return F.col(f"`{e[1]}`") if self.kinds[e[1]] == "value" else F.col(f"`{e[1]}.{'id' if self.kinds[e[1]] == 'node' else 'rel_id'}`")
        if kind == "prop":
            if e[1][0] != "var" or self.kinds.get(e[1][1]) not in ("node", "rel"):
                return go(e[1]).getField(e[2])
            known = NODES.fieldNames() if self.kinds[e[1][1]] == "node" else EDGES.fieldNames()
            return F.col(f"`{e[1][1]}.{e[2]}`") if e[2] in known else F.lit(None)
        if kind == "index":
            return F.get(go(e[1]), go(e[2]))
        if kind == "not":
            return ~go(e[1])
        if kind == "neg":
            return -go(e[1])
        if kind == "null":
            return go(e[2]).isNotNull() if e[1] else go(e[2]).isNull()
        if kind == "case":
            out = F
            for test, value in e[1]:
                out = out.when(go(test), go(value))
            return out.otherwise(go(e[2]))
        if kind == "typed":
            return go(e[1]).cast({"int64": "bigint", "integer": "bigint", "string": "string", "double": "double", "float": "float"}.get(e[2].lower(), e[2]))
        if kind == "op":
            return self.operator(e[1], go(e[2]), e[3], go)
        if kind == "call":
            return self.function(e, go)
        raise CypherError(f"cannot use {kind} here")

    def operator(self, op: str, a: Column, right, go) -> Column:
        if op == "IN":
            return a.isin([x[1] for x in right[1]]) if right[0] == "list" and all(x[0] == "lit" for x in right[1]) else F.array_contains(go(right), a)
        b = go(right)
        return {
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "AND": lambda: a & b, "OR": lambda: a | b, "XOR": lambda: a != b, "+": lambda: a + b,
            "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "STARTS": lambda: a.startswith(b), "ENDS": lambda: a.endswith(b), "CONTAINS": lambda: a.contains(b), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
        }[op]()

    def function(self, e, go) -> Column:
        _, name, distinct, args = e
        if name == "count":
            if args[0] == ("star",):
                return F.count(F.lit(1))
            return F.count_distinct(go(args[0])) if distinct else F.count(go(args[0]))
        if name in ("label", "labels"):
            label = F.col(f"`{args[0][1]}.label`")
            return label if name == "label" else F.array(label)
        if name == "type":
            return F.col(f"`{args[0][1]}.rel_type`")
        if name in _AGGREGATES:
            x = go(args[0])
            if name == "collect":
                return F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))
            return {"sum": F.sum_distinct if distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](x)
        values = [go(a) for a in args]
        plain = {
            "lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper, "trim": F.trim, "abs": F.abs, "coalesce": F.coalesce, "levenshtein": F.levenshtein, "split": lambda a, b: F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E"))), "replace": F.replace, "round": F.bround,
            "tostring": lambda a: a.cast("string"), "tointeger": lambda a: a.cast("bigint"), "tofloat": lambda a: a.cast("double"), "cast": lambda a: a, "id": lambda a: a, "exists": lambda a: a.isNotNull(), "substring": lambda a, i, n=F.lit(1 << 30): F.substring(a, i + 1, n),
            "size": lambda a: F.size(a), "length": lambda a: F.length(a), "head": lambda a: F.get(a, F.lit(0)), "last": lambda a: F.element_at(a, -1), "reverse": F.reverse, "contains": lambda a, b: a.contains(b), "starts_with": lambda a, b: a.startswith(b), "ends_with": lambda a, b: a.endswith(b),
            "list_contains": F.array_contains, "left": F.left, "right": F.right, "floor": F.floor, "ceil": F.ceil, "ln": F.ln, "log": F.log10, "sqrt": F.sqrt, "array_cosine_similarity": _cosine,
        }
        if name not in plain:
            raise CypherError(f"unknown function {name}")
        return plain[name](*values)

    # --- patterns

    def nodes_of(self, p: NodePattern) -> DataFrame:
        df = self.nodes
        if p.labels:
            df = df.where(F.col("label").isin([snake(x) for x in p.labels]))
        for k, v in p.props.items():
            df = df.where(F.col(k) == self.column(v))
        return df.select(*[F.col(f).alias(f"{p.var}.{f}") for f in NODES.fieldNames()])

    def search(self, args: list) -> None:
        """Bind ``node`` and ``score`` to all full-text hits of one label; ORDER BY and LIMIT then take the best."""
        if self.table is not None:
            raise CypherError("CALL must come first")
        table, index, text = (str(a[1] if a[0] == "lit" else self.params[a[1]]) for a in args)
        if index != f"{table.lower()}_fts":
            raise CypherError(f"no index {index} of {table}")
        kept, words = search.searchable(self.nodes.where(F.col("label") == snake(table)))
        if self.index is None:
            hits = search.bm25(kept, "id", words, text, None, F.col("label"))
        else:
            postings, stats = self.index
            hits = search.bm25_stored(postings.where(F.col("part") == snake(table)), stats, text, None)
        node = kept.select(*[F.col(f).alias(f"node.{f}") for f in NODES.fieldNames()])
        self.table = node.join(hits.select(F.col("id").alias("_hit"), "score"), F.col("`node.id`") == F.col("_hit")).drop("_hit")
        self.kinds |= {"node": "node", "score": "value"}

    def edges_of(self, r: RelPattern) -> DataFrame:
        df = self.edges
        types = [t for t in r.types if t.lower() != "coderelation"]
        if types:
            df = df.where(F.col("rel_type").isin([snake(t) for t in types]))
        for k, v in r.props.items():
            df = df.where(F.col(k) == self.column(v))
        if r.hops is not None:
            df = self.walks(df, r)
            if r.way == "-":  # walks are in both directions already
                r = RelPattern(r.var, r.types, r.props, ">", r.hops)
        ways = {">": [("src", "dst")], "<": [("dst", "src")], "-": [("src", "dst"), ("dst", "src")]}[r.way]
        parts = [df.where("src <> dst" if k else F.lit(True)).select(F.col(x).alias("_a"), F.col(y).alias("_b"), *df.columns) for k, (x, y) in enumerate(ways)]
        ends = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        rest = [F.col(f).alias(f"{r.var}.{f}") for f in EDGES.fieldNames() if f in ends.columns]
        return ends.select(F.col("_a").alias(f"{r.var}._a"), F.col("_b").alias(f"{r.var}._b"), *rest)

    def walks(self, edges: DataFrame, r: RelPattern) -> DataFrame:
        """Ends of walks of a bounded number of hops, each relationship used once."""
        step = edges.select("src", "dst", "rel_id")
        if r.way == "-":
            step = step.union(step.select("dst", "src", "rel_id"))
        now, found = step.select("src", "dst", F.array("rel_id").alias("used")), []
        for hop in range(1, r.hops[1] + 1):
            if hop >= max(1, r.hops[0]):
                found.append(now.select("src", "dst", F.array_join("used", "|").alias("rel_id")))
            if hop < r.hops[1]:
                nxt = step.select(F.col("src").alias("_m"), F.col("dst").alias("_d"), F.col("rel_id").alias("_r"))
                now = now.join(nxt, (F.col("dst") == F.col("_m")) & ~F.array_contains("used", F.col("_r"))).select("src", F.col("_d").alias("dst"), F.concat("used", F.array("_r")).alias("used"))
        out = found[0]
        for f in found[1:]:
            out = out.union(f)
        return out

    def pattern_table(self, patterns: list[list], bound: set[str]) -> tuple[DataFrame, dict[str, str], set[str]]:
        """All matches of the patterns alone; variables bound before appear by id only, as ``v.id#``."""
        table, kinds, shared = None, {}, set()
        rels: list[str] = []
        for path in patterns:
            left = None
            for k, part in enumerate(path):
                if isinstance(part, RelPattern):
                    continue
                fresh = part.var not in kinds
                if k == 0:
                    if fresh:
                        rows = self.nodes_of(part)
                        table = rows if table is None else table.crossJoin(rows)
                    elif part.labels or part.props:
                        rows = self.nodes_of(part).select(F.col(f"`{part.var}.id`").alias("_k"))
                        table = table.join(rows, F.col(f"`{part.var}.id`") == F.col("_k"), "left_semi")
                else:
                    r = path[k - 1]
                    steps = self.edges_of(r)
                    table = table.join(steps, F.col(f"`{left}.id`") == F.col(f"`{r.var}._a`"))
                    if r.hops is None:
                        rels.append(r.var)
                    kinds[r.var] = "rel"
                    if fresh:
                        table = table.join(self.nodes_of(part), F.col(f"`{r.var}._b`") == F.col(f"`{part.var}.id`"))
                    else:
                        table = table.where(F.col(f"`{r.var}._b`") == F.col(f"`{part.var}.id`"))
                kinds[part.var] = "node"
                if part.var in bound:
                    shared.add(part.var)
                left = part.var
        for a, b in combinations(rels, 2):
            table = table.where(F.col(f"`{a}.rel_id`") != F.col(f"`{b}.rel_id`"))
        return table, kinds, shared


    def match(self, c: Clause) -> None:
        bound = {v for v, k in self.kinds.items() if k == "node"}
        if self.table is not None and c.kind == "match" and all(p[0].var in bound or any(isinstance(x, NodePattern) and x.var in bound for x in p) for p in c.patterns):
            for path in c.patterns:
                self.extend(path)
            if c.where is not None:
                self.table = self.table.where(self.column(c.where))
            return
        ordered = self.ordered(c.patterns)
        table, kinds, shared = self.pattern_table(ordered, bound)
        if self.table is None:
            self.table, self.kinds = table, kinds
            if c.where is not None:
                self.table = self.table.where(self.column(c.where))
            return
        renamed = table.select(*[F.col(f"`{x}`").alias(f"{x}#" if x.partition(".")[0] in shared else x) for x in table.columns if x.partition(".")[0] not in shared or x.endswith(".id")])
        on = F.lit(True)
        for v in shared:
            on = on & (F.col(f"`{v}.id`") == F.col(f"`{v}.id#`"))
        before = self.table.columns
        self.kinds = {**kinds, **self.kinds}
        if c.where is not None:
            on = on & self.column(c.where)
        if not shared and c.kind == "match" and c.where is None:
            self.table = self.table.crossJoin(renamed)
        else:
            self.table = self.table.join(renamed, on, "left" if c.kind == "optional" else "inner")
        self.table = self.table.select(*[F.col(f"`{x}`") for x in self.table.columns if x in before or not x.endswith("#")])

    def ordered(self, patterns: list[list]) -> list[list]:
        """Patterns one after the other so that each shares a variable with those before, turned round if it's the last one."""
        rest, out, seen = list(patterns), [], set()
        while rest:
            pick = next((p for p in rest if p[0].var in seen), None) or next((p for p in rest if p[-1].var in seen), None) or rest[0]
            rest.remove(pick)
            if out and pick[0].var not in seen and pick[-1].var in seen:
                pick = turned(pick)
            out.append(pick)
            seen |= {x.var for x in pick if isinstance(x, NodePattern)}
        return out

    def extend(self, path: list) -> None:
        """Join one path to the working table, from a variable that's bound outwards."""
        start = next(i for i, x in enumerate(path) if isinstance(x, NodePattern) and self.kinds.get(x.var) == "node")
        rels = []
        for part in (turned(path[: start + 1]), path[start:]):
            left = part[0]
            if part[0].labels:
                self.table = self.table.where(F.col(f"`{left.var}.label`").isin([snake(x) for x in left.labels]))
            for k in range(1, len(part), 2):
                r, n = part[k], part[k + 1]
                self.table = self.table.join(self.edges_of(r), F.col(f"`{left.var}.id`") == F.col(f"`{r.var}._a`"))
                self.kinds[r.var] = "rel"
                rels += [r.var] if r.hops is None else []
                if self.kinds.get(n.var) == "node":
                    self.table = self.table.where(F.col(f"`{r.var}._b`") == F.col(f"`{n.var}.id`"))
                else:
                    self.table = self.table.join(self.nodes_of(n), F.col(f"`{r.var}._b`") == F.col(f"`{n.var}.id`"))
                    self.kinds[n.var] = "node"
                left = n
        for a, b in combinations(rels, 2):
            self.table = self.table.where(F.col(f"`{a}.rel_id`") != F.col(f"`{b}.rel_id`"))

    # --- projections

    def expanded(self, items: list[tuple[Any, str]]) -> list[tuple[Any, str]]:
        out = []
        for e, name in items:
            if e == ("star",):
                out += [(("var", v), v) for v, k in self.kinds.items() if not v.startswith("_")]
            elif e[0] == "prop" and e[2] == "*":
                out += [(("prop", e[1], f), f"{e[1][1]}.{f}") for f in NODES.fieldNames()]
            else:
                out.append((e, name))
        return out

    def project(self, c: Clause) -> DataFrame:
        items = self.expanded(c.items)
        # whole nodes and relationships stay bound through WITH
        carried = [(e[1], name) for e, name in items if e[0] == "var" and self.kinds.get(e[1]) in ("node", "rel")] if c.kind == "with" else []
        values = [(e, name) for e, name in items if not (c.kind == "with" and e[0] == "var" and self.kinds.get(e[1]) in ("node", "rel"))]
        keep = [(f"{v}.{f}", f"{name}.{f}") for v, name in carried for f in (NODES if self.kinds[v] == "node" else EDGES).fieldNames() if f"{v}.{f}" in self.table.columns]
        grouped = any(has_aggregate(e) for e, _ in values)
        names = {name: name for _, name in values}
        if grouped:
            keys = [F.col(f"`{a}`").alias(b) for a, b in keep] + [self.column(e).alias(n) for e, n in values if not has_aggregate(e)]
            table = self.table.groupBy(*keys).agg(*[self.column(e).alias(n) for e, n in values if has_aggregate(e)])
            table = table.select(*[F.col(f"`{b}`") for _, b in keep], *[F.col(f"`{n}`") for _, n in values])
        else:
            extra = [(e, f"_o{i}") for i, (e, _) in enumerate(c.order)] if not c.distinct else []
            made = [F.col(f"`{a}`").alias(b) for a, b in keep] + [self.column(e).alias(n) for e, n in values]
            made += [self.column(e if e[0] != "var" or e[1] not in names else dict((n, x) for x, n in values)[e[1]]).alias(n) for e, n in extra]
            table = self.table.select(*made)
        if c.distinct:
            table = table.distinct()
        kinds = {name: self.kinds[v] for v, name in carried} | {n: "value" for _, n in values}
        if c.order:
            by = []
            for i, (e, up) in enumerate(c.order):
                if not grouped and not c.distinct:
                    col = F.col(f"_o{i}")
                else:
                    match = next((n for x, n in values if x == e), None) or (e[1] if e[0] == "var" and e[1] in names else None)
                    if match is None:
                        raise CypherError("ORDER BY an expression that isn't returned")
                    col = F.col(f"`{match}`")
                by.append(col.asc() if up else col.desc())
            table = table.orderBy(*by)
        number = lambda e: int(e[1]) if e[0] == "lit" else int(self.params[e[1]])
        if c.skip is not None:
            table = table.offset(number(c.skip))
        if c.limit is not None:
            table = table.limit(number(c.limit))
        table = table.drop(*[x for x in table.columns if re.fullmatch(r"_o\d+", x)])
        self.table, self.kinds = table, kinds
        if c.where is not None:
            self.table = self.table.where(self.column(c.where))
        return self.table

    def run(self, clauses: list[Clause]) -> DataFrame:
        for c in clauses:
            if c.kind in ("match", "optional"):
                self.match(c)
            elif c.kind == "call":
                self.search(c.value)
            elif c.kind == "unwind":
                base = self.table if self.table is not None else self.nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))
                self.table, self.kinds[c.var] = base.withColumn(c.var, F.explode(self.column(c.value))), "value"
            else:
                if self.table is None:
                    self.table = self.nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))
                self.project(c)
        return self.table


def turned(path: list) -> list:
    flip = {"<": ">", ">": "<", "-": "-"}
    return [RelPattern(x.var, x.types, x.props, flip[x.way], x.hops) if isinstance(x, RelPattern) else x for x in reversed(path)]


def has_aggregate(e) -> bool:
    if not isinstance(e, tuple):
        return isinstance(e, list) and any(map(has_aggregate, e))
    return e[0] == "call" and e[1] in _AGGREGATES or any(has_aggregate(x) for x in e[1:] if isinstance(x, (tuple, list)))


def _cosine(a: Column, b: Column) -> Column:
    from graphloom.operators.search import cosine

    return cosine(a, b)


def cypher(text: str, nodes: DataFrame, edges: DataFrame, params: dict[str, Any] | None = None, most: int = MAX_LENGTH, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The rows of a read-only query; columns are named by alias, else by the text of the expression. ``index`` serves CALL QUERY_FTS_INDEX."""
    out = None
    for how, clauses in Parser(guard(text, most)).query():
        part = Translator(nodes, edges, params or {}, index).run(clauses)
        out = part if out is None else out.union(part)
        if how == "distinct":
            out = out.distinct()
    return out
