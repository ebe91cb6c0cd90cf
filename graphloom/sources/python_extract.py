"""Entities and references of Python source, from the standard library's syntax trees."""

from __future__ import annotations

import ast
import io
import re
import tokenize

#: Fixed values.
DATACLASS_DECORATORS = {"dataclass", "dataclasses.dataclass", "attr.s", "attrs.define"}
PYDANTIC_BASES = {"BaseModel", "RootModel"}
ENUM_BASES = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}
BUILTIN_TYPES = {
    "str", "int", "float", "bool", "None", "list", "dict", "set", "tuple", "Any", "Optional", "bytes", "complex", "object", "type", "frozenset", "Union", "List", "Dict", "Set", "Tuple", "Callable", "Iterable", "Iterator", "Sequence",
}
POOL_KINDS = {"ThreadPoolExecutor": "thread_executor", "ProcessPoolExecutor": "process_executor"}
LOOP_CALLBACKS = {"call_soon", "call_later", "call_soon_threadsafe"}
JOB_DECORATORS = {"shared_task", "task", "celery.task", "celery.shared_task", "app.task", "app.shared_task"}
CALL_FIELDS = ("dispatch_kind", "in_try", "in_except", "in_finally", "in_loop", "awaited", "context_managers", "return_consumption")
CALL_DEFAULTS = {"dispatch_kind": "direct", "return_consumption": "stored"}
ALL_CAPS = re.compile(r"[A-Z][A-Z0-9_]*")
KEYS = ("symbols", "imports", "calls", "type_refs", "heritage", "exports", "members", "accesses")


def dotted(node: ast.AST) -> str:
    """``a.b.c`` of a name or attribute chain; calls and subscripts count as what they're made on; '' otherwise."""
    if isinstance(node, (ast.Call, ast.Subscript)):
        return dotted(node.func if isinstance(node, ast.Call) else node.value)
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return node.id if isinstance(node, ast.Name) else ""


def outer_type(node: ast.AST | None) -> str:
    """The identifier of an annotation: a generic's outer one, a union's first."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return outer_type(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return ""
    if isinstance(node, ast.BinOp):
        return outer_type(node.left)
    if isinstance(node, ast.Subscript):
        return outer_type(node.value)
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else ""


class Extractor(ast.NodeVisitor):
    """One walk with a stack of scopes: owner class, loop, try and context-manager depth, and bindings of names to classes."""

    def __init__(self, source: str, blocked: frozenset[str] = frozenset()):
        self.source, self.blocked = source, blocked
        self.out: dict[str, list] = {k: [] for k in KEYS}
        self.owner = ""
        self.flags: dict[str, int] = dict.fromkeys(("in_try", "in_except", "in_finally", "in_loop"), 0)
        self.contexts: list[str] = []
        self.scopes: list[dict[str, str]] = [{}]
        self.fields: list[dict[str, str]] = []
        self.aliases: dict[str, str] = {}
        self.parents: dict[ast.AST, ast.AST] = {}

    def run(self) -> dict[str, list]:
        tree = ast.parse(self.source)
        for node in ast.walk(tree):
            for child in ast.iter_child_nodes(node):
                self.parents[child] = node
        self.jobs = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for d in n.decorator_list if self._is_job(dotted(d))}
        for node in tree.body:
            self._constant(node)
        self.visit(tree)
        return self.out

    @staticmethod
    def _is_job(name: str) -> bool:
        return name in JOB_DECORATORS or name.split(".")[0] in {"celery", "app"} and name.split(".")[-1] in {"task", "shared_task"}

    # --- definitions

    def _text(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.source, node) or ""

    def _function(self, node) -> None:
        decorators = [d for d in map(dotted, node.decorator_list) if d]
        ret = f" -> {self._text(node.returns)}" if node.returns else ""
        head = self._text(node)
        inside = re.search(r"def\s+\w+\s*(?:\[[^\]]*\])?\s*\((.*?)\)\s*(?:->|:)", head, re.S)
        params = inside[1] if inside else ast.unparse(node.args)
        self.out["symbols"].append({"name": node.name, "kind": "method" if self.owner else "function", "start_line": node.lineno, "end_line": node.end_lineno, "content": head, "signature": f"def {node.name}({params}){ret}", "class_name": self.owner, "decorators": decorators, "bases": []})
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
            self._type(a.annotation, "param", a.arg)
        self._type(node.returns, "return")
        for d in [*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)]:
            self.visit(d)
        owner, flags, contexts = self.owner, self.flags, self.contexts
        self.owner, self.flags, self.contexts = "", dict.fromkeys(self.flags, 0), []
        self.scopes.append({})
        for child in node.body:
            self.visit(child)
        self.scopes.pop()
        self.owner, self.flags, self.contexts = owner, flags, contexts

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        plain = {b.id for b in node.bases if isinstance(b, ast.Name)}
        decorators = [d for d in map(dotted, node.decorator_list) if d]
        enum = bool(plain & ENUM_BASES)
        bases = [x for x in map(dotted, node.bases) if x]
        self.out["symbols"].append({"name": node.name, "kind": "enum" if enum else "class", "start_line": node.lineno, "end_line": node.end_lineno, "content": self._text(node), "signature": f"class {node.name}", "class_name": "", "decorators": decorators, "bases": bases})
        self.out["heritage"] += [{"child_name": node.name, "kind": "extends", "parent_name": b} for b in bases]
        record = bool(plain & PYDANTIC_BASES) or any(d in DATACLASS_DECORATORS for d in decorators)
        for item in node.body:
            self._member(node.name, item, enum, record)
        for d in node.decorator_list:
            self.visit(d)
        owner, self.owner = self.owner, node.name
        self.fields.append(self._self_fields(node))
        for child in node.body:
            self.visit(child)
        self.fields.pop()
        self.owner = owner

    def _self_fields(self, node: ast.ClassDef) -> dict[str, str]:
        found = {}
        for n in ast.walk(node):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
                for t in n.targets:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        found[t.attr] = dotted(n.value.func).rpartition(".")[2]
        return found

    def _member(self, cls: str, item: ast.stmt, enum: bool, record: bool) -> None:
        targets = [item.target] if isinstance(item, ast.AnnAssign) else item.targets if isinstance(item, ast.Assign) else []
        for t in targets:
            if not isinstance(t, ast.Name) or t.id.startswith("__") and t.id.endswith("__"):
                continue
            if enum:
                if isinstance(item, ast.Assign) and not (t.id.startswith("_") and t.id.endswith("_")):
                    self.out["members"].append({"name": t.id, "parent": cls, "kind": "enum_member", "line": item.lineno})
            elif isinstance(item, ast.AnnAssign) or record and isinstance(item.value, ast.Call) and dotted(item.value.func).rpartition(".")[2] in {"Field", "field"}:
                self.out["members"].append({"name": t.id, "parent": cls, "kind": "class_attribute", "line": item.lineno})

    def _constant(self, item: ast.stmt) -> None:
        literal = (ast.Constant, ast.List, ast.Tuple, ast.Dict, ast.Set, ast.UnaryOp, ast.JoinedStr)
        if isinstance(item, ast.Assign) and len(item.targets) == 1:
            target, fits = item.targets[0], isinstance(item.value, literal)
        elif isinstance(item, ast.AnnAssign):
            target, fits = item.target, isinstance(item.value, literal) or outer_type(item.annotation) == "Final"
        else:
            return
        if not isinstance(target, ast.Name):
            return
        if target.id == "__all__":
            if isinstance(item.value, (ast.List, ast.Tuple)):
                self.out["exports"] += [e.value for e in item.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        elif fits and not (target.id.startswith("__") and target.id.endswith("__")):
            self.out["members"].append({"name": target.id, "parent": "", "kind": "module_constant", "line": item.lineno})

    # --- references

    def _type(self, node: ast.AST | None, role: str, param: str = "") -> None:
        name = outer_type(node)
        if name and name not in BUILTIN_TYPES:
            self.out["type_refs"].append({"name": name, "role": role, "line": node.lineno, "param": param})

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.aliases[a.asname or a.name.split(".")[0]] = a.name.rpartition(".")[2]
            self.out["imports"].append({"module": a.name, "names": [a.name.rpartition(".")[2]], "is_relative": False, "alias": a.asname or ""})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.aliases[a.asname or a.name] = a.name
        self.out["imports"].append({"module": "." * node.level + (node.module or ""), "names": [a.name for a in node.names], "is_relative": node.level > 0, "alias": ""})

    def _nested(self, nodes: list, flag: str) -> None:
        self.flags[flag] += 1
        for n in nodes:
            self.visit(n)
        self.flags[flag] -= 1

    def visit_Try(self, node: ast.Try) -> None:
        self._nested(node.body, "in_try")
        for h in node.handlers:
            for kind in h.type.elts if isinstance(h.type, ast.Tuple) else filter(None, (h.type,)):
                self._reference_to(kind)
        self._nested(node.handlers, "in_except")
        for n in node.orelse:
            self.visit(n)
        self._nested(node.finalbody, "in_finally")

    visit_TryStar = visit_Try

    def visit_Raise(self, node: ast.Raise) -> None:
        if node.exc is not None and not isinstance(node.exc, ast.Call):
            self._reference_to(node.exc)
        self.generic_visit(node)

    def _reference_to(self, node: ast.AST) -> None:
        """A class named by raise or except: a call without scope."""
        path = dotted(node)
        if path:
            head, _, name = path.rpartition(".")
            self._call({"name": name, "line": node.lineno, "receiver": head.partition(".")[0]})

    def _loop(self, node) -> None:
        for part in (node.target, node.iter) if hasattr(node, "iter") else (node.test,):
            self.visit(part)
        self._nested(node.body, "in_loop")
        for n in node.orelse:
            self.visit(n)

    visit_For = visit_AsyncFor = visit_While = _loop

    def _with(self, node) -> None:
        texts = [self._text(i.context_expr)[:80] for i in node.items]
        for i in node.items:
            self.visit(i.context_expr)
            if isinstance(i.optional_vars, ast.Name) and isinstance(i.context_expr, ast.Call):
                self._bind(i.optional_vars.id, i.context_expr)
        self.contexts = self.contexts + texts
        for n in node.body:
            self.visit(n)
        self.contexts = self.contexts[: len(self.contexts) - len(texts)]

    visit_With = visit_AsyncWith = _with

    def _bind(self, name: str, call: ast.Call) -> None:
        made = dotted(call.func).rpartition(".")[2]
        made = self.aliases.get(made, made)
        if made[:1].isupper():
            self.scopes[-1][name] = made

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self._bind(t.id, node.value)
        self._references(node.value)
        for t in node.targets:
            self._access(t, "write")
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._type(node.annotation, "variable", node.target.id if isinstance(node.target, ast.Name) else "")
        self._access(node.target, "write")
        if node.value is not None:
            self._references(node.value)
            self.visit(node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._access(node.target, "both")
        self.visit(node.value)

    def _references(self, value: ast.AST) -> None:
        """Functions put in a name, a list or a dictionary."""
        items = [value] if isinstance(value, ast.Name) else value.elts if isinstance(value, (ast.List, ast.Tuple)) else value.values if isinstance(value, ast.Dict) else []
        for v in items:
            if isinstance(v, ast.Name) and not ALL_CAPS.fullmatch(v.id) and v.id not in self.blocked and v.id not in {"self", "cls"}:
                self._call({"name": v.id, "line": v.lineno, "is_reference": True})

    def _access(self, node: ast.AST, mode: str) -> None:
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            owner = node.value.id
            if owner == "self":
                owner = self._class_of(node)
            if owner[:1].isupper():
                self.out["accesses"].append({"owner": owner, "name": node.attr, "line": node.lineno, "mode": mode})
        elif isinstance(node, ast.Name) and ALL_CAPS.fullmatch(node.id) and mode != "write":
            self.out["accesses"].append({"owner": "", "name": node.id, "line": node.lineno, "mode": mode})

    def _class_of(self, node: ast.AST) -> str:
        while node in self.parents:
            node = self.parents[node]
            if isinstance(node, ast.ClassDef):
                return node.name
        return ""

    def visit_Attribute(self, node: ast.Attribute) -> None:
        parent = self.parents.get(node)
        called = isinstance(parent, ast.Call) and parent.func is node
        if isinstance(node.ctx, ast.Load) and not called and not isinstance(parent, ast.AugAssign):
            self._access(node, "read")
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        parent = self.parents.get(node)
        if isinstance(node.ctx, ast.Load) and not isinstance(parent, ast.Attribute):
            self._access(node, "read")

    def visit_Call(self, node: ast.Call) -> None:
        f, row = node.func, {"line": node.lineno}
        if isinstance(f, ast.Name):
            row |= {"name": f.id}
        elif isinstance(f, ast.Attribute):
            root = dotted(f.value).partition(".")[0]
            row |= {"name": f.attr, "receiver": root}
            if isinstance(f.value, ast.Attribute) and root == "self" and self.fields:
                row["receiver_type"] = self.fields[-1].get(f.value.attr, "")
            elif root not in ("", "self", "cls"):
                row["receiver_type"] = self._bound(root) or (self.aliases.get(root, "") if self.aliases.get(root, "")[:1].isupper() else "")
        if "name" in row:
            row["arguments"] = [a.id for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Name)]
            row |= {k: v > 0 for k, v in self.flags.items()}
            parent = self.parents.get(node)
            row["awaited"] = isinstance(parent, ast.Await)
            row["context_managers"] = list(self.contexts)
            row["return_consumption"] = "awaited" if row["awaited"] else "passed_through" if isinstance(parent, ast.Return) else "ignored" if isinstance(parent, ast.Expr) else "stored"
            row["dispatch_kind"] = self._dispatch(node, row.get("receiver", ""), row.get("receiver_type", ""))
            self._call(row)
        self.generic_visit(node)

    def _bound(self, name: str) -> str:
        return next((s[name] for s in reversed(self.scopes) if name in s), "")

    def _dispatch(self, node: ast.Call, receiver: str, kind: str) -> str:
        name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id
        if isinstance(node.func, ast.Name):
            return "detached_task" if name in {"create_task", "ensure_future"} else "direct"
        owner = kind or receiver
        if owner in POOL_KINDS and name in {"submit", "map"}:
            return POOL_KINDS[owner]
        if name == "create_task" or receiver == "asyncio" and name == "ensure_future" or name in LOOP_CALLBACKS:
            return "detached_task"
        if name == "run_in_executor":
            return "detached_task" if node.args and isinstance(node.args[0], ast.Constant) and node.args[0].value is None else "thread_executor"
        return "enqueued_job" if name in {"apply_async", "delay"} and receiver in self.jobs else "direct"

    def _call(self, row: dict) -> None:
        full = {"name": "", "line": 0, "receiver": "", "receiver_type": "", "arguments": [], "is_reference": False, "dispatch_kind": "direct", "in_try": False, "in_except": False, "in_finally": False, "in_loop": False, "awaited": False, "context_managers": [], "return_consumption": "stored"}
        self.out["calls"].append(full | row)


def extract(source: str, blocked: frozenset[str] = frozenset()) -> dict[str, list]:
    """The eight lists of a file; empty ones where it doesn't parse."""
    try:
        return Extractor(source, blocked).run()
    except (SyntaxError, ValueError, RecursionError):
        return {k: [] for k in KEYS}


def call_metadata(call: dict) -> dict:
    """Of a call's flags those that differ from their default."""
    return {k: call[k] for k in CALL_FIELDS if call[k] != CALL_DEFAULTS.get(k, [] if k == "context_managers" else False)}


def executable_lines(source: str) -> set[int]:
    """Lines that hold code: not comments, blank lines or strings that stand alone, as docstrings do."""
    idle = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}
    prose: set[int] = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            prose.update(range(node.lineno, node.end_lineno + 1))
    lines: set[int] = set()
    for token in tokenize.generate_tokens(io.StringIO(source).readline):
        if token.type not in idle:
            lines.update(range(token.start[0], token.end[0] + 1))
    return lines - prose
