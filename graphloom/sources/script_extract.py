"""Entities and references of TypeScript and JavaScript source, by a scanner over text without comments and strings."""

from __future__ import annotations

import re

from .python_extract import KEYS

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_NAME = r"[A-Za-z_$][\w$]*"
#: Words before a parenthesis that are no calls.
KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "import", "constructor", "delete", "void", "in", "of", "else", "do", "case", "throw", "with", "yield", "async", "get", "set", "static"}
BUILTIN_TYPES = {"string", "number", "boolean", "void", "any", "unknown", "never", "null", "undefined", "object", "symbol", "bigint", "this"}


def blanked(source: str) -> str:
    """The source with comments and the insides of strings as blanks, line by line as long as before."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return _SKIP.sub(keep, source)


def closing(text: str, start: int, pair: str = "{}") -> int:
    """Position after the bracket that closes the one at ``start``; the end of the text if none does."""
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, start):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


class Scanner:
    def __init__(self, source: str):
        self.source, self.text = source, blanked(source)
        self.out: dict[str, list] = {k: [] for k in KEYS}
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def symbol(self, kind: str, name: str, start: int, end: int, class_name: str = "", bases: list[str] | None = None) -> None:
        head = self.source[start:end].split("{", 1)[0].split("=>", 1)[0].strip()
        self.out["symbols"].append({"name": name, "kind": kind, "start_line": self.line(start), "end_line": self.line(max(start, end - 1)), "content": self.source[start:end], "signature": re.sub(r"\s+", " ", head)[:500], "class_name": class_name, "decorators": [], "bases": bases or []})

    def run(self) -> dict[str, list]:
        t = self.text
        self.declarations()
        self.modules()
        spans = [(m.start(), closing(t, m.end() - 1)) for m in re.finditer(r"\btry\s*\{", t)]
        for m in re.finditer(rf"(\bnew\s+)?(?:(this|{_NAME})(?:\s*\.\s*{_NAME})*?\s*\??\.\s*)?({_NAME})\s*(?:<[\w\s,.\[\]]*>)?\s*\(", t):
            name, receiver = m[3], m[2] or ""
            before = t[: m.start()].rstrip()
            if name in KEYWORDS or re.search(r"\bfunction\s*\*?$", before) or self._declares(m):
                continue
            args = [a.strip() for a in self.source[m.end() : closing(t, m.end() - 1, "()") - 1].split(",")]
            self.out["calls"].append({"name": name, "line": self.line(m.start(3)), "receiver": receiver, "receiver_type": "", "arguments": [a for a in args if re.fullmatch(_NAME, a) and a not in {"null", "undefined", "true", "false", "this"}], "is_reference": False, "dispatch_kind": "direct", "in_try": any(a < m.start() < b for a, b in spans), "in_except": False, "in_finally": False, "in_loop": False, "awaited": bool(re.search(r"\bawait$", before)), "context_managers": [], "return_consumption": "stored"})
        for m in re.finditer(rf"(?<![?\w])({_NAME})\??\s*:\s*({_NAME})\s*(?=[,)=;\n{{])", t):
            if m[2] not in BUILTIN_TYPES and m[2][:1].isupper():
                variable = re.search(r"\b(?:const|let|var)\s*$", t[: m.start()])
                self.out["type_refs"].append({"name": m[2], "role": "variable" if variable else "param", "line": self.line(m.start()), "param": m[1]})
        for m in re.finditer(rf"\)\s*:\s*({_NAME})\s*(?=\{{|=>|;)", t):
            if m[1] not in BUILTIN_TYPES:
                self.out["type_refs"].append({"name": m[1], "role": "return", "line": self.line(m.start()), "param": ""})
        return self.out

    def _declares(self, m: re.Match) -> bool:
        """Whether a name and parenthesis begin a method: a brace, or a type and a brace, follows the parameters."""
        if m[1] or m[2]:
            return False
        end = closing(self.text, m.end() - 1, "()")
        return bool(re.match(r"\s*(?::[^;{}()]+)?\{", self.text[end:])) and m.start() in self.methods

    def declarations(self) -> None:
        t, self.methods = self.text, set()
        for m in re.finditer(rf"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\basync\s+)?\bfunction\s*\*?\s*({_NAME})", t):
            brace = t.find("{", closing(t, t.find("(", m.end()), "()")) if "(" in t[m.end() :] else -1
            self.symbol("function", m[1], m.start(), closing(t, brace) if brace >= 0 else m.end())
        for m in re.finditer(rf"(?:\bexport\s+)?\b(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+)?=>|{_NAME}\s*=>)", t):
            self.symbol("function", m[1], m.start(), self._body_end(m.end()))
        for m in re.finditer(rf"\b(?:module\.)?exports\.({_NAME})\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|{_NAME}\s*=>)", t):
            self.symbol("function", m[1], m.start(), self._body_end(m.end()))
        for m in re.finditer(rf"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\babstract\s+)?\bclass\s+({_NAME})(?:<[^{{>]*>)?\s*(?:extends\s+([\w$.]+)(?:<[^{{]*?>)?)?\s*(?:implements\s+([^{{]+))?\{{", t):
            end = closing(t, m.end() - 1)
            bases = [m[2]] if m[2] else []
            self.symbol("class", m[1], m.start(), end, bases=bases)
            self.out["heritage"] += [{"child_name": m[1], "kind": "extends", "parent_name": b} for b in bases]
            self.out["heritage"] += [{"child_name": m[1], "kind": "implements", "parent_name": re.sub(r"<.*", "", p).strip()} for p in (m[3] or "").split(",") if p.strip()]
            self._methods_of(m[1], m.end(), end - 1)
        for m in re.finditer(rf"(?:\bexport\s+)?\binterface\s+({_NAME})(?:<[^{{>]*>)?\s*(?:extends\s+([^{{]+))?\{{", t):
            self.symbol("interface", m[1], m.start(), closing(t, m.end() - 1))
            self.out["heritage"] += [{"child_name": m[1], "kind": "extends", "parent_name": re.sub(r"<.*", "", p).strip()} for p in (m[2] or "").split(",") if p.strip()]
        for m in re.finditer(rf"(?:\bexport\s+)?\btype\s+({_NAME})(?:<[^=>]*>)?\s*=[^;\n]*", t):
            self.symbol("type_alias", m[1], m.start(), m.end())

    def _body_end(self, at: int) -> int:
        rest = re.compile(r"\s*\{").match(self.text, at)
        if rest:
            return closing(self.text, rest.end() - 1)
        if self.text[:at].endswith("function"):
            return closing(self.text, self.text.find("{", at)) if "{" in self.text[at:] else len(self.text)
        stop = re.compile(r"[;\n]").search(self.text, at)
        return stop.start() if stop else len(self.text)

    def _methods_of(self, cls: str, low: int, high: int) -> None:
        at = low
        head = re.compile(rf"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*[*#]?({_NAME})\s*(?:<[^(>]*>)?\s*\(")
        while at < high:
            m = head.match(self.text, at)
            if m and m[1] not in KEYWORDS - {"constructor", "get", "set"}:
                end = closing(self.text, m.end() - 1, "()")
                body = re.compile(r"\s*(?::[^;{}]+)?\{").match(self.text, end)
                if body:
                    stop = closing(self.text, body.end() - 1)
                    self.symbol("method", m[1], m.start(), stop, cls)
                    self.methods.update(range(m.start(), m.end()))
                    at = stop
                    continue
            if self.text[at] == "{":
                at = closing(self.text, at)
            else:
                step = re.compile(rf"{_NAME}|.", re.S).match(self.text, at)
                nxt = step.end()
                at = nxt if not head.match(self.text, nxt) else nxt

    def modules(self) -> None:
        s = self.source
        for m in re.finditer(rf"(?m)^\s*import\s+(?:type\s+)?(?:({_NAME})\s*,?\s*)?(?:\*\s*as\s+({_NAME})|\{{([^}}]*)\}})?\s*(?:from\s*)?['\"]([^'\"]+)['\"]", s):
            names = [x.strip().split(" as ")[0].strip() for x in (m[3] or "").split(",") if x.strip()]
            self.out["imports"].append({"module": m[4], "names": [*([m[1]] if m[1] else []), *(["*"] if m[2] else []), *names], "is_relative": m[4].startswith("."), "alias": m[2] or ""})
        for m in re.finditer(rf"(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", s):
            names = [m[1]] if m[1] else [x.split(":")[0].strip() for x in m[2].split(",") if x.strip()]
            self.out["imports"].append({"module": m[3], "names": names, "is_relative": m[3].startswith("."), "alias": ""})
        found = [m[1] for m in re.finditer(rf"\bexport\s+(?:default\s+)?(?:async\s+|abstract\s+)?(?:function\s*\*?|class|interface|type|enum|const|let|var)\s+({_NAME})", self.text)]
        for m in re.finditer(r"\bexport\s*\{([^}]*)\}", self.text):
            found += [x.strip().split(" as ")[-1].strip() for x in m[1].split(",") if x.strip()]
        found += [m[1] for m in re.finditer(rf"\b(?:module\.)?exports\.({_NAME})\s*=", self.text)]
        found += [m[1] for m in re.finditer(rf"\bmodule\.exports\s*=\s*({_NAME})", self.text)]
        for m in re.finditer(r"\bmodule\.exports\s*=\s*\{([^}]*)\}", self.text):
            found += [x.split(":")[0].strip() for x in m[1].split(",") if re.fullmatch(_NAME, x.split(":")[0].strip())]
        self.out["exports"] += list(dict.fromkeys(found))


def extract(source: str) -> dict[str, list]:
    return Scanner(source).run()
