"""Source files parsed into nodes, edges and references, in one pass over each partition.

Python goes through its own grammar. The other languages are read with a light
lexer: comments and strings are blanked, declarations found by their keywords,
and nesting by braces. This approximates a full grammar; it tolerates errors.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.columns import BUILTINS
from weftgraph.schema import EDGES, FLAGS, MAX_BODY_BYTES, NODES, REFS

FAMILY = {"rs": "rust", "py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "go": "go", "java": "java", "md": "markdown", "markdown": "markdown"}

# What adds to cyclomatic complexity, by family, as patterns over blanked source.
DECISIONS = {
    "rust": r"\b(?:if|while|for|loop)\b|=>", "script": r"\b(?:if|while|do|for|case|catch)\b", "go": r"\b(?:if|for|case|select)\b",
    "java": r"\b(?:if|while|do|for|case|default|catch)\b",
}
KEYWORDS = {
    "rust": set("if while for loop match return fn let mut ref move in as else unsafe async await impl where pub use mod struct enum trait Some Ok Err None Self self super crate".split()),
    "script": set("if while for do switch return function typeof new catch await yield super import class const let var of in delete void throw else case instanceof constructor this async".split()),
    "go": set("if for switch select return func go defer range make len cap append new panic recover copy delete close print println case else var const type struct interface map chan string int byte error bool float64 int64".split()),
    "java": set("if while for do switch return new catch super this synchronized throw else case instanceof try assert".split()),
}


@dataclass
class Item:
    """A declaration; ``parent`` is its container's index or -1."""

    kind: str
    name: str
    start: int
    header_end: int
    end: int
    visibility: str = "private"
    flags: set[str] = field(default_factory=set)
    bounds: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    refs: list[tuple[str, str, int | None]] = field(default_factory=list)
    parent: int = -1
    doc: str | None = None
    signature: str = ""
    body: str = ""
    complexity: int | None = None
    qualified: str = ""
    start_line: int = 1
    end_line: int = 1


@dataclass
class Parsed:
    items: list[Item] = field(default_factory=list)
    calls: list[tuple[int, str, int]] = field(default_factory=list)
    module: str = ""


_BLANK = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|r(#+)\".*?\"\1|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'|`[^`]*`", re.S
)


def blank(text: str, family: str) -> str:
    """Comments and strings turned into spaces; line ends and lengths stay."""

    def gap(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    out = _BLANK.sub(gap, text)
    if family == "script":
        out = re.sub(r"'(?:[^'\\\n]|\\.)*'", gap, out)
    return out


def close(text: str, at: int) -> int:
    """Offset behind the brace that closes the one at ``at``, or the end."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


_DECL = {
    "rust": re.compile(
        r"(?m)^[ \t]*(?P<vis>pub(?:\([^)]*\))?\s+)?(?P<mods>(?:(?:default|async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*)"
        r"(?:(?P<kw>fn|struct|enum|trait|mod|type|union)\s+(?P<name>\w+)|(?P<cst>const|static)\s+(?:mut\s+)?(?P<cname>\w+)\s*:|(?P<mac>macro_rules!)\s*(?P<mname>\w+)|(?P<impl>impl)\b(?P<ihead>[^{;]*))"
    ),
    "go": re.compile(
        r"(?m)^(?:func\s*(?:\((?P<recv>[^)]*)\)\s*)?(?P<fname>\w+)|type\s+(?P<tname>\w+)(?:\[[^\]]*\])?\s+(?P<tkind>struct|interface|=?\s*[\w*\[\]().]+)|var\s+_\s+(?P<iface>[\w.]+)\s*=\s*&?(?P<impl>[\w.]+)|(?:const|var)\s+(?P<cname>\w+))"
    ),
    "java": re.compile(
        r"(?m)^[ \t]*(?P<ann>(?:@\w[\w.]*(?:\([^)]*\))?\s+)*)(?P<mods>(?:(?:public|protected|private|static|final|abstract|native|synchronized|default|strictfp|sealed|non-sealed|transient|volatile)\s+)*)"
        r"(?:(?P<kw>class|interface|enum|record|@interface)\s+(?P<name>\w+)|(?:<[^>]+>\s*)?(?P<type>[A-Za-z][\w.<>\[\],?& ]*?)\s+(?P<mname>\w+)\s*\((?=[^;{}]*\)[^;{}]*[{;])|(?P<ctor>[A-Z]\w*)\s*\((?=[^;{}]*\)[^;{}]*\{))"
    ),
    "script": re.compile(
        r"(?m)^[ \t]*(?P<exp>export\s+(?:default\s+)?)?(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|get|set)\s+)*)"
        r"(?:(?P<fn>(?:async\s+)?function)\s*(?P<star>\*)?\s*(?P<fname>[\w$]+)|(?P<kw>class|interface|enum|namespace|module)\s+(?P<name>[\w$]+)|type\s+(?P<tname>[\w$]+)\s*(?:<[^=]*>)?\s*=|(?P<var>const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=;]*)?=\s*(?P<arrow>(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]*)?=>|(?:async\s+)?function)?|(?P<mstar>\*)?(?P<mname>[\w$#]+)\s*(?:<[^>(]*>)?\s*\((?=[^;{}]*\)[^;{}=]*\{))"
    ),
}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def preceding_doc(text: str, at: int) -> str | None:
    """Comment lines that end directly above a declaration."""
    lines = text[:at].split("\n")[:-1] if "\n" in text[:at] else []
    out: list[str] = []
    k = len(lines) - 1
    while k >= 0 and re.match(r"\s*(?:@|#\[)", lines[k]):
        k -= 1
    if k >= 0 and lines[k].rstrip().endswith("*/"):
        while k >= 0:
            out.append(lines[k])
            if "/*" in lines[k]:
                break
            k -= 1
    else:
        while k >= 0 and re.match(r"\s*//", lines[k]):
            out.append(lines[k])
            k -= 1
    return "\n".join(x.strip() for x in reversed(out)) or None


def signature_of(text: str) -> str:
    """Lines up to the first that ends a header."""
    out = []
    for line in text.split("\n"):
        out.append(line.strip())
        if re.search(r"(?:\{|:|=>|=|;)\s*$", line):
            break
    return re.sub(r"\s*(?:\{|=>|=|;|:)\s*$", "", " ".join(out)).strip()


def cut_bytes(text: str, most: int = MAX_BODY_BYTES) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore")


def _types(header: str, family: str) -> list[str]:
    own = set(re.findall(r"<\s*(\w+)\b", header[: header.find("(")] if "(" in header else header))
    found = re.findall(r"\b([A-Z]\w*)\b", header)
    return [t for t in dict.fromkeys(found) if t not in BUILTINS.get(family, ()) and t not in own]


def parse_braces(text: str, family: str, stem: str) -> Parsed:
    """Declarations, calls and references of a Rust, Go, Java or script file."""
    src = blank(text, family)
    out = Parsed(module=stem)
    impls: list[tuple[int, int, str, str | None]] = []
    words = KEYWORDS[family]
    for m in _DECL[family].finditer(src):
        g = m.groupdict()
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        kind, name, refs, flags, vis, ann = "", "", [], set(), "private", []
        if family == "rust":
            if g["impl"]:
                head = g["ihead"]
                brace = src.find("{", m.end())
                if brace < 0:
                    continue
                of = re.sub(r"^\s*<[^{]*?>\s*(?=\w|&|dyn)", "", head)
                trait, _, target = of.partition(" for ")
                target, trait = (target, trait) if target else (trait, "")
                name_of = lambda s: (re.findall(r"\w+", re.sub(r"<.*", "", s.split(" where ")[0])) or [""])[-1]
                impls.append((brace, close(src, brace), name_of(target), name_of(trait) or None))
                continue
            mods = g["mods"] or ""
            flags |= {f for w, f in (("async", "is_async"), ("unsafe", "is_unsafe"), ("const", "is_const")) if w in mods}
            kind = {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type_alias"}.get(g["kw"] or "", "")
            name = g["name"] or g["cname"] or g["mname"] or ""
            if g["cst"]:
                kind = "constant"
                flags |= {"is_const"} if g["cst"] == "const" else {"is_static"}
            if g["mac"]:
                kind = "macro"
            v = (g["vis"] or "").strip()
            vis = "pub" if v == "pub" else "pub_crate" if v.startswith("pub(") else "private"
            ann = re.findall(r"#\[\s*(\w+)", "\n".join(_above(src, start)))
        elif family == "go":
            if g["iface"]:
                out.items.append(Item("", "", start, m.end(), m.end(), refs=[("implements", g["iface"].split(".")[-1], _line(src, start))], signature=g["impl"].split(".")[-1]))
                continue
            name = g["fname"] or g["tname"] or g["cname"] or ""
            if name == "_":
                continue
            if g["fname"]:
                kind = "method" if g["recv"] else "function"
                if g["recv"]:
                    ann = [(re.findall(r"\w+", re.sub(r"\[.*?\]", "", g["recv"])) or [""])[-1]]
                else:
                    flags.add("is_static")
            elif g["tname"]:
                kind = {"struct": "struct", "interface": "interface"}.get(g["tkind"], "type_alias")
            else:
                kind = "constant"
                if m[0].lstrip().startswith("const"):
                    flags.add("is_const")
            vis = "pub" if name[:1].isupper() else "private"
        elif family == "java":
            mods = g["mods"] or ""
            ann = re.findall(r"@(\w+)", g["ann"] or "")
            if g["kw"]:
                kind, name = {"class": "struct", "record": "struct", "enum": "enum", "interface": "interface", "@interface": "interface"}[g["kw"]], g["name"]
            else:
                kind, name = "method", g["mname"] or g["ctor"]
                if name in words or (g["type"] or "").split(" ")[0] in words | {"return", "throw", "new", "else"}:
                    continue
            flags |= {f for w, f in (("static", "is_static"), ("abstract", "is_abstract"), ("final", "is_final")) if w in mods.split()}
            vis = "pub" if "public" in mods else "pub_crate" if "protected" in mods or not re.search("private", mods) else "private"
            if kind == "interface":
                flags.add("is_abstract")
        else:
            mods = g["mods"] or ""
            if g["fname"]:
                kind, name = "function", g["fname"]
                if g["star"]:
                    flags.add("is_generator")
            elif g["kw"]:
                kind, name = {"class": "struct", "interface": "interface", "enum": "enum"}.get(g["kw"], "module"), g["name"]
            elif g["tname"]:
                kind, name = "type_alias", g["tname"]
            elif g["vname"]:
                kind, name = ("function" if g["arrow"] else "constant"), g["vname"]
                if not g["arrow"] and g["var"] != "const":
                    continue
                if kind == "constant":
                    flags.add("is_const")
            else:
                kind, name = "method", g["mname"]
                if name in words and name != "constructor":
                    continue
                if g["mstar"]:
                    flags.add("is_generator")
                if re.search(r"\b(?:get|set)\b", mods):
                    kind = "property"
                    flags.add("is_property")
            flags |= {f for w, f in (("static", "is_static"), ("abstract", "is_abstract"), ("async", "is_async")) if w in mods.split()}
            if g["fn"] and "async" in g["fn"] or (g["arrow"] or "").startswith("async"):
                flags.add("is_async")
            if kind == "interface":
                flags.add("is_abstract")
            vis = "private" if "private" in mods or (name or "").startswith("#") else "pub_crate" if "protected" in mods else "pub" if g["exp"] or kind in ("method", "property") else "private"
            ann = re.findall(r"@(\w+)", "\n".join(_above(src, start)))
        if not kind or not name:
            continue
        stop = re.compile(r"[{;]" if family != "go" else r"[{\n]").search(src, m.end())
        if stop and src[stop.start()] == "{":
            brace, end = stop.start(), close(src, stop.start())
        else:
            brace = end = stop.start() if stop else len(src)
        header = src[start:brace]
        if kind in ("function", "method"):
            refs += [("uses", t, None) for t in _types(header[len(m[0].lstrip()) - 1 :] if family != "java" else header, family) if t != name]
        if family == "java":
            if (t := re.search(r"\bextends\s+([\w.]+)", header)) and kind == "struct":
                refs.append(("inherits", t[1].split(".")[-1], None))
            if t := re.search(r"\b(?:implements|extends)\s+([\w.,\s<>]+)$", header) if kind == "interface" else re.search(r"\bimplements\s+([\w.,\s<>]+)", header):
                refs += [("implements" if kind != "interface" else "inherits", re.sub(r"<.*", "", x).strip().split(".")[-1], None) for x in re.sub(r"<[^>]*>", "", t[1]).split(",")]
            if t := re.search(r"\bthrows\s+([\w.,\s]+)", header):
                refs += [("throws", x.strip().split(".")[-1], None) for x in t[1].split(",")]
        if family == "script" and kind in ("struct", "interface"):
            if t := re.search(r"\bextends\s+([\w$.]+)", header):
                refs.append(("inherits", t[1].split(".")[-1], None))
            if t := re.search(r"\bimplements\s+([\w$.,\s<>]+)", header):
                refs += [("implements", x.strip().split(".")[-1], None) for x in re.sub(r"<[^>]*>", "", t[1]).split(",")]
        if family == "go" and kind == "struct":
            for line in src[brace + 1 : end - 1].split("\n"):
                if t := re.fullmatch(r"\s*\*?([A-Z]\w*)\s*", line):
                    refs.append(("inherits", t[1], None))
        refs += [("annotated", a, None) for a in ann if family != "go"]
        bounds = re.findall(r"<([^>]*:[^>]*)>", header) if family == "rust" else []
        item = Item(kind, name, start, brace, end, vis, flags, [b.strip() for b in bounds], ann, refs)
        out.items.append(item)
    _finish(out, text, src, family, impls)
    return out


def _above(src: str, at: int) -> list[str]:
    """Attribute lines directly above an offset."""
    lines = src[:at].split("\n")[:-1]
    out = []
    while lines and re.match(r"\s*(?:#\[|@)", lines[-1]):
        out.append(lines.pop())
    return out


def _finish(out: Parsed, text: str, src: str, family: str, impls: list) -> None:
    """Containers, names, documentation, calls and complexity."""
    asserts = [x for x in out.items if not x.kind]
    out.items = [x for x in out.items if x.kind]
    sep = "::" if family == "rust" else "."
    by_type = {x.name: k for k, x in enumerate(out.items) if x.kind in ("struct", "enum", "trait", "interface", "type_alias")}
    for k, x in enumerate(out.items):
        inner = [j for j, y in enumerate(out.items) if j != k and y.header_end < x.start < y.end and y.kind in ("struct", "enum", "trait", "interface", "module", "function", "method")]
        x.parent = max(inner, key=lambda j: out.items[j].start) if inner else -1
        for a, b, target, _ in impls:
            if a < x.start < b and target in by_type and x.kind == "function":
                x.parent, x.kind = by_type[target], "method"
        if family == "go" and x.kind == "method":
            x.parent = by_type.get(x.annotations[0], -1) if x.annotations else -1
            x.annotations = []
        if x.parent >= 0 and out.items[x.parent].kind in ("trait", "struct", "interface", "enum") and x.kind == "function" and family != "go":
            x.kind = "method"
    out.items = [x for x in out.items]
    for x in asserts:
        if x.signature in by_type:
            out.items[by_type[x.signature]].refs += x.refs
    for a, _, target, trait in impls:
        if trait and target in by_type:
            out.items[by_type[target]].refs.append(("implements", trait, None))
    prefix = "crate" if family == "rust" else out.module
    for x in out.items:
        chain, p, guard = [x.name], x.parent, 0
        while p >= 0 and guard < 50:
            chain.append(out.items[p].name)
            p, guard = out.items[p].parent, guard + 1
        x.qualified = sep.join([prefix, *reversed(chain)])
        x.start_line, x.end_line = _line(src, x.start), _line(src, max(x.start, x.end - 1))
        x.doc = preceding_doc(text, x.start)
        x.signature = signature_of(text[x.start : x.header_end + 1])
        x.body = cut_bytes(text[x.start : x.end])
        if x.kind in ("function", "method", "property"):
            x.complexity = 1 + len(re.findall(DECISIONS[family], src[x.header_end : x.end]))
    functions = [(k, x) for k, x in enumerate(out.items) if x.kind in ("function", "method", "property")]
    for m in re.finditer(r"(?<![\w$])(?:[\w$]+\s*(?:\.|::)\s*)*([\w$]+)\s*(?:::\s*<[^>()]*>)?\(", src):
        name = m[1]
        if name in KEYWORDS[family] or name[:1].isdigit() or re.search(r"\b(?:fn|func|function|def|class|new)\s+$", src[max(0, m.start() - 12) : m.start()]):
            continue
        owner = [(k, x) for k, x in functions if x.header_end < m.start() < x.end]
        if owner:
            k = max(owner, key=lambda kx: kx[1].start)[0]
            out.calls.append((k, name, _line(src, m.start())))
    imports = {
        "rust": r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", "go": r"\Z.", "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+);",
        "script": r"(?m)^\s*import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\b",
    }[family]
    for m in re.finditer(imports, src):
        at = _line(src, m.start())
        if family == "script":
            names = [x.strip().split(" as ")[0].replace("type ", "").strip() for x in (m[2] or "").split(",")] + [m[1] or ""]
        elif family == "java":
            names = [m[1].rsplit(".", 1)[-1]]
        else:
            flat = re.sub(r"\s+as\s+\w+", "", m[1])
            names = re.findall(r"(?:^|[:{,\s])(\w+)\s*(?=[,}]|$)", flat)
        out.calls += [(-1, n, at) for n in names if n and n not in ("self", "crate", "super")]


class _Python(ast.NodeVisitor):
    def __init__(self, text: str, stem: str) -> None:
        self.text, self.lines, self.out = text, text.split("\n"), Parsed(module=stem)
        self.stack: list[int] = []

    def _add(self, node, kind: str, name: str, **extra) -> int:
        parent = self.stack[-1] if self.stack else -1
        chain, p = [name], parent
        while p >= 0:
            chain.append(self.out.items[p].name)
            p = self.out.items[p].parent
        x = Item(kind, name, 0, 0, 0, "private" if name.startswith("_") else "pub", parent=parent, **extra)
        x.qualified = ".".join([self.out.module, *reversed(chain)])
        x.start_line, x.end_line = node.lineno, node.end_lineno or node.lineno
        body = "\n".join(self.lines[x.start_line - 1 : x.end_line])
        x.body, x.signature = cut_bytes(body), signature_of(body)
        self.out.items.append(x)
        return len(self.out.items) - 1

    def _decorators(self, node) -> list[str]:
        names = []
        for d in node.decorator_list:
            d = d.func if isinstance(d, ast.Call) else d
            names.append(d.attr if isinstance(d, ast.Attribute) else getattr(d, "id", ""))
        return [n for n in names if n]

    def _annotation_types(self, *nodes) -> list[str]:
        out = []
        for n in nodes:
            if n is not None:
                for x in ast.walk(n):
                    name = x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else x.value if isinstance(x, ast.Constant) and isinstance(x.value, str) else None
                    if name and name.isidentifier() and name not in BUILTINS["python"]:
                        out.append(name)
        return list(dict.fromkeys(out))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [b.attr if isinstance(b, ast.Attribute) else getattr(b.value if isinstance(b, ast.Subscript) else b, "id", "") for b in node.bases]
        deco = self._decorators(node)
        kind = "interface" if "Protocol" in bases else "struct"
        refs = [("implements", b, None) for b in bases if b and b not in BUILTINS["python"]]
        refs += [(k, d, None) for d in deco for k in ("annotated", "uses") if d not in BUILTINS["python"]]
        k = self._add(node, kind, node.name, annotations=deco, refs=refs)
        self.out.items[k].doc = ast.get_docstring(node, clean=False)
        self.stack.append(k)
        for x in node.body:
            self.visit(x)
        self.stack.pop()

    def _function(self, node) -> None:
        deco = self._decorators(node)
        inside = bool(self.stack) and self.out.items[self.stack[-1]].kind in ("struct", "interface")
        kind = "property" if inside and "property" in deco else "method" if inside else "function"
        a = node.args
        types = self._annotation_types(*[x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]], node.returns)
        flags = {f for ok, f in ((isinstance(node, ast.AsyncFunctionDef), "is_async"), ("property" in deco, "is_property"), ("staticmethod" in deco, "is_static"), ("abstractmethod" in deco, "is_abstract")) if ok}
        refs = [("uses", t, None) for t in types] + [(k, d, None) for d in deco for k in ("annotated", "uses") if d not in BUILTINS["python"] and d != "property"]
        k = self._add(node, kind, node.name, annotations=deco, flags=flags, refs=refs)
        item = self.out.items[k]
        item.doc = ast.get_docstring(node, clean=False)
        n, todo = 1, list(node.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                if not isinstance(x, ast.Lambda):
                    continue
            if isinstance(x, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler)):
                n += 1
            if isinstance(x, (ast.Yield, ast.YieldFrom)):
                item.flags.add("is_generator")
            if isinstance(x, ast.Call):
                name = x.func.attr if isinstance(x.func, ast.Attribute) else getattr(x.func, "id", "")
                if name:
                    self.out.calls.append((k, name, x.lineno))
            todo += list(ast.iter_child_nodes(x))
        item.complexity = n
        self.stack.append(k)
        for x in node.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.visit(x)
        self.stack.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.stack:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self._add(node, "constant", t.id, flags={"is_const"})

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if not self.stack and isinstance(node.target, ast.Name):
            self._add(node, "constant", node.target.id, flags={"is_const"})

    def _import(self, node) -> None:
        self.out.calls += [(-1, a.name.rsplit(".", 1)[-1], node.lineno) for a in node.names if a.name != "*"]

    visit_Import = visit_ImportFrom = _import


def parse_python(text: str, stem: str) -> Parsed:
    v = _Python(text, stem)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return v.out
    for x in tree.body:
        v.visit(x)
    return v.out


def parse_markdown(text: str, stem: str) -> Parsed:
    """Headings as nested sections; code spans and link texts as references of the section they stand in."""
    out = Parsed(module=stem)
    stack: list[tuple[int, int]] = []
    fence = False
    lines = text.split("\n")
    for no, line in enumerate(lines, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line):
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                out.items[stack.pop()[1]].end_line = no - 1
            x = Item("section", m[2], 0, 0, 0, "pub", parent=stack[-1][1] if stack else -1, start_line=no, end_line=len(lines))
            slug = re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", m[2].lower()))
            x.qualified = f"{out.module}#{slug}"
            out.items.append(x)
            stack.append((level, len(out.items) - 1))
        if stack:
            for span in re.findall(r"`([^`\n]+)`|\[([^\]\n]+)\]\(", line):
                bare = re.sub(r"\(\)$", "", (span[0] or span[1]).strip())
                last = re.split(r"::|\.", bare)[-1]
                if re.fullmatch(r"[A-Za-z_][\w:.]*", bare) and len(last) >= 3:
                    out.items[stack[-1][1]].refs.append(("references", last, no))
    return out


def parse_text(path: str, text: str) -> Parsed:
    family = FAMILY.get(path.rsplit(".", 1)[-1].lower(), "")
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if family == "python":
        return parse_python(text, stem)
    if family == "markdown":
        return parse_markdown(text, stem)
    if family in _DECL:
        if family == "go" and (m := re.search(r"(?m)^package\s+(\w+)", blank(text, family))):
            stem = m[1]
        return parse_braces(text, family, stem)
    return Parsed(module=stem)


def node_id(file: str, kind: str, qualified: str, ordinal: int = 0) -> str:
    """A stable id by content: no branch and no line, so branches can be compared."""
    return hashlib.sha256(f"{file}\0{kind}\0{qualified}\0{ordinal}".encode()).hexdigest()[:32]


def rows_of(branch: str, path: str, text: str) -> tuple[list, list, list]:
    """Node, edge and reference rows of one file, its module node included."""
    p = parse_text(path, text)
    family = FAMILY.get(path.rsplit(".", 1)[-1].lower(), "")
    n_lines = text.count("\n") + 1
    blank_row = {f: False for f in FLAGS}
    module = node_id(path, "module", p.module)
    nodes, edges, refs = [], [], []

    def node(i: str, x: Item) -> dict:
        return {
            "branch": branch, "id": i, "kind": x.kind, "name": x.name, "qualified_name": x.qualified, "file": path, "start_line": x.start_line, "end_line": x.end_line,
            "loc": x.end_line - x.start_line + 1, "visibility": x.visibility, **blank_row, **{f: True for f in x.flags}, "generic_bounds": x.bounds, "def_signature": x.signature or None,
            "def_body": x.body or None, "def_doc": x.doc, "def_start_byte": None, "def_end_byte": None, "complexity": x.complexity, "annotations": x.annotations,
        }

    nodes.append(node(module, Item("module", p.module, 0, 0, 0, "pub", qualified=p.module, start_line=1, end_line=n_lines)))
    seen: dict[tuple[str, str], int] = {}
    ids = []
    for x in p.items:
        k = seen.get((x.kind, x.qualified), 0)
        seen[x.kind, x.qualified] = k + 1
        ids.append(node_id(path, x.kind, x.qualified, k))
        nodes.append(node(ids[-1], x))
    for i, x in zip(ids, p.items, strict=True):
        edges.append((branch, ids[x.parent] if x.parent >= 0 else module, i, "contains", None, "extracted"))
    local: dict[str, str] = {}
    for i, x in zip(ids, p.items, strict=True):
        if x.kind in ("function", "method"):
            local.setdefault(x.name, i)
    types = {x.name: i for i, x in zip(ids, p.items, strict=True) if x.kind in ("struct", "enum", "trait", "interface", "type_alias")}
    done = set()
    for k, name, line in p.calls:
        src = ids[k] if k >= 0 else module
        kind = "calls" if k >= 0 else "imports"
        if (src, name, kind) in done:
            continue
        done.add((src, name, kind))
        if kind == "calls" and name in local and local[name] != src:
            edges.append((branch, src, local[name], "calls", line, "extracted"))
        else:
            refs.append((branch, src, path, name, kind, line))
    for i, x in zip(ids, p.items, strict=True):
        for kind, name, line in x.refs:
            if name in BUILTINS.get(family, ()) or (i, name, kind) in done:
                continue
            done.add((i, name, kind))
            if name in types and types[name] != i and kind != "references":
                edges.append((branch, i, types[name], kind, None, "extracted"))
            else:
                refs.append((branch, i, path, name, kind, line))
    return nodes, edges, refs


_PARSED = T.StructType([T.StructField("n", NODES), T.StructField("e", EDGES), T.StructField("r", REFS)])


def parse_files(files: DataFrame) -> DataFrame:
    """files: branch, path, source_text. One row for each node (n), edge (e) or reference (r); the other two are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_, e_, r_ = [], [], []
            for branch, path, text in zip(pdf["branch"], pdf["path"], pdf["source_text"], strict=True):
                n, e, r = rows_of(branch, path, (text or "").replace("\r\n", "\n"))
                n_ += n
                e_ += [dict(zip(EDGES.names, x, strict=True)) for x in e]
                r_ += [dict(zip(REFS.names, x, strict=True)) for x in r]
            none = [None]
            yield pd.DataFrame({"n": n_ + none * (len(e_) + len(r_)), "e": none * len(n_) + e_ + none * len(r_), "r": none * (len(n_) + len(e_)) + r_})

    return files.select("branch", "path", "source_text").where("path is not null").mapInPandas(run, _PARSED)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(parsed.where(F.col(c).isNotNull()).select(f"{c}.*") for c in ("n", "e", "r"))  # type: ignore[return-value]


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder and file nodes of paths, and contains edges from folders down to modules. files: branch, path, n_lines."""
    parts = files.select("branch", "path", "n_lines", F.split("path", "/").alias("p"))
    sha = lambda kind, c: F.substring(F.sha2(F.concat_ws("\0", c, F.lit(kind), c, F.lit("0")), 256), 1, 32)
    above = F.expr("case when size(p) > 1 then transform(sequence(1, size(p) - 1), i -> concat_ws('/', slice(p, 1, i))) end")
    up = parts.select("branch", F.explode(above).alias("folder")).where("folder <> ''").distinct()
    folder = up.select("branch", sha("folder", F.col("folder")).alias("id"), F.lit("folder").alias("kind"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.col("folder").alias("qualified_name"), F.col("folder").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    file = parts.select("branch", sha("file", F.col("path")).alias("id"), F.lit("file").alias("kind"), F.element_at("p", -1).alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file"), F.lit(1).alias("start_line"), F.col("n_lines").alias("end_line"))
    known = set(folder.columns)
    every = folder.unionByName(file)
    nodes = every.select(*[F.col(f.name) if f.name in known else (F.col("end_line") if f.name == "loc" else F.lit("pub") if f.name == "visibility" else F.lit(False) if f.name in FLAGS else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES])
    parent = F.regexp_extract("file", r"^(.*)/[^/]+$", 1)
    edges = every.where(parent != "").select("branch", sha("folder", parent).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit("extracted").alias("confidence"))
    return nodes, edges


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole graph from files (branch, path, source_text): nodes, edges with resolved references, and the references.

    The parse is checkpointed once, for its three parts are used several times.
    """
    from weftgraph.operators.resolve import resolve_references
    from weftgraph.session import checkpointed

    parsed = checkpointed(parse_files(files))
    n, e, r = split_parsed(parsed)
    sn, se = structure(files.where("path is not null").select("branch", "path", (F.length("source_text") - F.length(F.replace("source_text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("n_lines")))
    link = n.where("kind = 'module'").select("branch", F.substring(F.sha2(F.concat_ws("\0", "file", F.lit("file"), "file", F.lit("0")), 256), 1, 32).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit("extracted").alias("confidence"))
    nodes = n.unionByName(sn)
    cols = EDGES.names
    resolved = resolve_references(r, nodes)[0].select(*cols)
    edges = e.unionByName(se.select(*cols)).unionByName(link.select(*cols)).unionByName(resolved)
    return nodes, edges.dropDuplicates(["branch", "src", "dst", "kind"]), r
