"""Facts read from source code: functions, calls, routes, data models, logging and entry points.

Rust and TypeScript are read by a light scanner: comments and the insides of strings are blanked, brackets are
paired, and what stands between them is matched on that skeleton, so nothing is taken from a comment or a string. Python is
read from its syntax tree. Everything runs by Arrow batches, one pass, no shuffle. A null text, and one that can't be parsed,
gives no rows.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrain.sources.formats import table_of

# Names by which frameworks and conventions are known.
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "trace")
TS_APPS = ("app", "router", "server", "fastify", "api")
RUST_MODEL_MARKS = ("FromRow", "Entity", "Table", "Queryable", "Insertable")
PY_MODEL_BASES = ("BaseModel", "Base", "db.Model", "models.Model", "Model", "SQLModel", "DeclarativeBase")
MODEL_FOLDERS = ("models/", "entities/", "schemas/", "types/")
LEVELS = {"trace": "trace", "debug": "debug", "info": "info", "log": "info", "warn": "warn", "warning": "warn", "error": "error", "exception": "error", "critical": "error", "fatal": "error"}
ENTRY_FILES = ("main", "index", "server", "app")

_BLANKED = {
    "rust": re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\])\'', re.S),
    "typescript": re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S),
}
_FUNCTION = {
    "rust": re.compile(r"\bfn\s+([A-Za-z_]\w*)"),
    "typescript": re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::[^={;]+)?=>"),
}
_METHOD = re.compile(r"(?:^|[{;}])[ \t]*(?:(?:public|private|protected|static|async|readonly)\s+)*([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::[^{;=]+)?\{", re.M)
_CALL = re.compile(r"(?<![\w$.])((?:[A-Za-z_$][\w$]*(?:::<[^<>()]*>)?::)*[A-Za-z_$][\w$]*)\s*(?:::<[^<>()]*>)?\(|\.\s*([A-Za-z_$][\w$]*)\s*(?:::<[^<>()]*>)?\(")
_NO_CALL = frozenset("if while for match return switch catch fn function in as loop else await typeof new super move where use let const mut pub impl".split())


class Skeleton:
    """A source with blanked comments and strings, its paired brackets and its functions."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.strings: dict[int, str] = {}

        def blank(m: re.Match) -> str:
            part = m[0]
            if part[:2] in ("//", "/*"):
                return re.sub(r"[^\n]", " ", part)
            quote = part[0] if part[0] != "r" else '"'
            self.strings[m.start()] = part.strip("r#").strip(quote)
            return quote + re.sub(r"[^\n]", "_", part[1:-1]) + quote

        self.code = _BLANKED[language].sub(blank, text)
        self.close: dict[int, int] = {}
        opened: list[tuple[str, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            c = m[0]
            if c in "({[":
                opened.append((c, m.start()))
            else:
                while opened and opened[-1][0] != {")": "(", "}": "{", "]": "["}[c]:
                    opened.pop()
                if opened:
                    self.close[opened.pop()[1]] = m.start()
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.functions = self._functions()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def _functions(self) -> list[tuple[str, int, int, int]]:
        """(name, declared at, body from, body to), by the place of declaration."""
        found = [(m[1] or (m.lastindex == 2 and m[2]), m.start(), m.end()) for m in _FUNCTION[self.language].finditer(self.code)]
        if self.language == "typescript":
            found += [(m[1], m.start(1), m.end() - 1) for m in _METHOD.finditer(self.code) if m[1] not in _NO_CALL and m[1] != "constructor"]
        out = []
        for name, at, end in sorted(found, key=lambda f: f[1]):
            body = end
            while body < len(self.code) and self.code[body] not in "{;":
                body = self.close.get(body, body) + 1 if self.code[body] in "([" else body + 1
            if body < len(self.code) and self.code[body] == "{":
                out.append((name, at, body, self.close.get(body, len(self.code))))
            else:
                out.append((name, at, end, body))
        return out

    def around(self, at: int) -> str | None:
        """The innermost function whose body holds a place."""
        best = None
        for name, _, low, high in self.functions:
            if low <= at <= high and (best is None or low >= best[1]):
                best = (name, low)
        return best[0] if best else None

    def attributes(self, at: int) -> list[str]:
        """Attributes or decorators on the lines right above a declaration, and on its own line before it."""
        first = bisect_right(self.lines, at - 1)
        head = self.text[self.lines[first - 1] + 1 if first else 0 : at]
        rows = [head]
        while first > 0:
            row = self.text[self.lines[first - 2] + 1 if first > 1 else 0 : self.lines[first - 1]]
            if not re.match(r"\s*(#!?\[|@|//|$)", row) or not row.strip():
                break
            rows.append(row)
            first -= 1
        marks = re.findall(r"#\[(?:[^\[\]]|\[[^\]]*\])*\]", "\n".join(rows)) if self.language == "rust" else re.findall(r"@[\w.$]+(?:\([^)]*\))?", "\n".join(rows))
        return marks

    def string_at(self, low: int, high: int) -> str | None:
        """The first string that begins in [low, high)."""
        return next((self.strings[k] for k in sorted(self.strings) if low <= k < high), None)

    def arguments(self, opening: int) -> list[tuple[int, int]]:
        """The spans of the arguments in the bracket that opens there."""
        out, at, end = [], opening + 1, self.close.get(opening, len(self.code))
        begin = at
        while at < end:
            if self.code[at] in "([{":
                at = self.close.get(at, end) + 1
                continue
            if self.code[at] == ",":
                out.append((begin, at))
                begin = at + 1
            at += 1
        if self.code[begin:end].strip():
            out.append((begin, end))
        return out


class Call(NamedTuple):
    caller: str | None
    callee: str
    kind: str  # direct, scoped, method
    line: int


class Route(NamedTuple):
    method: str
    path: str | None
    handler: str
    framework: str
    line: int


class Model(NamedTuple):
    name: str
    kind: str
    evidence: str
    line: int


class Logging(NamedTuple):
    what: str  # telemetry or error
    framework: str
    level: str
    in_test: bool
    line: int


class Entry(NamedTuple):
    name: str
    kind: str  # TEST, FFI, ENTRYPOINT, HANDLER, PUBLIC_API, INTERNAL
    line: int


def _scanned_calls(s: Skeleton) -> Iterator[Call]:
    declared = {m.start(1) for m in _FUNCTION[s.language].finditer(s.code) if m[1]} | {m.start(1) for m in _METHOD.finditer(s.code) if s.language == "typescript"}
    for m in _CALL.finditer(s.code):
        at = m.start(1) if m[1] else m.start(2)
        name = re.sub(r"::<[^<>()]*>", "", m[1] or m[2])
        if at not in declared and name not in _NO_CALL:
            yield Call(s.around(at), name.split("::")[-1], "method" if m[2] else "scoped" if "::" in name else "direct", s.line(at))


def _rust_routes(s: Skeleton) -> Iterator[Route]:
    for m in re.finditer(r"\broute\s*\(", s.code):
        args = s.arguments(m.end() - 1)
        if len(args) < 2:
            continue
        path = s.string_at(*args[0])
        for x in re.finditer(rf"\b({'|'.join(HTTP_METHODS)})\s*\(\s*([\w:]*)", s.code[args[1][0] : args[1][1]]):
            yield Route(x[1].upper(), path, x[2].split("::")[-1] or "unknown", "axum", s.line(m.start()))
    for name, at, _, _ in s.functions:
        for mark in s.attributes(at):
            x = re.match(rf"#\[\s*(?:[\w:]+::)?({'|'.join(HTTP_METHODS)})\s*(?:\(\s*\"([^\"]*)\")?", mark)
            if x:
                yield Route(x[1].upper(), x[2], name, "attribute", s.line(at))


def _ts_routes(s: Skeleton) -> Iterator[Route]:
    fastify = "fastify" in s.text.lower()
    for m in re.finditer(rf"\b({'|'.join(TS_APPS)})\s*\.\s*({'|'.join(HTTP_METHODS)})\s*\(", s.code):
        args = s.arguments(m.end() - 1)
        if len(args) >= 2:
            handler = s.code[args[-1][0] : args[-1][1]].strip()
            framework = "fastify" if fastify and m[1] in ("fastify", "server", "app") else "express"
            yield Route(m[2].upper(), s.string_at(*args[0]), handler if re.fullmatch(r"[\w$.]+", handler) else "anonymous", framework, s.line(m.start()))


def _decorators(node: ast.AST) -> list[ast.expr]:
    return getattr(node, "decorator_list", [])


def _py_routes(tree: ast.AST, _: str = "") -> Iterator[Route]:
    routers = {t.id for n in ast.walk(tree) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and ast.unparse(n.value.func).endswith(("APIRouter", "FastAPI")) for t in n.targets if isinstance(t, ast.Name)}
    for node in ast.walk(tree):
        for mark in _decorators(node):
            if not (isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and isinstance(mark.func.value, ast.Name)):
                continue
            path = next((a.value for a in mark.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
            framework = "fastapi" if mark.func.value.id in routers else "flask"
            if mark.func.attr in HTTP_METHODS:
                yield Route(mark.func.attr.upper(), path, node.name, framework, node.lineno)
            elif mark.func.attr == "route":
                given = next((k.value for k in mark.keywords if k.arg == "methods"), None)
                names = [e.value for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, (ast.List, ast.Tuple)) else ["GET"]
                yield from (Route(str(n).upper(), path, node.name, framework, node.lineno) for n in names)


def _rust_models(s: Skeleton, _: str) -> Iterator[Model]:
    for m in re.finditer(r"\b(struct|enum)\s+([A-Za-z_]\w*)", s.code):
        hit = next((w for mark in s.attributes(m.start()) for w in RUST_MODEL_MARKS if w in mark), None)
        if hit:
            yield Model(m[2], "struct", hit, s.line(m.start()))


def _ts_models(s: Skeleton, path: str) -> Iterator[Model]:
    known = set()
    for m in re.finditer(r"\bclass\s+([A-Za-z_$][\w$]*)(?:\s+extends\s+([\w$.]+))?", s.code):
        hit = "@Entity" if any(x.startswith("@Entity") for x in s.attributes(m.start())) else "extends Model" if (m[2] or "").split(".")[-1] == "Model" else None
        if hit:
            known.add(m[1])
            yield Model(m[1], "class", hit, s.line(m.start()))
    folder = next((f for f in MODEL_FOLDERS if f in path), None)
    if folder:
        for m in re.finditer(r"\b(interface|type)\s+([A-Za-z_$][\w$]*)", s.code):
            if m[2] not in known:
                yield Model(m[2], "interface" if m[1] == "interface" else "schema", folder, s.line(m.start()))


def _py_models(tree: ast.AST, _: str) -> Iterator[Model]:
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            hit = next((b for b in bases if b in PY_MODEL_BASES), None) or ("dataclass" if any("dataclass" in ast.unparse(d) for d in node.decorator_list) else None)
            if hit:
                yield Model(node.name, "class", hit, node.lineno)


def _rust_logging(s: Skeleton) -> Iterator[Logging]:
    tests = {name for name, at, _, _ in s.functions if any(re.search(r"\btest\b", a) for a in s.attributes(at))}
    for m in re.finditer(r"\b(trace|debug|info|warn|error)!\s*[(\[{]", s.code):
        in_test = s.around(m.start()) in tests
        yield Logging("telemetry", "tracing", m[1], in_test, s.line(m.start()))
        if m[1] == "error":
            yield Logging("error", "error!", "error", in_test, s.line(m.start()))


def _ts_logging(s: Skeleton) -> Iterator[Logging]:
    tests = [(m.end() - 1, s.close.get(m.end() - 1, len(s.code))) for m in re.finditer(r"\b(?:describe|it|test)\s*\(", s.code)]
    inside = lambda at: any(a < at < b for a, b in tests)
    for m in re.finditer(r"\b(console|logger|Logger|winston)\s*\.\s*(\w+)\s*\(", s.code):
        if m[2] in LEVELS:
            yield Logging("telemetry", m[1].lower(), LEVELS[m[2]], inside(m.start()), s.line(m.start()))
    for m in re.finditer(r"\bcatch\s*[({]|\.\s*catch\s*\(", s.code):
        yield Logging("error", "catch", "error", inside(m.start()), s.line(m.start()))


def _py_logging(tree: ast.AST, _: str = "") -> Iterator[Logging]:
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    while todo:
        node, in_test = todo.pop()
        in_test = in_test or getattr(node, "name", None) is not None and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node.name.startswith("test_")
        todo.extend((c, in_test) for c in ast.iter_child_nodes(node))
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("logging", "logger", "log") and f.attr in LEVELS:
                yield Logging("telemetry", "logging" if f.value.id == "logging" else "logger", LEVELS[f.attr], in_test, node.lineno)
            elif isinstance(f, ast.Name) and f.id == "print":
                yield Logging("telemetry", "print", "info", in_test, node.lineno)
        elif isinstance(node, ast.ExceptHandler):
            yield Logging("error", "except", "error", in_test, node.lineno)


def _rust_entries(s: Skeleton, _: str) -> Iterator[Entry]:
    handlers = {r.handler for r in _rust_routes(s)}
    for name, at, _, _ in s.functions:
        marks = [re.sub(r"\s", "", a) for a in s.attributes(at)]
        before = s.code[max(0, at - 80) : at].rpartition("\n")[2]
        kind = (
            "TEST" if any(re.match(r"#\[(\w+::)?test\b", a) for a in marks)
            else "FFI" if "extern" in before or any("no_mangle" in a for a in marks)
            else "MACRO" if any("proc_macro" in a for a in marks)
            else "ENTRYPOINT" if name == "main" or any("::main" in a for a in marks)
            else "HANDLER" if name in handlers
            else "PUBLIC_API" if re.search(r"\bpub\b(?!\s*\()", before)
            else "INTERNAL"
        )
        yield Entry(name, kind, s.line(at))


def _ts_entries(s: Skeleton, path: str) -> Iterator[Entry]:
    handlers = {r.handler for r in _ts_routes(s)}
    stem = path.rsplit("/", 1)[-1].split(".")[0]
    tests = [(m.end() - 1, s.close.get(m.end() - 1, len(s.code))) for m in re.finditer(r"\b(?:describe|it|test)\s*\(", s.code)]
    for name, at, _, _ in s.functions:
        before = s.code[max(0, at - 80) : at].rpartition("\n")[2]
        exported = re.search(r"\bexport\b", before) or re.search(rf"\bexport\s+(?:default\s+{re.escape(name)}\b|\{{[^}}]*\b{re.escape(name)}\b)", s.code)
        kind = "TEST" if any(a < at < b for a, b in tests) else "HANDLER" if name in handlers else "ENTRYPOINT" if name == "main" or (stem in ENTRY_FILES and exported) else "PUBLIC_API" if exported else "INTERNAL"
        yield Entry(name, kind, s.line(at))


def _py_entries(tree: ast.AST, path: str) -> Iterator[Entry]:
    handlers = {r.handler for r in _py_routes(tree)}
    started = {ast.unparse(c.func) for n in tree.body if isinstance(n, ast.If) and "__name__" in ast.unparse(n.test) for c in ast.walk(n) if isinstance(c, ast.Call)}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            marks = " ".join(ast.unparse(d) for d in node.decorator_list)
            kind = "TEST" if node.name.startswith("test_") else "HANDLER" if node.name in handlers else "ENTRYPOINT" if node.name == "main" or node.name in started or re.search(r"\b(command|task)\b", marks) else "INTERNAL" if node.name.startswith("_") else "PUBLIC_API"
            yield Entry(node.name, kind, node.lineno)


def _py_calls(tree: ast.AST) -> Iterator[Call]:
    todo: list[tuple[str | None, ast.AST]] = [(None, tree)]
    while todo:
        owner, node = todo.pop()
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                yield Call(owner, node.func.id, "direct", node.lineno)
            elif isinstance(node.func, ast.Attribute):
                yield Call(owner, node.func.attr, "method", node.lineno)
        inner = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else owner
        todo.extend((inner, c) for c in ast.iter_child_nodes(node))


#: What is read → (its columns, and for each language its reader, which takes the parsed source and the file's path).
_READERS: dict[str, tuple[type, dict[str, Callable]]] = {
    "calls": (Call, {"rust": lambda s, _: _scanned_calls(s), "typescript": lambda s, _: _scanned_calls(s), "python": lambda t, _: _py_calls(t)}),
    "routes": (Route, {"rust": lambda s, _: _rust_routes(s), "typescript": lambda s, _: _ts_routes(s), "python": _py_routes}),
    "models": (Model, {"rust": _rust_models, "typescript": _ts_models, "python": _py_models}),
    "logging": (Logging, {"rust": lambda s, _: _rust_logging(s), "typescript": lambda s, _: _ts_logging(s), "python": _py_logging}),
    "entries": (Entry, {"rust": _rust_entries, "typescript": _ts_entries, "python": _py_entries}),
}
_TYPES = {"line": ("int", pa.int32()), "in_test": ("boolean", pa.bool_())}
#: A language's sources by what stands in them, for texts whose language isn't known.
_SIGNS = {"rust": re.compile(r"\bfn\s+\w+\s*[(<]|#\[derive"), "python": re.compile(r"^\s*(?:async\s+)?(?:def|class)\s+\w+.*:\s*$", re.M), "typescript": re.compile(r"\bfunction\b|=>|\b(?:const|let|interface)\s+\w+")}


def language_of(text: str) -> str | None:
    """rust, python or typescript by the text's own signs; null for none."""
    return next((name for name, sign in _SIGNS.items() if sign.search(text)), None)


def read(what: str, text: str, language: str, path: str = "") -> Iterator[tuple]:
    """The rows of one source: what is calls, routes, models, logging or entries."""
    parsed = ast.parse(text) if language == "python" else Skeleton(text, language)
    return _READERS[what][1][language](parsed, path)


def code_facts(sources: DataFrame, key: str, text: str, what: str, language: str | None = None, path: str | None = None) -> DataFrame:
    """key, language and the columns of what is read (calls, routes, models, logging or entries) from each source.

    language None takes each text's own, by its signs; texts of none give no rows. path names the column of the file's path, by which
    some models and entry points are known.
    """
    shape = _READERS[what][0]
    kinds = [_TYPES.get(n, ("string", pa.string())) for n in shape._fields]
    schema = ", ".join(["language string", *(f"{n} {k}" for n, (k, _) in zip(shape._fields, kinds))])
    # the path goes before the text, parted by a character that no path has
    placed = sources.select(key, F.concat(F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit(""), F.lit("\0"), F.col(text)).alias("__text"))

    def parse(value: str) -> Iterator[tuple]:
        where, _, source = value.partition("\0")
        own = language or language_of(source)
        if own:
            yield from ((own, *row) for row in read(what, source, own, where))

    return table_of(placed, key, "__text", parse, schema, [pa.string(), *(t for _, t in kinds)])
