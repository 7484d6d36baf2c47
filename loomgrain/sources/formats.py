"""Readers of foreign formats: text in, rows out. Line formats are column expressions; only trees need Python."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # readers of YAML then take JSON only, which is a part of it
    yaml = None


def numbered(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no from 1, line; line ends of all systems."""
    lines = F.split(F.col(text), "\r\n|\r|\n")
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("__at", "line")).select(key, (F.col("__at") + 1).alias("line_no"), "line")


def lcov(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, file, line, hits of the DA records; a record before any SF, or with broken numbers, is left out."""
    rows = numbered(texts, key, text)
    file = F.last(F.when(F.startswith("line", F.lit("SF:")), F.substring("line", 4, 10_000)), ignorenulls=True).over(W.partitionBy(key).orderBy("line_no"))
    numbers = [F.regexp_extract("line", r"^DA:(\d{1,9}),(\d{1,9})", i) for i in (1, 2)]
    return rows.withColumn("file", file).filter((numbers[0] != "") & F.col("file").isNotNull()).select(key, "file", numbers[0].cast("int").alias("line"), numbers[1].cast("int").alias("hits"))


def numstat(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, additions, deletions of NUL-separated numstat output; null numbers for binary files, a rename under its new path."""
    parts = F.split(F.col(text), "\x00")
    items = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p"), F.get(parts, i + 2).alias("renamed")))
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.explode(items).alias("x")).select(key, "x.*")
    number = lambda i: F.regexp_extract("p", r"^(\d{1,9}|-)\t(\d{1,9}|-)\t(.*)$", i)
    value = lambda i: F.when(number(i) != "-", number(i).cast("int"))
    return rows.filter(F.rlike("p", F.lit(r"^(\d{1,9}|-)\t(\d{1,9}|-)\t"))).select(key, F.when(number(3) == "", F.col("renamed")).otherwise(number(3)).alias("path"), value(1).alias("additions"), value(2).alias("deletions"))


def env_declarations(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, has_default of NAME=value lines; values never come out. Comments and empty lines are left out."""
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    name, value = (F.regexp_extract("line", pattern, i) for i in (1, 2))
    return numbered(texts, key, text).filter(name != "").select(key, name.alias("name"), (value != "").alias("has_default")).distinct()


#: How source code of several languages names an environment variable.
ENV_REFERENCE = r"""(?:env::var(?:_os)?\(\s*"|process\.env\.|process\.env\[\s*['"]|os\.environ\[\s*['"]|os\.environ\.get\(\s*['"]|os\.getenv\(\s*['"]|env!\(\s*")([A-Za-z_][A-Za-z0-9_]*)"""


def _all(pattern: str, text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def env_references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, name of the environment variables that source code reads."""
    return texts.select(key, F.explode(_all(ENV_REFERENCE, text)).alias("name"))


def sql_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, table in lower case of SQL inside any text."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+[\"`]?([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)), F.lower)
    return texts.select(key, F.explode(F.array_distinct(names)).alias("table"))


def http_calls(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, url of HTTP client calls with a literal address."""
    return texts.select(key, F.explode(_all(r"""(?i)\b(?:get|post|put|patch|delete|fetch|request)\(\s*f?['"](https?://[^'"\s]+)""", text)).alias("url"))


def dockerfile(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind (image or port), value of a Dockerfile."""
    image, port = _all(r"(?im)^\s*FROM\s+(?:--\S+\s+)?(\S+)", text), _all(r"(?im)^\s*EXPOSE\s+(\d+)", text)
    rows = texts.select(key, F.explode(F.map_from_arrays(F.array(F.lit("image"), F.lit("port")), F.array(image, port))).alias("kind", "values"))
    return rows.select(key, "kind", F.explode("values").alias("value"))


def terraform(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, type, name of the resources."""
    pairs = F.regexp_extract_all(text, F.lit(r'(?m)^\s*resource\s+("[^"]+"\s+"[^"]+")'), F.lit(1))
    rows = texts.select(key, F.explode(pairs).alias("p"))
    return rows.select(key, F.regexp_extract("p", r'^"([^"]+)"', 1).alias("type"), F.regexp_extract("p", r'"([^"]+)"$', 1).alias("name"))


def makefile(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, target, step_no, step: the command lines of each target; variable assignments are no targets."""
    rows = numbered(texts, key, text)
    w = W.partitionBy(key).orderBy("line_no")
    head = F.regexp_extract("line", r"^([A-Za-z0-9_./-]+)\s*:(?!=)", 1)
    placed = rows.withColumn("target", F.last(F.when(head != "", head), ignorenulls=True).over(w)).filter(F.startswith("line", F.lit("\t")) & F.col("target").isNotNull())
    return placed.withColumn("step_no", F.row_number().over(W.partitionBy(key, "target").orderBy("line_no"))).select(key, "target", "step_no", F.trim(F.replace(F.col("line"), F.lit("\t"), F.lit(" "))).alias("step"))


def cedar(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, effect, principal, action, resource, conditional of the policies; a part without a constraint is *."""
    rows = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?s)\b((?:permit|forbid)\s*\(.*?;)"), F.lit(1))).alias("p"))
    part = lambda n: F.regexp_extract("p", rf'(?s)\b{n}\s*(?:==|in|is)\s*\[?\s*([A-Za-z_:]*"[^"]*"|[A-Za-z_:]+)', 1)
    named = [F.when(part(n) == "", "*").otherwise(part(n)).alias(n) for n in ("principal", "action", "resource")]
    return rows.select(key, F.regexp_extract("p", "^(permit|forbid)", 1).alias("effect"), *named, F.rlike("p", F.lit(r"\b(when|unless)\s*\{")).alias("conditional"))


def metric_severity(metrics: DataFrame) -> DataFrame:
    """metrics (signal_type, metric_value) with severity by thresholds: error_rate over 0.1, latency over 1 or 0.5, others over 100 or 50."""
    v, kind = F.col("metric_value"), F.col("signal_type")
    severity = F.when((kind == "error_rate") & (v > 0.1), "critical").when((kind == "latency") & (v > 1.0), "critical").when((kind == "latency") & (v > 0.5), "warning").when(~kind.isin("error_rate", "latency") & (v > 100), "critical").when(~kind.isin("error_rate", "latency") & (v > 50), "warning").otherwise("normal")
    return metrics.withColumn("severity", severity)


def markdown_info(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, title (first heading), summary (first paragraph's first line), links of a Markdown text."""
    title = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    summary = F.regexp_extract(text, r"(?m)^(?![#>\-*|`\s])(.+)$", 1)
    return texts.select(key, F.nullif(title, F.lit("")).alias("title"), F.nullif(summary, F.lit("")).alias("summary"), _all(r"\[[^\]]*\]\(([^)\s]+)\)", text).alias("links"))


def table_of(texts: DataFrame, key: str, text: str, parse: Callable[[str], Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """key and the columns of `schema` from a Python parser, by Arrow batches; a text that can't be parsed gives no rows."""
    kind = texts.schema[key].dataType.simpleString()
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for batch in batches:
            who, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(parse(value)) if value else []
                except (ValueError, SyntaxError, RecursionError, KeyError, TypeError, AttributeError):
                    found = []
                who.extend([i] * len(found))
                rows.extend(found)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[key, *names])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {schema}")


def _tree(text: str):
    if yaml is not None:
        try:
            return list(yaml.safe_load_all(text))
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from None
    return [json.loads(text)]


def openapi(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, method, operation of an OpenAPI or Swagger document."""

    def parse(value):
        methods = {"get", "put", "post", "delete", "options", "head", "patch", "trace"}
        for doc in _tree(value):
            for path, item in (doc.get("paths") or {}).items():
                for method, operation in item.items():
                    if method.lower() in methods:
                        yield path, method.upper(), (operation or {}).get("operationId")

    return table_of(texts, key, text, parse, "path string, method string, operation string", [pa.string()] * 3)


def osv(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, advisory, package, ecosystem, introduced, fixed of an OSV advisory."""

    def parse(value):
        doc = json.loads(value)
        for affected in doc.get("affected") or []:
            package = affected.get("package") or {}
            ranges = affected.get("ranges") or [{}]
            for span in ranges:
                marks = {k: v for e in span.get("events") or [] for k, v in e.items()}
                yield doc.get("id"), package.get("name"), package.get("ecosystem"), marks.get("introduced"), marks.get("fixed")

    return table_of(texts, key, text, parse, "advisory string, package string, ecosystem string, introduced string, fixed string", [pa.string()] * 5)


def ci_jobs(texts: DataFrame, key: str, text: str, system: str) -> DataFrame:
    """key, job, step_no, step of a CI configuration; system: github, gitlab or circleci."""
    reserved = {"stages", "variables", "default", "include", "workflow", "image", "services", "cache", "before_script", "after_script"}

    def steps(job):
        listed = job.get("steps") if system != "gitlab" else job.get("script")
        for step in [listed] if isinstance(listed, str) else listed or []:
            if isinstance(step, str):
                yield step
            elif isinstance(step, dict):
                run = step.get("run") or step.get("uses") or step.get("name")
                yield run.get("command") if isinstance(run, dict) else run

    def parse(value):
        for doc in _tree(value):
            jobs = doc.get("jobs") or {} if system != "gitlab" else {k: v for k, v in doc.items() if k not in reserved and isinstance(v, dict) and not k.startswith(".")}
            for name, job in jobs.items():
                for k, step in enumerate(steps(job)):
                    yield name, k, step

    return table_of(texts, key, text, parse, "job string, step_no int, step string", [pa.string(), pa.int32(), pa.string()])


def openslo(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, name, service of the documents of an OpenSLO file."""

    def parse(value):
        for doc in _tree(value):
            if isinstance(doc, dict) and doc.get("kind"):
                yield doc["kind"], (doc.get("metadata") or {}).get("name"), (doc.get("spec") or {}).get("service")

    return table_of(texts, key, text, parse, "kind string, name string, service string", [pa.string()] * 3)


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)


def complexity(node: ast.AST) -> tuple[int, int]:
    """Cyclomatic and cognitive complexity of a Python function: branches + 1, and branches weighted by their nesting."""
    cyclomatic, cognitive = 1, 0
    stack = [(child, 0) for child in ast.iter_child_nodes(node)]
    while stack:
        item, depth = stack.pop()
        inner = depth
        if isinstance(item, _BRANCHES):
            cyclomatic += 1
            cognitive += 1 + depth
            inner = depth + 1
        elif isinstance(item, ast.BoolOp):
            cyclomatic += len(item.values) - 1
            cognitive += 1
        elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            inner = depth + 1
        stack.extend((child, inner) for child in ast.iter_child_nodes(item))
    return cyclomatic, cognitive


def python_symbols(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, kind, is_public, line_start, line_end, cyclomatic, cognitive, entrypoint of Python sources."""

    def parse(value):
        todo = [("", ast.parse(value))]
        while todo:
            prefix, node = todo.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    name = f"{prefix}.{child.name}" if prefix else child.name
                    marks = [ast.unparse(x) for x in child.decorator_list]
                    entry = "HANDLER" if any(re.search(r"\.(route|get|post|put|patch|delete)\(", m) for m in marks) else "TEST" if child.name.startswith("test_") else "ENTRYPOINT" if name == "main" else None
                    kind = "class" if isinstance(child, ast.ClassDef) else "method" if prefix else "function"
                    measures = (0, 0) if kind == "class" else complexity(child)
                    yield name, kind, not child.name.startswith("_"), child.lineno, child.end_lineno, *measures, entry
                    todo.append((name, child))

    types = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return table_of(texts, key, text, parse, "name string, kind string, is_public boolean, line_start int, line_end int, cyclomatic int, cognitive int, entrypoint string", types)


def python_calls(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, caller, callee, line of the calls in Python sources; caller is null at module level."""

    def parse(value):
        todo: list[tuple[str | None, ast.AST]] = [(None, ast.parse(value))]
        while todo:
            owner, node = todo.pop()
            for child in ast.iter_child_nodes(node):
                if isinstance(child, ast.Call):
                    yield owner, ast.unparse(child.func), child.lineno
                named = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
                todo.append((f"{owner}.{child.name}" if owner else child.name, child) if named else (owner, child))

    return table_of(texts, key, text, parse, "caller string, callee string, line int", [pa.string(), pa.string(), pa.int32()])


def python_imports(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, module, name of the imports of Python sources."""

    def parse(value):
        for node in ast.walk(ast.parse(value)):
            if isinstance(node, ast.Import):
                yield from ((a.name, None) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                yield from (("." * node.level + (node.module or ""), a.name) for a in node.names)

    return table_of(texts, key, text, parse, "module string, name string", [pa.string()] * 2)


#: Declarations of other languages, as far as a regular expression can tell: kind → pattern with the name.
DECLARATIONS: dict[str, dict[str, str]] = {
    "rust": {"function": r"\bfn\s+([A-Za-z_]\w*)", "struct": r"\bstruct\s+([A-Za-z_]\w*)", "enum": r"\benum\s+([A-Za-z_]\w*)", "trait": r"\btrait\s+([A-Za-z_]\w*)", "module": r"\bmod\s+([A-Za-z_]\w*)"},
    "typescript": {"function": r"\bfunction\s+([A-Za-z_$][\w$]*)", "class": r"\bclass\s+([A-Za-z_$][\w$]*)", "interface": r"\binterface\s+([A-Za-z_$][\w$]*)", "type": r"\btype\s+([A-Za-z_$][\w$]*)\s*=", "constant": r"\bconst\s+([A-Za-z_$][\w$]*)\s*="},
}


def declarations(texts: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, kind, name of the declarations that regular expressions find in Rust or TypeScript sources."""
    kinds = DECLARATIONS[language]
    found = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(_all(p, text) for p in kinds.values())))
    return texts.filter(F.col(text).isNotNull()).select(key, F.explode(found).alias("kind", "names")).select(key, "kind", F.explode("names").alias("name"))
