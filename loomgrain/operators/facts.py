"""Facts about files, symbols and changes: path rules, joins of what is known, projections into a graph."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: * within a folder, ** over folders, ? one character; without a slash it fits any base name."""
    if "/" not in glob:
        glob = "**/" + glob
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.sub(r"([.^$+{}()\[\]|\\])", r"\\\1", glob[i])
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    return F.rlike(path, F.lit("|".join(map(glob_pattern, globs)))) if globs else F.lit(False)


def first_rule(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first glob that fits a path."""
    return F.coalesce(*(F.when(F.rlike(path, F.lit(glob_pattern(g))), F.lit(v)) for g, v in rules), F.lit(default))


def json_field(column: str, path: str) -> Column:
    """A field of a JSON text as string; null where the text has none or isn't JSON."""
    return F.get_json_object(column, path)


def tail(lines: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The last n lines of each text."""
    return lines.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).filter(F.col("__k") <= n).drop("__k")


def with_names(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, callee, resolved: edges with their target's name, or its number where it isn't known."""
    named = edges.join(symbols.select(F.col("symbol_id").alias("target"), "name"), "target", "left")
    return named.select("source", F.coalesce("name", F.concat(F.lit("unresolved:"), F.col("target").cast("string"))).alias("callee"), F.col("name").isNotNull().alias("resolved"))


def callers_of(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """The symbols that call any symbol of a name."""
    named = symbols.filter(F.col("name") == name).select(F.col("symbol_id").alias("target"))
    return edges.join(named, "target", "left_semi").select(F.col("source").alias("symbol_id")).distinct().join(symbols, "symbol_id").select("symbol_id", "name")


def callees_of(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """The symbols that any symbol of a name calls."""
    named = symbols.filter(F.col("name") == name).select(F.col("symbol_id").alias("source"))
    return edges.join(named, "source", "left_semi").select(F.col("target").alias("symbol_id")).distinct().join(symbols, "symbol_id").select("symbol_id", "name")


def missing_interfaces(needed: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """key, uses, state: what is needed, how often, and whether a sibling offers it."""
    uses = needed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("uses"))
    known = offered.select(F.col(key)).distinct().withColumn("__known", F.lit(1))
    return uses.join(known, key, "left").select(key, "uses", F.when(F.col("__known").isNull(), "removed").otherwise("available").alias("state"))


def test_names(files: DataFrame) -> DataFrame:
    """test_file_id, tested_file_id by name: a file test_x or x_test covers the files x of the same language."""
    base = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    named = files.select("id", "language", base.alias("base")).filter("base <> ''")
    stripped = F.regexp_replace("base", r"^test_|_test$", "")
    tests = named.filter(F.col("base") != stripped).select(F.col("id").alias("test_file_id"), "language", stripped.alias("base"))
    return tests.join(named.select(F.col("id").alias("tested_file_id"), "language", "base"), ["language", "base"]).select("test_file_id", "tested_file_id")


def ages(files: DataFrame, as_of: str, exempt_days: int = 30) -> DataFrame:
    """id, days since a file's newest sign of life; null for a file changed within exempt_days. Missing times are skipped."""
    end = F.lit(as_of).cast("date")
    changed = F.timestamp_micros(F.floor(F.col("mtime_ns") / 1000))
    newest = F.greatest(changed, F.col("last_indexed_at").cast("timestamp"), F.col("loaded_at").cast("timestamp"))
    exempt = F.coalesce(F.datediff(end, F.to_date(changed)) < exempt_days, F.lit(False))
    return files.select("id", F.when(~exempt, F.datediff(end, F.to_date(newest))).alias("days"))


def service_summary(files: DataFrame, service: str) -> DataFrame:
    """service, files, languages (sorted, joined) and the first path of each service."""
    kinds = F.array_join(F.sort_array(F.collect_set("language")), ",")
    return files.filter(F.col(service).isNotNull()).groupBy(service).agg(F.count("*").alias("files"), kinds.alias("languages"), F.min("file_path").alias("first"))


def config_and_source(changes: DataFrame, key: str, path: str, config: Column) -> DataFrame:
    """key, config, source: whether a set of changes touches pipeline configuration, and whether anything else."""
    return changes.filter(F.col(path).isNotNull()).groupBy(key).agg(F.bool_or(config).alias("config"), F.bool_or(~config).alias("source"))


def file_nodes(files: DataFrame) -> DataFrame:
    """node, category, label of the files that aren't deleted."""
    alive = files.filter("parse_status is null or parse_status <> 'DELETED'")
    return alive.select(F.concat(F.lit("urn:repo:file:"), F.replace(F.col("file_path"), F.lit("\\"), F.lit("/"))).alias("node"), F.lit("file").alias("category"), F.col("file_path").alias("label"))


def test_edges(mappings: DataFrame, files: DataFrame) -> DataFrame:
    """source, target, relation, confidence: which test file validates which file, the surest mapping of each pair."""
    a, b = files.select(F.col("id").alias("test_file_id"), F.col("file_path").alias("source")), files.select(F.col("id").alias("tested_file_id"), F.col("file_path").alias("target"))
    pairs = mappings.filter("tested_file_id is not null").groupBy("test_file_id", "tested_file_id").agg(F.max("confidence").alias("confidence"))
    return pairs.join(a, "test_file_id").join(b, "tested_file_id").select("source", "target", F.lit("validates").alias("relation"), "confidence")


def pattern_counts(texts: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key and how often each pattern occurs in all its texts."""
    return texts.filter(F.col(text).isNotNull()).groupBy(key).agg(*(F.sum(F.regexp_count(text, F.lit(p))).alias(n) for n, p in patterns.items()))
