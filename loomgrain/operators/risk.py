"""Risk: providers and their registry, confidence, anomalies, module groups, configuration differences."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A provider takes the context's tables and gives key, reason, weight.
Provider = Callable[[Mapping[str, DataFrame]], DataFrame]


class Registry:
    """Named providers, run in the order in which they were added."""

    def __init__(self) -> None:
        self.providers: dict[str, Provider] = {}

    def add(self, name: str, provider: Provider) -> "Registry":
        if name in self.providers:
            raise ValueError(f"provider {name} is there already")
        self.providers[name] = provider
        return self

    def run(self, context: Mapping[str, DataFrame]) -> tuple[DataFrame, list[str]]:
        """key, provider, reason, weight of all providers, and a warning for each that failed to make its plan."""
        out, warnings = None, []
        for name, provider in self.providers.items():
            try:
                part = provider(context).select("key", F.lit(name).alias("provider"), "reason", F.col("weight").cast("double").alias("weight"))
            except Exception as e:  # noqa: BLE001  a provider that fails must not stop the others
                warnings.append(f"{name}: {e}")
                continue
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no provider gave a plan: " + "; ".join(warnings))
        return out, warnings


def levels(reasons: DataFrame, high: float = 50, medium: float = 20) -> DataFrame:
    """key, weight, reasons, level: the summed weights above high, above medium, or below."""
    sums = reasons.groupBy("key").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("reasons"))
    return sums.withColumn("level", F.when(F.col("weight") > high, "high").when(F.col("weight") > medium, "medium").otherwise("low"))


def extension_weight(path: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    """Weight of a path's extension."""
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(default))


def dead_code(symbols: DataFrame, suffixes: tuple[str, ...], derived: tuple[str, ...], weights: tuple[float, float, float] = (1, 1, 1), suffix_penalty: float = 0.2, derive_penalty: float = 0.5, threshold: float = 0.75) -> DataFrame:
    """symbol_id, confidence of the symbols that look dead.

    symbols: symbol_id, name, derives (comma-separated), unreachable, inactive, untested (each 0 to 1). The
    weighted mean of the three is lowered for names and derives that are used without a call, never below 0.
    """
    total = sum(weights)
    mean = (F.col("unreachable") * weights[0] + F.col("inactive") * weights[1] + F.col("untested") * weights[2]) / total
    by_name = F.when(F.greatest(*(F.endswith(F.col("name"), F.lit(s)) for s in (*suffixes, suffixes[0]))), suffix_penalty).otherwise(0.0)
    by_derive = F.when(F.arrays_overlap(F.split(F.coalesce("derives", F.lit("")), ","), F.array(*map(F.lit, derived))), derive_penalty).otherwise(0.0)
    confidence = F.round(F.greatest(mean - by_name - by_derive, F.lit(0.0)), 6)
    return symbols.select("symbol_id", confidence.alias("confidence")).filter(F.col("confidence") >= threshold)


def elevation(signals: DataFrame, key: str, severity: str) -> DataFrame:
    """key, state: HIGH with a critical signal, ELEVATED with more than three warnings, else NORMAL."""
    state = F.when(F.bool_or(F.col(severity) == "critical"), "HIGH").when(F.count_if(F.col(severity) == "warning") > 3, "ELEVATED").otherwise("NORMAL")
    return signals.groupBy(key).agg(state.alias("state"))


def change_set_risk(changes: DataFrame, key: str, path: str, sensitive: Column, many: int = 10, very_many: int = 30) -> DataFrame:
    """key, files, sensitive, level of a set of changed paths."""
    sums = changes.groupBy(key).agg(F.count_distinct(path).alias("files"), F.coalesce(F.bool_or(sensitive), F.lit(False)).alias("sensitive"))
    return sums.withColumn("level", F.when(F.col("sensitive") | (F.col("files") >= very_many), "high").when(F.col("files") >= many, "medium").otherwise("low"))


def log_anomalies(lines: DataFrame, doc: str, at: str, line: str, pattern: str, context: int = 2) -> DataFrame:
    """label, n, severity, excerpt: lines that fit a pattern by their first 80 characters, with the lines around the first.

    The lines around a match come from a window over one document's lines.
    """
    w = W.partitionBy(doc).orderBy(at).rowsBetween(-context, context)
    around = lines.withColumn("around", F.array_join(F.collect_list(line).over(w), "\n")).filter(F.rlike(line, F.lit(pattern)))
    groups = around.groupBy(F.substring(F.col(line), F.lit(1), F.lit(80)).alias("label")).agg(F.count("*").alias("n"), F.min_by("around", F.struct(doc, at)).alias("excerpt"))
    return groups.withColumn("severity", F.when(F.col("n") > 10, "critical").when(F.col("n") > 3, "warning").otherwise("normal"))


def module_groups(files: DataFrame, path: str) -> DataFrame:
    """folder, file, files: a row for each distinct path with its folder and how many rows the folder has; no list of unbounded length is made."""
    placed = files.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.col(path).alias("file")).filter("file is not null")
    sizes = placed.groupBy("folder").agg(F.count("*").alias("files"))
    return placed.distinct().join(sizes, "folder")


def config_diff(declared: DataFrame, referenced: DataFrame, name: str) -> DataFrame:
    """name, state: declared and used, unused, or undeclared."""
    a, b = declared.select(name).distinct().withColumn("in_a", F.lit(1)), referenced.select(name).distinct().withColumn("in_b", F.lit(1))
    return a.join(b, name, "full").select(name, F.when(F.col("in_a").isNull(), "undeclared").when(F.col("in_b").isNull(), "unused").otherwise("used").alias("state"))
