"""Discovery of files, and tables of several places read as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrain.operators.facts import matches_any


def discover(spark: SparkSession, root: str, extensions: Sequence[str], ignored: Sequence[str] = (), most_bytes: int = 1_000_000) -> DataFrame:
    """path (below root), n_bytes, text of the files under a folder.

    Files of other extensions, ignored globs, files over most_bytes and files that hold a NUL byte are left out;
    bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    below = F.regexp_replace("path", r"^.*?" + _literal(root.rstrip("/")) + "/", "")
    kept = files.filter(F.col("length") <= most_bytes).select(below.alias("path"), F.col("length").alias("n_bytes"), "content")
    kept = kept.filter(~matches_any(F.col("path"), ignored) & ~F.rlike(F.hex("content"), F.lit("^(..)*00")))
    return kept.select("path", "n_bytes", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _literal(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in text)


def read_siblings(spark: SparkSession, places: dict[str, str], kind: str = "parquet") -> tuple[DataFrame | None, list[str]]:
    """The tables of several repositories as one, with column `repo`, and a warning for each that can't be read.

    Columns that some of them lack are null there.
    """
    out, warnings = None, []
    for repo, path in places.items():
        try:
            part = spark.read.format(kind).load(path).withColumn("repo", F.lit(repo))
        except Exception as e:  # noqa: BLE001  one sibling must not stop the others
            warnings.append(f"{repo}: {str(e).splitlines()[0][:200]}")
            continue
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, warnings
