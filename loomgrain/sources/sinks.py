"""Writers: reports, evidence bundles, sync batches, appended timings."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines in a folder, one file for each partition."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields are quoted only where they must be, inner quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_rows(df: DataFrame, path: str, day: str) -> None:
    """Rows appended to a parquet table that is partitioned by day."""
    df.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Rollup rows written over the days that they hold; other days stay, so a repeated run changes nothing."""
    df.withColumn("day", F.to_date(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_batch(entries: DataFrame, tombstones: DataFrame, folder: str, cursor: str) -> str:
    """A sync batch named by its clock: parquet of both tables."""
    where = f"{folder.rstrip('/')}/batch={cursor}"
    entries.write.mode("overwrite").parquet(f"{where}/entries")
    tombstones.write.mode("overwrite").parquet(f"{where}/tombstones")
    return where


def evidence_bundle(tables: dict[str, DataFrame], head: dict, path: str, most_rows: int = 1_000_000) -> dict:
    """A zip on the driver: each table as CSV, the chain's head, and a manifest with digests.

    Meant for reports of bounded size: a table of more than most_rows rows is refused, not cut.
    """
    manifest: dict = {"files": {}}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as bundle:

        def put(name: str, content: str) -> None:
            bundle.writestr(name, content)
            manifest["files"][name] = hashlib.sha256(content.encode()).hexdigest()

        for name, df in tables.items():
            if df.limit(most_rows + 1).count() > most_rows:
                raise ValueError(f"{name} has more than {most_rows} rows; write it with write_csv()")
            put(f"{name}.csv", df.toPandas().to_csv(index=False, lineterminator="\r\n"))
        put("chain_head.json", json.dumps(head, sort_keys=True))
        bundle.writestr("manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest | {"path": str(Path(path))}
