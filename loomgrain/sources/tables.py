"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """The table `name` in folder `where`; columns of one letter case, as stored."""
    return spark.read.parquet(f"{where}/{name}.parquet")


def micros(column) -> "F.Column":
    """Microseconds since 1970 of a timestamp with or without zone; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))
