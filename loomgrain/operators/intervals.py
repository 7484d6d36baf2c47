"""Continuous periods and gaps of overlapping intervals (problem 4).

Starts and ends are ranked independently for each entity. Where the start of rank k + 1 is later than
the end of rank k, exactly k intervals began and ended before: a gap. No interval is compared with another.
Ranks are made in two levels, within slices of time and over the slices' counts, so that an entity with
any share of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of a slice of time.
SLICE_US = 3_600_000_000


def ranked(points: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """entity, kind, t, first_rank, last_rank: each kind's points of an entity ranked from 1 by t; equal points are one row.

    points: entity, kind, t. They are moved once, by slice; the counts of the slices, which are as many as an
    entity has hours, give what comes before each slice.
    """
    slice_key = ["entity", "kind", "slice"]
    sliced = points.withColumn("slice", F.floor(F.col("t") / F.lit(slice_us))).repartition(*map(F.col, slice_key))
    each = sliced.groupBy(*slice_key, "t").agg(F.count("*").alias("n"))
    per_slice = each.groupBy(*slice_key).agg(F.sum("n").alias("in_slice"))
    earlier = F.sum("in_slice").over(W.partitionBy("entity", "kind").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    before = per_slice.select(*slice_key, F.coalesce(earlier, F.lit(0)).alias("earlier"))
    within = each.withColumn("upto", F.sum("n").over(W.partitionBy(*slice_key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    last = F.col("earlier") + F.col("upto")
    return within.join(before, slice_key).select("entity", "kind", "t", (last - F.col("n") + 1).alias("first_rank"), last.alias("last_rank"))


def intervals(df: DataFrame, entity: str, start_us: Column, end_us: Column) -> DataFrame:
    """entity, s and e (microseconds) of the rows that are intervals: nothing null, and the end after the start."""
    return df.select(F.col(entity).alias("entity"), start_us.alias("s"), end_us.alias("e")).filter("entity is not null and s is not null and e is not null and e > s")


def _points(first: str, second: str) -> Column:
    point = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.col(t).alias("t"))
    return F.explode(F.array(point("start", first), point("end", second)))


def gaps(spans: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """entity, gap_start_us, gap_end_us of all gaps between neighbouring periods of an entity.

    spans: as by intervals(). Touching and equal intervals leave no gap; an entity of one period has none.
    """
    points = ranked(spans.select("entity", _points("s", "e").alias("p")).select("entity", "p.*"), slice_us)
    # of equal points only the first one of starts and the last one of ends can bound a gap
    pair = F.when(F.col("kind") == "start", F.col("first_rank") - 1).otherwise(F.col("last_rank"))
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("t")))
    paired = points.groupBy("entity", pair.alias("pair")).agg(side("end").alias("gap_start_us"), side("start").alias("gap_end_us"))
    return paired.filter("gap_end_us > gap_start_us").select("entity", "gap_start_us", "gap_end_us")


def periods(spans: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """entity, period_start_us, period_end_us of all continuous periods.

    Period starts are each entity's first start and the ends of its gaps, period ends its last end and
    the starts of its gaps; both are ranked independently again and paired by rank.
    """
    holes = gaps(spans, slice_us)
    outer = spans.groupBy("entity").agg(F.min("s").alias("first"), F.max("e").alias("final"))
    # a gap's start ends a period and its end starts one
    bounds = outer.select("entity", _points("first", "final").alias("p")).unionAll(holes.select("entity", _points("gap_end_us", "gap_start_us").alias("p")))
    placed = ranked(bounds.select("entity", "p.*"), slice_us)
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("t")))
    return placed.groupBy("entity", "last_rank").agg(side("start").alias("period_start_us"), side("end").alias("period_end_us")).drop("last_rank")
