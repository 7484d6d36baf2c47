"""Ledger and sync: churn, states, logical clocks, last-writer-wins merges, incremental extracts, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def velocity(entries: DataFrame, as_of: str, days: int) -> DataFrame:
    """Entries committed in the last days up to as_of; one row."""
    end = F.lit(as_of).cast("timestamp")
    at = F.col("committed_at").cast("timestamp")
    return entries.filter((at > end - F.make_interval(days=F.lit(days))) & (at <= end)).agg(F.count("*").alias("entries"))


def top_churn(entries: DataFrame, key: str, limit: int) -> DataFrame:
    """The entities of most entries; ties by name."""
    return entries.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def state_counts(rows: DataFrame, key: str, states: Sequence[str], group: str | None = None) -> DataFrame:
    """One column with the number of rows in each of the named states, by group or over all."""
    columns = [F.count_if(F.col(key) == s).alias(s.lower()) for s in states]
    return rows.groupBy(group).agg(*columns) if group else rows.agg(*columns)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's row of the greatest order columns, nulls least; remaining ties by all columns.

    The greatest row is found by an aggregate, which combines on the map side: a hot key is no hot task.
    """
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return rows.groupBy(*keys).agg(newest.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose id begins with a prefix; % and _ in it mean themselves."""
    return rows.filter(F.startswith(F.col(column), F.lit(prefix)))


def of_file(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Rows whose path is the given one or ends with it after a slash."""
    return rows.filter((F.col(column) == path) | F.endswith(F.col(column), F.lit("/" + path)))


def page(rows: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def stale(rows: DataFrame, ts: str, as_of: str, days: int, condition: Column) -> DataFrame:
    """Rows that meet a condition and are older than a number of days."""
    return rows.filter(condition & (F.col(ts).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))))


def clock(column: Column) -> Column:
    """A logical clock `milliseconds-counter-node` as a struct that compares in its order; null if it can't be read."""
    pattern = r"^(\d{1,18})-(\d{1,9})-(.+)$"
    part = lambda i: F.regexp_extract(F.trim(column), pattern, i)
    return F.when(F.rlike(F.trim(column), F.lit(pattern)), F.struct(part(1).cast("bigint").alias("physical"), part(2).cast("int").alias("counter"), part(3).alias("node")))


def observe(clocks: DataFrame, group: str, physical: str, counter: str, order: str) -> DataFrame:
    """The greatest clock seen so far at each row of a group: a running maximum."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return clocks.withColumn("seen", F.max(F.struct(physical, counter)).over(w))


def last_writer(entries: DataFrame, key: str, written: Column, tombstones: DataFrame, deleted: Column) -> DataFrame:
    """Each key's row of the greatest clock, without keys whose tombstone is at or after it.

    Rows and tombstones without a readable clock don't count.
    """
    rest = [c for c in entries.columns if c != key]
    newest = entries.select(key, written.alias("__clock"), *rest).filter("__clock is not null").groupBy(key).agg(F.max(F.struct("__clock", *rest)).alias("__row"))
    graves = tombstones.select(F.col(key).alias("__key"), deleted.alias("__dead")).filter("__dead is not null").groupBy("__key").agg(F.max("__dead").alias("__dead"))
    alive = newest.join(graves, F.col(key) == F.col("__key"), "left").filter(F.col("__dead").isNull() | (F.col("__dead") < F.col("__row.__clock")))
    return alive.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))


def extract_since(entries: DataFrame, tombstones: DataFrame, cursor: str, limit: int) -> DataFrame:
    """kind, key: signed local entries after the cursor, oldest first up to a batch's size, and all tombstones."""
    fresh = entries.filter(F.col("signature").isNotNull() & F.upper("origin").isin("LOCAL", "SIBLING") & (F.col("loaded_at").isNull() | (F.col("loaded_at") > F.lit(cursor).cast("timestamp_ntz"))))
    batch = fresh.orderBy(F.asc_nulls_first("loaded_at"), "id").limit(limit)
    return batch.select(F.lit("entry").alias("kind"), F.col("id").cast("string").alias("key")).unionByName(tombstones.select(F.lit("tombstone").alias("kind"), F.concat_ws("@", "tx_id", "tombstone_hlc").alias("key")))


def entry_hash(*fields: Column, version: int = 2) -> Column:
    """SHA-256 over a version tag and the fields, each with its length, so that no two lists of fields run together."""
    parts = [F.concat(F.octet_length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.sha2(F.concat_ws("|", F.lit(f"v{version}"), *parts), 256)


def upsert_counts(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """key, drift_count, first and last time: what repeated inserts of an open row add up to."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("drift_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """The table after an upsert, with action: kept, unchanged, updated, inserted. Equal fingerprints change nothing."""
    a = stored.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__a"), F.lit(1).alias("__in_a"))
    b = incoming.select(F.col(key).alias("__k"), F.col(fingerprint).alias("__b"), F.lit(1).alias("__in_b"))
    action = F.when(F.col("__in_b").isNull(), "kept").when(F.col("__in_a").isNull(), "inserted").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("updated")
    value = F.when(F.col("__in_b").isNull(), F.col("__a")).otherwise(F.col("__b"))
    return a.join(b, "__k", "full").select(F.col("__k").alias(key), value.alias(fingerprint), action.alias("action"))


def last_meaningful(events: DataFrame, key: str, kind: str, order: Sequence[str], unknown: str) -> DataFrame:
    """Each key's last event; an event of unknown kind never replaces a known one."""
    best = F.max_by(kind, F.struct((F.col(kind) != unknown).alias("known"), *order))
    return events.filter(F.col(key).isNotNull() & F.col(kind).isNotNull()).groupBy(key).agg(best.alias(kind))


def cascade(dependents: dict[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each dependent table without the rows that point to a removed key."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(gone, F.col(column) == F.col("__gone"), "left_anti") for name, (df, column) in dependents.items()}
