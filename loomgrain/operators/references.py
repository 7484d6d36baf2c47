"""References to records that do not exist (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrain.cluster import cut

#: A key is heavy where it has more than this share of all references, so there can't be more than 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 2000


def text_key(column: str) -> Column:
    """A text key without regard to letter case and to white space around it."""
    return F.lower(F.regexp_replace(F.col(column).cast("string"), r"(?U)^\s+|\s+$", ""))


def first_rows(df: DataFrame, id_column: str, loaded: str, values: dict[str, Column]) -> DataFrame:
    """One row for each id: that of the earliest load; of equal loads that of the least values, nulls first.

    A row whose id is null can't be told from another one and is left out.
    """
    row = F.struct(F.col(loaded).isNotNull().alias("__known"), F.col(loaded).alias("__loaded"), *(c.alias(k) for k, c in values.items()))
    kept = df.select(F.col(id_column).alias("__id"), row.alias("__row")).filter("__id is not null")
    return kept.groupBy("__id").agg(F.min("__row").alias("__row")).select("__id", "__row.__loaded", *(f"__row.{k}" for k in values))


def lifetimes(parents: DataFrame, key: Column, loaded: Column, deleted: Column | None = None, deletions: DataFrame | None = None) -> DataFrame:
    """__key, __born (earliest load) and __died of each parent key; deletions has __key and __died itself.

    A deletion of a key that was never loaded has no row. Null keys are left out.
    """
    died = deleted if deleted is not None else F.lit(None).cast("timestamp")
    lives = parents.select(key.alias("__key"), loaded.cast("timestamp").alias("__born"), died.cast("timestamp").alias("__died")).filter("__key is not null")
    if deletions is not None:
        lives = lives.unionAll(deletions.select("__key", F.lit(None).cast("timestamp"), "__died").filter("__key is not null"))
    return lives.groupBy("__key").agg(F.min("__born").alias("__born"), F.min("__died").alias("__died")).filter("__born is not null")


def split_join(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references (__key, __loaded, n and more) for which no live parent exists when they are loaded.

    references must be cut off from their lineage; n says for how many children one stands. They are counted
    for each key first; keys with more than HEAVY_SHARE of all are split off: there are at most 1 / HEAVY_SHARE of
    them, so they and their parents are broadcast and their references aren't moved. All others are joined by a
    shuffle on the key, and both parts are united. A null key is no reference; an empty one is. A parent counts from
    its earliest load until its deletion; a child whose own load time is null is an orphan only if its
    parent never existed.
    """
    references = references.filter("__key is not null")
    by_key = references.groupBy("__key").agg(F.sum("n").alias("n"))
    total = references.agg(F.sum("n").alias("total"))
    heavy = cut(by_key.crossJoin(F.broadcast(total)).filter(F.col("n") > F.col("total") * HEAVY_SHARE).select("__key"))
    is_orphan = F.col("__born").isNull() | (F.col("__born") > F.col("__loaded").cast("timestamp")) | (F.col("__died") <= F.col("__loaded").cast("timestamp"))
    few = parents.join(F.broadcast(heavy), "__key", "left_semi")
    from_heavy = references.join(F.broadcast(heavy), "__key", "left_semi").join(F.broadcast(few), "__key", "left").filter(is_orphan)
    from_rest = references.join(F.broadcast(heavy), "__key", "left_anti").join(parents, "__key", "left").filter(is_orphan)
    return from_heavy.unionByName(from_rest).select(*references.columns)


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children for whose reference no live parent exists when they are loaded, as by split_join().

    children: __id, __key, __period, __loaded; parents: as by lifetimes().
    """
    return split_join(cut(children.withColumn("n", F.lit(1).cast("bigint"))), parents).drop("n")


def orphan_counts(children: DataFrame, parents: DataFrame) -> DataFrame:
    """__key, __period, n: how many children of a key and period have no live parent when they are loaded.

    Children of the same key, period and load time are one counted reference before anything is joined; the counts of heavy and
    of other keys are united.
    """
    counted = cut(children.groupBy("__key", "__period", "__loaded").agg(F.count("*").alias("n")))
    return split_join(counted, parents).groupBy("__key", "__period").agg(F.sum("n").alias("n"))


def ledger_references(ledger: DataFrame, transactions: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger entries as children, and the transactions that they name by tx_id as parents."""
    children = first_rows(ledger, "id", "loaded_at", {"__key": text_key("tx_id"), "__period": F.date_format("committed_at", "yyyy-MM-dd")})
    millis = F.regexp_extract(F.trim("tombstone_hlc"), r"^(\d{1,18})-", 1)
    deletions = tombstones.select(text_key("tx_id").alias("__key"), F.timestamp_millis(F.when(millis != "", millis.cast("bigint"))).alias("__died"))
    return children, lifetimes(transactions, text_key("tx_id"), F.col("loaded_at"), deletions=deletions.filter("__died is not null"))


def mapping_references(mappings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test mappings as children, and the files that they name by tested_file_id as parents."""
    children = first_rows(mappings, "id", "loaded_at", {"__key": F.col("tested_file_id"), "__period": F.date_format("last_indexed_at", "yyyy-MM-dd")})
    return children, lifetimes(files, F.col("id"), F.col("loaded_at"), F.col("deleted_at"))


def ledger_orphans(ledger: DataFrame, transactions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Ledger entries without a live transaction."""
    return orphans(*ledger_references(ledger, transactions, tombstones))


def all_orphans(ledger: DataFrame, transactions: DataFrame, tombstones: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """child_table, period, child_id of every orphan."""
    parts = {"ledger_entries": ledger_references(ledger, transactions, tombstones), "test_mapping": mapping_references(mappings, files)}
    named = [orphans(*both).select(F.lit(name).alias("child_table"), F.col("__period").alias("period"), F.col("__id").cast("bigint").alias("child_id")) for name, both in parts.items()]
    return named[0].unionByName(named[1])


def orphan_report(ledger: DataFrame, transactions: DataFrame, tombstones: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """child_table, period, n_orphans: the sums of the orphan counts; periods without an orphan have no row."""
    parts = {"ledger_entries": ledger_references(ledger, transactions, tombstones), "test_mapping": mapping_references(mappings, files)}
    named = [orphan_counts(*both).groupBy(F.col("__period").alias("period")).agg(F.sum("n").alias("n_orphans")).select(F.lit(name).alias("child_table"), "period", "n_orphans") for name, both in parts.items()]
    return named[0].unionByName(named[1])
