"""Change history: decayed frequency, complexity, hotspot ranking, temporal coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.cluster import broadcast_if, cut
from loomgrain.sources.roles import newest_first

#: Default parameters of the public tool's behaviour.
MAX_COMMITS, HALF_LIFE, MAX_FILES, MIN_SHARED, MIN_REVISIONS, COUPLING_THRESHOLD = 500, 100, 50, 3, 5, 0.75


def recent_commits(commits: DataFrame, max_commits: int, since_ts=None, stop_at=None, all_parents: bool = True) -> DataFrame:
    """commit_id, is_merge, ord of the newest commits (ordinal 0 first).

    since_ts: no older commits. stop_at: the commit at which the walk stops, itself excluded; an id
    that doesn't occur stops nothing. all_parents False leaves merges' ordinals but marks them.
    """
    if since_ts is not None:
        commits = commits.filter(F.col("ts") >= since_ts)
    ranked = newest_first(commits, "ts", "commit_id", "ord", max_commits)
    if stop_at is not None:
        stop = ranked.filter(F.col("commit_id") == stop_at).agg(F.min("ord").alias("stop"))
        ranked = ranked.crossJoin(F.broadcast(stop)).filter("stop is null or ord < stop").drop("stop")
    return ranked.select("commit_id", "ts", "is_merge", "ord")


def decay(ordinal: Column, half_life: float) -> Column:
    """Weight of a commit by its ordinal; a half life of 0 gives 1."""
    return F.pow(F.lit(2.0), -ordinal / F.lit(float(half_life))) if half_life else F.lit(1.0)


def decayed_frequency(change_log: DataFrame, commits: DataFrame, max_commits: int = MAX_COMMITS, half_life: float = HALF_LIFE) -> DataFrame:
    """file, frequency, changes: each file's decayed number of changes.

    Every commit takes an ordinal, merges and empty ones included, while merges' files don't count. The
    recent commits are at most max_commits rows and are broadcast; the change log isn't shuffled before
    it is aggregated. A file that occurs twice in a commit counts once; null files don't count.
    """
    recent = broadcast_if(recent_commits(commits, max_commits).filter("not is_merge").select("commit_id", "ord"), max_commits)
    files = change_log.select("commit_id", "file").filter("file is not null").join(recent, "commit_id").distinct()
    return files.groupBy("file").agg(F.sum(decay(F.col("ord"), half_life)).alias("frequency"), F.count("*").alias("changes"))


def file_complexity(symbols: DataFrame) -> DataFrame:
    """file, complexity: the greatest of a file's symbols' complexities; null counts as 0."""
    each = F.greatest(F.coalesce("cognitive", F.lit(0)), F.coalesce("cyclomatic", F.lit(0)))
    return symbols.groupBy("file").agg(F.max(each).alias("complexity"))


def hotspots(frequency: DataFrame, complexity: DataFrame, decimals: int = 6) -> DataFrame:
    """file, frequency, complexity, score, display_score, risk_class.

    Both axes are divided by their global maxima, which are 1 at least, and multiplied. A file without
    symbols has complexity 0. The maxima are one row and are broadcast.
    """
    joined = cut(frequency.join(complexity, "file", "left").select("file", "frequency", F.coalesce("complexity", F.lit(0)).alias("complexity")))
    top = joined.agg(F.greatest(F.max("frequency"), F.lit(1.0)).alias("max_f"), F.greatest(F.max("complexity"), F.lit(1)).alias("max_c"))
    f, c = F.col("frequency") / F.col("max_f"), F.col("complexity") / F.col("max_c")
    kind = F.when((f > 0.5) & (c > 0.5), "critical").when(f > 0.5, "volatile").when(c > 0.5, "complex").otherwise("calm")
    scored = joined.crossJoin(F.broadcast(top)).select("file", "frequency", "complexity", (f * c).alias("score"), kind.alias("risk_class"))
    r = lambda x: F.round(x, decimals)
    return scored.select("file", r(F.col("frequency")).alias("frequency"), "complexity", r(F.col("score")).alias("score"), r(F.log1p(F.col("score") * 1000)).alias("display_score"), "risk_class")


def top(df: DataFrame, by: str, tie: str, limit: int) -> DataFrame:
    """The `limit` rows of the greatest `by`, ties by `tie` ascending: one partial top-k per task."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(limit)


def centrality_boost(scored: DataFrame, centrality: DataFrame) -> DataFrame:
    """score + 0.1 ln(1 + reachable) + 0.3 rank, by each file's maxima of both; files without any stay."""
    best = centrality.groupBy("file").agg(F.max("reachable").alias("reachable"), F.max("rank").alias("rank"))
    boost = 0.1 * F.log1p(F.coalesce("reachable", F.lit(0))) + 0.3 * F.coalesce("rank", F.lit(0.0))
    return scored.join(best, "file", "left").withColumn("boosted", F.round(F.col("score") + boost, 6))


def eligible_files(change_log: DataFrame, recent: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """commit_id, file, ord of the commits that count for coupling: no merges, 2 to max_files distinct files.

    The ordinal runs over these commits only, which differs from decayed_frequency(). The files of the recent commits are
    read from the change log once and cut off from their lineage.
    """
    files = change_log.select("commit_id", "file").filter("file is not null").join(recent.filter("not is_merge").select("commit_id", F.col("ord").alias("walk")), "commit_id").distinct()
    files = cut(files)
    sizes = files.groupBy("commit_id", "walk").agg(F.count("*").alias("n")).filter(F.col("n").between(1, max_files))
    ranked = sizes.withColumn("ord", F.row_number().over(W.orderBy("walk")) - 1)
    return cut(files.join(ranked.select("commit_id", "ord"), "commit_id").select("commit_id", "file", "ord"))


def revisions(files: DataFrame, half_life: float, min_revisions: int = MIN_REVISIONS) -> DataFrame:
    """file, n, weight of the files with at least min_revisions commits."""
    return files.groupBy("file").agg(F.count("*").alias("n"), F.sum(decay(F.col("ord"), half_life)).alias("weight")).filter(F.col("n") >= min_revisions)


def temporal_coupling(files: DataFrame, half_life: float = HALF_LIFE, min_shared: int = MIN_SHARED, min_revisions: int = MIN_REVISIONS, threshold: float = COUPLING_THRESHOLD) -> DataFrame:
    """file_a, file_b, shared, score: how far file_a changes together with file_b.

    score = decayed weight of the shared commits / decayed weight of file_a's commits; a pair comes out in
    each direction whose score is over the threshold. Pairs come from an equality join on the commit,
    whose groups are at most max_files long, so no group's pairs grow with the data; a pair's commits are
    aggregated on the map side first.
    """
    known = revisions(files, half_life, min_revisions)
    kept = files.join(known.select("file"), "file", "left_semi")
    a, b = kept.select("commit_id", F.col("file").alias("first"), "ord"), kept.select("commit_id", F.col("file").alias("second"))
    pairs = a.join(b, "commit_id").filter("first < second").groupBy("first", "second").agg(F.count("*").alias("shared"), F.sum(decay(F.col("ord"), half_life)).alias("together")).filter(F.col("shared") >= min_shared)
    ways = F.array(F.struct(F.col("first").alias("file_a"), F.col("second").alias("file_b")), F.struct(F.col("second").alias("file_a"), F.col("first").alias("file_b")))
    directed = pairs.select(F.explode(ways).alias("w"), "shared", "together").select("w.*", "shared", "together")
    scored = directed.join(known.select(F.col("file").alias("file_a"), "weight"), "file_a")
    return scored.select("file_a", "file_b", "shared", F.round(F.col("together") / F.col("weight"), 6).alias("score")).filter(F.col("score") > threshold)


def couplings_of(coupling: DataFrame, changed: DataFrame, limit: int = 50) -> DataFrame:
    """The strongest couplings with a changed file on either side."""
    a = coupling.join(changed.select(F.col("file").alias("file_a")), "file_a", "left_semi")
    b = coupling.join(changed.select(F.col("file").alias("file_b")), "file_b", "left_semi")
    both = a.unionByName(b).distinct()
    return both.orderBy(F.desc("score"), "file_a", "file_b").limit(limit)


def last_change(change_log: DataFrame, commits: DataFrame) -> DataFrame:
    """file, last_ts, last_author: of equal times the least commit id counts."""
    rows = change_log.select("commit_id", "file").filter("file is not null").join(commits.select("commit_id", "ts", "author"), "commit_id")
    newest = F.max(F.struct(F.col("ts"), -F.col("commit_id"), F.col("author")))
    return rows.groupBy("file").agg(newest.alias("x")).select("file", F.col("x.ts").alias("last_ts"), F.col("x.author").alias("last_author"))


def latest_snapshot(trends: DataFrame, ts: str = "recorded_at") -> DataFrame:
    """Rows of the newest time only, by a scalar subquery that is one broadcast row."""
    newest = trends.agg(F.max(ts).alias("__newest"))
    return trends.join(F.broadcast(newest), F.col(ts) == F.col("__newest")).drop("__newest")


def changed_snapshots(trends: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """ts and fingerprint of the snapshots that differ from the one before.

    A snapshot's fingerprint is an order-free sum over its rows, made without collecting them.
    """
    prints = trends.groupBy(ts).agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, value).cast("decimal(38,0)")).alias("fingerprint"))
    before = F.lag("fingerprint").over(W.orderBy(ts))
    return prints.withColumn("before", before).filter("before is null or before <> fingerprint").select(ts, "n")


def day_buckets(df: DataFrame, ts: str, as_of: str, days: int, value: Column, name: str) -> DataFrame:
    """day and the sum of a value for each of the last `days` days up to as_of, days without rows included."""
    spark = df.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(as_of)), days - 1), F.to_date(F.lit(as_of)))).alias("day"))
    sums = df.groupBy(F.to_date(ts).alias("day")).agg(F.sum(value).alias(name))
    return F.broadcast(calendar).join(sums, "day", "left").select("day", F.coalesce(name, F.lit(0)).alias(name))
