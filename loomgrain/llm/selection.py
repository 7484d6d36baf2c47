"""Exact percentiles of very large columns by distributed multi-select (problem 3).

The values of each group and day are kept as sorted runs, one for each block of rows of a partition. Selection
goes over the runs in rounds: every run of a range proposes the medians of itself, of its halves and of their halves, the weighted
medians of the proposals become the range's pivots, the values below, at and above each pivot are counted, the
parts that hold no wanted rank are discarded, and the others are the ranges of the next round, until every rank
is found. All groups of any size go through the rounds. The runs of the days are all that the percentiles over
all days are made from, and the days' own percentiles are the first pivots there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgrain.cluster import cut

#: Rows sorted at once inside a partition, and so the greatest length of a run.
BLOCK_ROWS = 1_000_000
#: Ranges of at most 150 bytes each that are broadcast to the runs (15 MB); more are joined by a shuffle.
BROADCAST_RANGES = 100_000
#: Tasks over which the runs of one range are dealt where they are shuffled.
SHARES = 32
#: Places of a run's proposals, in eighths of its length: its median, those of its halves and of their halves.
PROPOSED = (4, 2, 6, 1, 3, 5, 7)
#: Shares of the days' weight at which a percentile over all days gets its first pivots.
NEAR = (0.02, 0.2, 0.4, 0.5, 0.6, 0.8, 0.98)
#: Pivots that a range may have; the parts of range t are numbered from t * PARTS.
PARTS = 256


def _codes(column: pa.Array) -> np.ndarray:
    codes = column.dictionary_encode(null_encoding="encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return codes.indices.to_numpy(zero_copy_only=False)


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def sorted_runs(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, task and run: sorted array<bigint> of at most BLOCK_ROWS values, made where the rows are; nothing is moved.

    Rows of null value are left out, null keys are groups of their own. A group has as many runs as blocks of
    rows that it occurs in, so a hot group is spread as its rows are.
    """
    rows = df.select(*keys, F.col(value).cast("bigint").alias("__v")).filter("__v is not null")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def block(whole: pa.Table) -> pa.RecordBatch:
        whole = whole.take(pc.sort_indices(whole, sort_keys=[(c, "ascending") for c in [*keys, "__v"]])).combine_chunks()
        n = whole.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            codes = _codes(_one(whole.column(k)))
            new[1:] |= codes[1:] != codes[:-1]
        begins = np.flatnonzero(new)
        offsets = pa.array(np.append(begins, n).astype(np.int32))
        heads = [_one(_one(whole.column(k)).take(pa.array(begins))) for k in keys]
        task = pa.array(np.full(len(begins), TaskContext.get().partitionId() if TaskContext.get() else 0, np.int32))
        return pa.RecordBatch.from_arrays([*heads, task, pa.ListArray.from_arrays(offsets, _one(whole.column("__v")))], names=[*keys, "task", "run"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while size + batch.num_rows >= BLOCK_ROWS:
                held.append(batch.slice(0, BLOCK_ROWS - size))
                batch = batch.slice(BLOCK_ROWS - size)
                yield block(pa.Table.from_batches(held))
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(local, f"{fields}task int, run array<bigint>")


def _attach(runs: DataFrame, ranges: DataFrame, n_ranges: int, on: Sequence[str]) -> DataFrame:
    """runs (with task) joined with their ranges; beyond BROADCAST_RANGES the runs of a range are dealt over SHARES tasks."""
    right = ranges.select(*(F.col(k).alias(f"__{k}") for k in on), *[c for c in ranges.columns if c not in on])
    same = F.lit(True)
    for k in on:
        same = same & runs[k].eqNullSafe(F.col(f"__{k}"))
    if n_ranges <= BROADCAST_RANGES:
        right = F.broadcast(right)
    else:
        right = right.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        same = same & (F.pmod(runs["task"], F.lit(SHARES)) == F.col("__share"))
    return runs.join(right, same).drop("__share", *(f"__{k}" for k in on))


def _bisect(flat: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each wanted value its place in flat[low:high], all searched at once."""
    low, high = low.copy(), high.copy()
    while (going := np.flatnonzero(low < high)).size:
        middle = (low[going] + high[going]) >> 1
        over = flat[middle] <= wanted[going] if right else flat[middle] < wanted[going]
        low[going[over]] = middle[over] + 1
        high[going[~over]] = middle[~over]
    return low


def count_three_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tid, run, pivots → part, task, at, run: each run's values between neighbouring pivots, and how many equal the pivot above.

    Part k of range t, numbered t * PARTS + k, lies below pivot k and above pivot k - 1. Runs of the same range that
    come together are one run.
    """
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, pivots = batch.column(1), batch.column(2)
        tids, first, which = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        of = np.repeat(which, np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((flat, of))
        flat = flat[order]
        ends = np.cumsum(np.bincount(of, minlength=len(tids)))
        begins = np.append(0, ends[:-1])
        # the pivots of each range, once
        n_pivots = np.diff(pivots.offsets.to_numpy())[first]
        wanted = pivots.take(pa.array(first)).flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(tids)), n_pivots)
        left, right = (_bisect(flat, begins[owner], ends[owner], wanted, side) for side in (False, True))
        # part k goes from the place after pivot k - 1 to that of pivot k
        n_parts = n_pivots + 1
        part_first = np.cumsum(n_parts) - n_parts
        part_owner = np.repeat(np.arange(len(tids)), n_parts)
        number = np.arange(len(part_owner)) - part_first[part_owner]
        slot = np.arange(len(owner)) + owner
        part_begin, part_end, at = begins[part_owner], ends[part_owner], np.zeros(len(part_owner), np.int64)
        part_end[slot], part_begin[slot + 1], at[slot] = left, right, right - left
        kept = np.flatnonzero((part_end > part_begin) | (at > 0))
        sizes = (part_end - part_begin)[kept]
        offsets = np.append(0, np.cumsum(sizes))
        inside = np.repeat(part_begin[kept] - offsets[:-1], sizes) + np.arange(offsets[-1])
        part = tids[part_owner[kept]] * PARTS + number[kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(np.full(len(kept), task, np.int32)), pa.array(at[kept]), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[inside]))],
            names=["part", "task", "at", "run"],
        )


def _weighted_medians(proposals: str, weight: str) -> Column:
    """The weighted median of each proposed place: the first value that at least half of the weight doesn't exceed."""

    def median(k: int) -> str:
        ordered = f"array_sort(transform({proposals}, x -> struct(get(x.m, {k}) as v, x.w as w)))"
        step = f"(s, x) -> struct(s.w + x.w as w, if(s.w * 2 < {weight}, x.v, s.v) as v)"
        return f"aggregate({ordered}, struct(0L as w, cast(null as bigint) as v), {step}, s -> s.v)"

    return F.expr(f"if(size({proposals}) = 1, {proposals}[0].m, array({', '.join(map(median, range(len(PROPOSED))))}))")


def _next_ranges(parts: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts that hold wanted ranks, with their pivots, and the values found at pivots.

    Proposals are put together in two steps, by stretches of tasks and then by part, so that no list is long.
    """
    size = F.size("run").cast("bigint")
    proposed = F.when(F.size("run") > 0, F.struct(F.array(*(F.get("run", F.floor(size * k / 8).cast("int")) for k in PROPOSED)).alias("m"), size.alias("w")))
    first = parts.groupBy("part", F.floor(F.col("task") / 64).alias("stretch")).agg(
        F.sum(size).alias("inside"), F.sum("at").alias("at"), F.min(F.get("run", F.lit(0))).alias("least"), F.max(F.get("run", F.size("run") - 1)).alias("most"), F.collect_list(proposed).alias("proposed")
    )
    medians = F.when(F.col("inside") > 0, F.struct(_weighted_medians("proposed", "inside").alias("m"), F.col("inside").alias("w")))
    first = first.select(F.expr(f"part div {PARTS}").alias("tid"), "part", "inside", "at", "least", "most", medians.alias("proposed")).repartition("tid")
    each = first.groupBy("tid", "part").agg(F.sum("inside").alias("inside"), F.sum("at").alias("at"), F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("proposed").alias("proposed"))
    earlier = F.sum(F.col("inside") + F.col("at")).over(W.partitionBy("tid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    placed = state.select("tid", *keys, "n", "targets", "pivots").join(each.withColumn("under", F.coalesce(earlier, F.lit(0))), "tid")
    targets = F.expr("transform(filter(targets, t -> t.skip > under and t.skip <= under + inside), t -> struct(t.p as p, t.skip - under as skip))")
    found = F.expr("transform(filter(targets, t -> t.skip > under + inside and t.skip <= under + inside + at), t -> t.p)")
    kept = placed.select(*keys, "n", "part", "inside", "least", "most", "proposed", targets.alias("targets"), found.alias("found"), F.get("pivots", F.expr(f"cast(part % {PARTS} as int)")).alias("value"))
    kept = kept.filter("size(targets) > 0 or size(found) > 0")
    # the middle of the range is a pivot too: so any range is halved, however its values are spread
    middle = F.expr("least + (most div 2 - least div 2)")
    pivots = F.array_sort(F.array_distinct(F.array_append(_weighted_medians("proposed", "inside"), middle)))
    return kept.select(F.monotonically_increasing_id().alias("tid"), "part", *keys, "n", "targets", "found", "value", F.when(F.size("targets") > 0, pivots).alias("pivots"))


def multi_select(runs: DataFrame, keys: Sequence[str], percents: Sequence[int], pivots: DataFrame | None = None, gather: int | None = None, rounds: list[int] | None = None) -> DataFrame:
    """keys, p, value, n: for each group and percent the value of rank ceil(p n / 100), exactly.

    runs: keys, task and run, as by sorted_runs(), cut off from their lineage. pivots: keys and pivots, a
    sorted array of less than PARTS values with which a group begins; a group without begins with none. gather:
    if given, the runs of each group are moved once, into so many tasks for each million of its values and
    four at least, so that short runs of one group lie together. rounds: a list that gets the number of open ranges of
    each round. Equal values are no problem: all values at a pivot are counted as such. Null keys are groups of
    their own. An empty table gives no rows.
    """
    keys = list(keys)
    sizes = runs.groupBy(*keys).agg(F.sum(F.size("run")).cast("bigint").alias("n"))
    rank = lambda p: F.greatest(F.lit(1).cast("bigint"), F.expr(f"(n * {p} + 99) div 100"))
    state = sizes.select("*", F.array(*(F.struct(F.lit(p).cast("bigint").alias("p"), rank(p).alias("skip")) for p in percents)).alias("targets"))
    none = F.array().cast("array<bigint>")
    if pivots is None:
        state = state.withColumn("pivots", none)
    else:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        state = state.join(pivots.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("pivots").alias("__pivots")), on, "left").withColumn("pivots", F.coalesce("__pivots", none)).drop("__pivots", *(f"__{k}" for k in keys))
    state = cut(state.select(F.monotonically_increasing_id().alias("tid"), *keys, "n", "targets", "pivots").observe(seen := Observation(), F.count("*").alias("n_open")))
    n_open = seen.get["n_open"]
    held = _attach(runs, state.select(*keys, "tid", "pivots", "n"), n_open, keys)
    if gather:
        share = F.pmod(F.col("task"), F.greatest(F.lit(4), F.ceil(F.col("n") * gather / 1_000_000))).cast("int")
        held = held.withColumn("share", share).repartition("tid", "share").sortWithinPartitions("tid")
    answers = [state.limit(0).select(*keys, F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("value"), "n")]
    while n_open:
        if rounds is not None:
            rounds.append(n_open)
        parts = cut(held.select("tid", "run", "pivots").mapInArrow(count_three_ways, "part bigint, task int, at bigint, run array<bigint>"))
        after = cut(_next_ranges(parts, state, keys).observe(seen := Observation(), F.count_if(F.size("targets") > 0).alias("n_open")))
        answers.append(after.filter("size(found) > 0").select(*keys, F.explode("found").alias("p"), "value", "n"))
        state = after.filter("size(targets) > 0")
        n_open = seen.get["n_open"]
        held = _attach(parts, state.select("part", "tid", "pivots"), n_open, ["part"])
    out = answers[0]
    for a in answers[1:]:
        out = out.unionAll(a)
    return out


def percentiles_by_day(df: DataFrame, keys: Sequence[str], day: str, value: str, percents: Sequence[int] = (50, 90, 95, 99), rounds: dict[str, list[int]] | None = None) -> DataFrame:
    """scope ('day' or 'all'), keys, day, p, value, n and rank_error for each group, by day and over all days.

    value is the one of rank ceil(p n / 100) among the n values that aren't null. rank_error is the stated
    bound on the difference from that rank: 0, for the selection is exact. A null key, and a null day, is
    a group of its own; groups of one value have it as every percentile. rounds gets the numbers of open ranges.
    """
    keys = list(keys)
    if len(NEAR) * len(percents) >= PARTS:
        raise ValueError(f"less than {PARTS // len(NEAR)} percents at once")
    rounds = {} if rounds is None else rounds
    runs = cut(sorted_runs(df, [*keys, day], value))
    by_day = cut(multi_select(runs, [*keys, day], percents, gather=1, rounds=rounds.setdefault("day", [])))
    # most of a percentile's mass over all days lies near the middle of the days' own values for it
    near = by_day.groupBy(*keys, "p").agg(F.percentile("value", list(NEAR), F.col("n")).alias("near"))
    near = near.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("near", lambda x: F.floor(x).cast("bigint")))))).alias("pivots"))
    overall = multi_select(runs, keys, percents, pivots=near, rounds=rounds.setdefault("all", []))
    kind = df.schema[day].dataType
    out = [by_day.select(F.lit("day").alias("scope"), *keys, day, "p", "value", "n"), overall.select(F.lit("all").alias("scope"), *keys, F.lit(None).cast(kind).alias(day), "p", "value", "n")]
    return out[0].unionAll(out[1]).withColumn("rank_error", F.lit(0).cast("bigint"))
