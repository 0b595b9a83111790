"""Joins and windows over half-open intervals (group, start, end).

Overlaps are equi-joins on bins: an interval enters every bin that it touches, a pair meets in each
bin that both touch and is kept in the first of them, so nothing is deduplicated by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys, null ones too; right's other columns come along."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, on, "left").drop(*[f"__r_{k}" for k in keys])


def _earlier(by: list[str], order: str = "__bin") -> Window:
    """Over the bins of a group, one row each: all before."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def merged(df: DataFrame, by: list[str], start: str = "st", end: str = "en", touching: bool = True, width: int | None = None) -> DataFrame:
    """Islands: one row for each run of overlapping (and, if asked, touching) intervals, with the number of its members.

    width: rows are put in order within bins of the start, and bins are stitched by one row each, so no group is one
    task, however large. Without it a group is; then groups must be small.
    """
    order = Window.partitionBy(*by).orderBy(start, end)
    if width is None:
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.col(start) > reach if touching else F.col(start) >= reach
        flagged = df.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0))
        numbered = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return numbered.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("__island")
    binned = df.withColumn("__bin", F.floor(F.col(start) / width))
    far = binned.groupBy(*by, "__bin").agg(F.max(end).alias("__top")).withColumn("__far", F.max("__top").over(_earlier(by))).drop("__top")
    inside = Window.partitionBy(*by, "__bin").orderBy(start, end)
    own = _same(binned, far, [*by, "__bin"])
    reach = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    apart = F.col(start) > F.col("__reach") if touching else F.col(start) >= F.col("__reach")
    flagged = own.withColumn("__reach", reach).withColumn("__new", F.when(F.col("__reach").isNull() | apart, 1).otherwise(0))
    numbered = flagged.withColumn("__nth", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = numbered.groupBy(*by, "__bin", "__nth").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))
    # the first rows of a bin can belong to the last island of a bin before it
    last = parts.groupBy(*by, "__bin").agg(F.max("__nth").alias("__n"))
    last = last.withColumn("__open", F.last(F.when(F.col("__n") > 0, F.struct("__bin", "__n")), ignorenulls=True).over(_earlier(by))).drop("__n")
    named = _same(parts, last, [*by, "__bin"]).withColumn("__island", F.when(F.col("__nth") > 0, F.struct(F.col("__bin"), F.col("__nth").alias("__n"))).otherwise(F.col("__open")))
    return named.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("members").alias("members")).drop("__island")


def union_length(df: DataFrame, by: list[str], start: str = "st", end: str = "en", width: int | None = None) -> DataFrame:
    return merged(df, by, start, end, width=width).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("islands"))


def depth(df: DataFrame, by: list[str], start: str = "st", end: str = "en", width: int | None = None) -> DataFrame:
    """Maximal stretches of equal depth: (by, st, en, depth), depth 0 left out. width: as in merged."""
    ends = df.select(*by, F.col(start).alias("pos"), F.lit(1).alias("d")).unionByName(df.select(*by, F.col(end).alias("pos"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*by, "pos").agg(F.sum("d").alias("d"))
    if width is None:
        order = Window.partitionBy(*by).orderBy("pos")
        swept = steps.select(*by, F.col("pos").alias("st"), F.lead("pos").over(order).alias("en"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("depth"))
    else:
        binned = steps.withColumn("__bin", F.floor(F.col("pos") / width))
        every = Window.partitionBy(*by).orderBy("__bin")
        bins = binned.groupBy(*by, "__bin").agg(F.sum("d").alias("__d"), F.min("pos").alias("__first"))
        bins = bins.withColumn("__base", F.coalesce(F.sum("__d").over(_earlier(by)), F.lit(0))).withColumn("__next", F.lead("__first").over(every)).drop("__d", "__first")
        inside = Window.partitionBy(*by, "__bin").orderBy("pos")
        own = _same(binned, bins, [*by, "__bin"])
        swept = own.select(*by, F.col("pos").alias("st"), F.coalesce(F.lead("pos").over(inside), F.col("__next")).alias("en"), (F.col("__base") + F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("depth"))
    return swept.where("en is not null and depth > 0")


def _binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    first, last = F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width)
    return df.withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], width: int, start: str = "st", end: str = "en", how: str = "inner") -> DataFrame:
    """Pairs of rows whose intervals overlap; b's columns are prefixed with b_. how: inner, left_semi or left_anti."""
    left = _binned(a, F.col(start), F.col(end), width)
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    right = _binned(right.withColumnRenamed("__bin", "__x") if "__bin" in right.columns else right, F.col(f"b_{start}"), F.col(f"b_{end}"), width).withColumnRenamed("__first", "__b_first").withColumnRenamed("__bin", "__b_bin")
    on = F.col("__bin") == F.col("__b_bin")
    for c in by:
        on = on & (F.col(c) == F.col(f"b_{c}"))
    on = on & (F.col(start) < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(end))
    if how == "inner":
        met = left.join(right, on & (F.col("__bin") == F.greatest("__first", "__b_first")))
        return met.select(*a.columns, *[f"b_{c}" for c in b.columns])
    own = a.withColumn("__row", F.struct(*a.columns))
    hit = _binned(own, F.col(start), F.col(end), width).join(right, on, "left_semi").select("__row").distinct()
    return own.join(hit, "__row", how).select(*a.columns)


def previous(points: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, value: str, width: int | None = None) -> DataFrame:
    """As-of: for each point the value of the last event of its group at or before it, null if none. One union and windows; width: as in merged."""
    both = points.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__p"), F.lit(None).alias("__v"))
    own = events.select(*by, F.col(event_at).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).alias("__p"), F.col(value).alias("__v"))
    every = both.unionByName(own)
    if width is None:
        w = Window.partitionBy(*by).orderBy("__at", "__kind", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = every.withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    else:
        binned = every.withColumn("__bin", F.floor(F.col("__at") / width))
        last = binned.groupBy(*by, "__bin").agg(F.max_by("__v", F.when(F.col("__kind") == 0, F.struct("__at", "__v"))).alias("__last"))
        last = last.withColumn("__before", F.last("__last", ignorenulls=True).over(_earlier(by))).drop("__last")
        w = Window.partitionBy(*by, "__bin").orderBy("__at", "__kind", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = _same(binned, last, [*by, "__bin"]).withColumn("__v", F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__before")))
    return found.where("__kind = 1").select("__p.*", F.col("__v").alias(value))


def delta_encoded(ids: DataFrame, by: list[str], key: str, width: int) -> DataFrame:
    """ids with delta: the difference to the id before in its group, the first one's own. Bins of width ids are put in order alone."""
    binned = ids.withColumn("__bin", F.floor(F.col(key) / width))
    last = binned.groupBy(*by, "__bin").agg(F.max(key).alias("__top")).withColumn("__before", F.coalesce(F.max("__top").over(_earlier(by)), F.lit(0))).drop("__top")
    inside = Window.partitionBy(*by, "__bin").orderBy(key)
    return _same(binned, last, [*by, "__bin"]).withColumn("delta", F.col(key) - F.coalesce(F.lag(key).over(inside), F.col("__before"))).drop("__bin", "__before")


def delta_decoded(deltas: DataFrame, by: list[str], ordinal: str, width: int, key: str) -> DataFrame:
    """The ids again: running sums of deltas in the order of `ordinal`, by bins of width ordinals."""
    binned = deltas.withColumn("__bin", F.floor(F.col(ordinal) / width))
    base = binned.groupBy(*by, "__bin").agg(F.sum("delta").alias("__d")).withColumn("__base", F.coalesce(F.sum("__d").over(_earlier(by)), F.lit(0))).drop("__d")
    inside = Window.partitionBy(*by, "__bin").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _same(binned, base, [*by, "__bin"]).withColumn(key, F.col("__base") + F.sum("delta").over(inside)).drop("__bin", "__base")


def coverage_of_targets(targets: DataFrame, reads: DataFrame, by: list[str], width: int, start: str = "st", end: str = "en") -> DataFrame:
    """For each target: hits, covered bases, hits that cover it whole."""
    pairs = overlap_join(targets, reads, by, width, start, end)
    cut = pairs.withColumn("s", F.greatest(F.col(start), F.col(f"b_{start}"))).withColumn("e", F.least(F.col(end), F.col(f"b_{end}")))
    key = targets.columns
    hits = cut.groupBy(*key).agg(F.count("*").alias("hits"), F.sum(((F.col("s") == F.col(start)) & (F.col("e") == F.col(end))).cast("bigint")).alias("full_hits"))
    covered = union_length(cut.select(*key, F.col("s"), F.col("e")), key, "s", "e").drop("islands")
    return targets.join(hits, key, "left").join(covered, key, "left").fillna(0, ["hits", "full_hits", "covered"])
