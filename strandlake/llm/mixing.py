"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame expressions only.

1. Each source's words are laid end to end on a tape, its documents in an order seeded by a hash.
   The tape is cut into blocks of equal size.
2. Targets: sources weigh 1, 2, 3, repeating, in code point order with null last. They share all
   words by weight; a target stops at 3 times its source's size and the excess is shared again.
3. For the first N_k blocks of the mix (the shards 1 to k), seats go to sources by the highest
   quotients target / (2 * seats + 1). The method never takes a seat back as N_k grows, so the
   differences of consecutive rows are each shard's integer quotas.
4. A source with quota q over b blocks is read q div b times as a whole, and q mod b blocks from a
   seeded start on. A document's share of that run is arithmetic on its place on the tape.

Places on a tape come from two sums: within (source, bucket of the hash order), and over the bucket
totals of a source; a source with a third of all rows is dealt over BUCKETS tasks. Only the sums by
source (one row each) meet in one task.

Edge cases: a null text has no words and is never taken; a null source is a source of its own, the
last; a null doc_id is ordered as a word of its own; repeated rows are separate documents. Empty
tables give empty results; when no document has words, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_of

#: Words in a block, shards of the mix, hex digits of the hash that make a bucket.
BLOCK_WORDS, SHARDS, BUCKET_DIGITS = 4, 16, 3
MOST_TIMES = 3
SEED = "mix-1"


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the seeded order of each row, as a table in the shared folder."""
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed)))
    own = docs.select("doc_id", "source", F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("bigint").alias("size"), order.alias("place"))
    return materialize(own, "mix-sizes")


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: rank, weight, source_size, cap, total, target."""
    every = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint"))
    s = s.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", MOST_TIMES * F.col("source_size"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(every))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the sources from the first one on whose cap isn't reached share at one level
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("ratio", "level")


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """(shard, rank, blocks): integer quotas of each shard, highest quotients first."""
    every = Window.partitionBy("shard")
    s = sources.select("rank", "target", "total", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard"))
    s = s.withColumn("house", F.expr(f"((total div {block_words}) * shard) div {shards}"))
    s = s.withColumn("share", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0))
    # A divisor method stays within half a seat for each source, spread by share, of the exact quota:
    # only seats in that window are put in order.
    slack = F.count("*").over(every) / 2 * F.col("share") + 1.5
    s = s.withColumn("low", F.greatest(F.floor(F.col("house") * F.col("share") - slack), F.lit(0)).cast("bigint"))
    s = s.withColumn("high", (F.ceil(F.col("house") * F.col("share") + slack) + 1).cast("bigint"))
    s = s.withColumn("open", F.col("house") - F.sum("low").over(every))
    seats = s.select("shard", "rank", "low", "open", "target", F.explode(F.sequence("low", "high")).alias("seat"))
    best = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "rank", "seat")
    won = seats.withColumn("at", F.row_number().over(best)).where("at <= open and target > 0").groupBy("shard", "rank").agg(F.count("*").alias("won"))
    held = s.join(won, ["shard", "rank"], "left").select("shard", "rank", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats"))
    by_shard = Window.partitionBy("rank").orderBy("shard")
    return held.select("shard", "rank", (F.col("seats") - F.lag("seats", 1, 0).over(by_shard)).alias("blocks"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of this row, repeats counted)."""
    sized = sizes(docs, seed).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sources = targets(sized)
    total = quotas(sources, block_words, shards).groupBy("rank").agg(F.sum("blocks").alias("quota"))
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    plan = sources.join(total, "rank").withColumn("blocks", F.greatest(blocks, F.lit(1)))
    plan = plan.withColumn("quota", F.least("quota", MOST_TIMES * F.col("blocks")))
    start = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(":" + seed))), 1, 8), 16, 10).cast("bigint") % F.col("blocks")
    plan = plan.select("source", "source_size", "target", F.expr("quota div blocks").alias("times"), start.alias("start"), (start + F.col("quota") % F.col("blocks")).alias("end"), "blocks")

    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    both = first.alias("b").join(plan.alias("p"), F.expr("b.source <=> p.source")).select("b.source", "b.bucket", "b.base", *[F.col(f"p.{c}") for c in plan.columns if c != "source"])
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = placed.alias("d").join(both.alias("b"), F.expr("d.source <=> b.source and d.bucket = b.bucket"))
    lo = F.col("base") + F.col("at")

    def overlap(first_block, end_block):
        return F.greatest(F.least(lo + F.col("size"), end_block * block_words) - F.greatest(lo, first_block * block_words), F.lit(0))

    wrapped = F.greatest(F.col("end") - F.col("blocks"), F.lit(0))
    run = overlap(F.col("start"), F.least("end", "blocks")) + overlap(F.lit(0), wrapped)
    return d.select("d.doc_id", "d.source", "size", "source_size", "target", (F.col("times") * F.col("size") + run).cast("bigint").alias("taken"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: words taken over words, rounded up, at most MOST_TIMES. Rows that share a doc_id are taken equally often."""
    own = docs.columns
    taken = mix(docs).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias("__times"))
    taken = taken.select(F.col("doc_id").alias("__id"), "__times")
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id"))).where("__times > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*own)


ORACLE = f"""
with sized as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), 'null') || ':{SEED}') as place,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size
  from documents),
s1 as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
s2 as (select *, row_number() over (order by source asc nulls last) as rank, cast(sum(source_size) over () as bigint) as total from s1),
s3 as (select *, (rank - 1) % 3 + 1 as weight, {MOST_TIMES} * source_size as cap from s2),
s4 as (select *, cap / weight as ratio,
    (total - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as lv from s3),
lvl as (select cast(lv as double) as lv from s4 where lv * weight <= cap order by ratio, rank limit 1),
s5 as (select s4.* exclude (lv), least(cast(cap as double), lvl.lv * weight) as target, count(*) over () as n from s4, lvl),
h as (select s5.*, shard, ((total // {BLOCK_WORDS}) * shard) // {SHARDS} as house, case when total > 0 then target / total else 0.0 end as share
  from s5, generate_series({SHARDS}, {SHARDS}) as g(shard)),
w as (select *, cast(greatest(floor(house * share - (n / 2 * share + 1.5)), 0) as bigint) as low,
    cast(ceil(house * share + (n / 2 * share + 1.5)) + 1 as bigint) as high from h),
seats as (select rank, target, house - sum(low) over () as free, low, high from w),
cand as (select rank, target, free, unnest(generate_series(low, high)) as seat from seats),
won as (select rank, count(*) as won from (select *, row_number() over (order by target / (2 * seat + 1) desc, rank, seat) as spot from cand) where spot <= free and target > 0 group by rank),
plan0 as (select w.*, greatest((source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}, 1) as blocks, low + coalesce(won, 0) as q from w left join won using (rank)),
plan as (select source, rank, source_size, target, blocks, least(q, {MOST_TIMES} * blocks) as quota,
    cast('0x' || substr(md5(coalesce(source, '') || ':{SEED}'), 1, 8) as bigint) % blocks as start from plan0),
d as (select s.doc_id, s.size, p.*, coalesce(sum(s.size) over (partition by s.source order by place, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as lo
  from sized s join plan p on s.source is not distinct from p.source),
e as (select *, start + quota % blocks as fin from d)
select doc_id, size, source_size, target, cast((quota // blocks) * size
  + greatest(least(lo + size, least(fin, blocks) * {BLOCK_WORDS}) - greatest(lo, start * {BLOCK_WORDS}), 0)
  + greatest(least(lo + size, greatest(fin - blocks, 0) * {BLOCK_WORDS}) - greatest(lo, 0), 0) as bigint) as taken
from e
"""
