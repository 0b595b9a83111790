"""Queries over hits, chains and pairs made of line items, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import hits as H

from .registry import query
from .sequence_queries import MINIMIZER_K, _minimizer_sql, minimizer_index

#: Line items as hits: an order is a query, a line a hit; of several with one number the least is taken.
LINES = """li as (select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, x[1] as l_partkey, x[2] as l_suppkey, x[3] as l_quantity, x[4] as l_extendedprice, x[5] as l_returnflag from
  (select l_orderkey, l_linenumber, min((l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag)) as x from lineitem group by all))"""
HITS = LINES + """, h as (select l_orderkey as q, l_linenumber as id, l_suppkey % 2 as t, cast(l_returnflag = 'R' as int) as rev, cast(floor(l_extendedprice) as bigint) as score, l_partkey % 20 + 1 as n,
  l_linenumber * 700 + l_partkey % 300 as qs, l_linenumber * 700 + l_partkey % 300 + cast(l_quantity as bigint) * 10 as qe,
  l_linenumber * 650 + l_suppkey % 200 as ts, l_linenumber * 650 + l_suppkey % 200 + cast(l_quantity as bigint) * 10 + l_partkey % 5 as te, l_suppkey % 61 as mapq from li)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    least = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")).alias("x")
    return t.groupBy("l_orderkey", "l_linenumber").agg(least).select("l_orderkey", "l_linenumber", "x.*")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    line, part, supp = (F.col(c).cast("bigint") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    long = F.col("l_quantity").cast("bigint") * 10
    qs, ts = line * 700 + part % 300, line * 650 + supp % 200
    return t.select(F.col("l_orderkey").alias("q"), line.alias("id"), (supp % 2).alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("rev"), F.floor("l_extendedprice").alias("score"), (part % 20 + 1).alias("n"), qs.alias("qs"), (qs + long).alias("qe"), ts.alias("ts"), (ts + long + part % 5).alias("te"), (supp % 61).alias("mapq"))


@query("join_long", f"""with {HITS}, l as (select *, lag(t) over w as lt, lag(rev) over w as lr, lag(score) over w as ls, lag(qs) over w as lqs, lag(qe) over w as lqe, lag(ts) over w as lts, lag(te) over w as lte from h window w as (partition by q order by qs, qe, id)),
  g as (select *, greatest(qs - lqe, ts - lte) as wide, least(qs - lqe, ts - lte) as narrow from l),
  f as (select *, case when lt = t and lr = rev and qs - lqe > 0 and ts - lte > 0 and wide <= {H.JOIN_LONG} and narrow <= {H.JOIN_SHORT} and least(score, ls) >= floor(wide * {H.JOIN_FLANK_SCORE} / {H.JOIN_LONG} + 0.499)
    and least(te - ts, qe - qs, lte - lts, lqe - lqs) >= floor(wide * {H.JOIN_FLANK_RATIO}) then 0 else 1 end as new from g),
  i as (select *, sum(new) over (partition by q order by qs, qe, id rows unbounded preceding) as isl from f)
  select q, arg_min(id, qs) as id, min(t) as t, min(rev) as rev, count(*) as parts, cast(sum(score) as bigint) as score, cast(sum(n) as bigint) as n, min(qs) as qs, max(qe) as qe, min(ts) as ts, max(te) as te from i group by q, isl""")
def join_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that go on over a long gap put together."""
    return H.joined_long(hits(spark, sf_dir))


@query("resync_hits", f"""with {HITS}, k as (select q, id, case when n > 10 then id else 1 end as parent from h where n > 4), r as (select *, row_number() over (partition by q order by id) - 1 as new_id from k)
  select r.q, r.id, r.new_id, coalesce(u.new_id, r.new_id) as new_parent from r left join r u on u.q = r.q and u.id = r.parent""")
def resync_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits numbered anew after some went."""
    kept = hits(spark, sf_dir).where("n > 4").select("q", "id", F.when(F.col("n") > 10, F.col("id")).otherwise(1).alias("parent"))
    return H.resynced(kept)


ANCHORS = LINES + """, a as (select l_orderkey as chain, l_linenumber * 40 + l_partkey % 3 as qpos, l_linenumber * 40 + l_partkey % 3 + case when l_linenumber > 3 then 7 else 0 end + l_suppkey % 2 as rpos, 15 as span from li)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir)
    q = F.col("l_linenumber").cast("bigint") * 40 + F.col("l_partkey") % 3
    return t.select(F.col("l_orderkey").alias("chain"), q.alias("qpos"), (q + F.when(F.col("l_linenumber") > 3, 7).otherwise(0) + F.col("l_suppkey") % 2).alias("rpos"), F.lit(15).alias("span"))


@query("max_stretch", f"""with {ANCHORS}, d as (select *, row_number() over w - 1 as nth, qpos - lag(qpos) over w as dq, rpos - lag(rpos) over w as dr from a window w as (partition by chain order by rpos, qpos)),
  r as (select *, sum(case when dq = dr then 0 else 1 end) over (partition by chain order by nth rows unbounded preceding) as run, case when dq = dr then least(dq, span) else span end as gain from d),
  s as (select chain, run, min(nth) as first, count(*) as anchors, cast(sum(gain) as bigint) as score from r group by chain, run),
  b as (select *, row_number() over (partition by chain order by score desc, first) as rn from s) select chain, first, anchors, score from b where rn = 1""")
def max_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.longest_stretch(anchors(spark, sf_dir))


@query("fuzzy_lengths", f"""with {ANCHORS}, d as (select *, qpos - lag(qpos) over w as dq, rpos - lag(rpos) over w as dr from a window w as (partition by chain order by rpos, qpos)),
  s as (select chain, qpos, rpos, span, coalesce(greatest(dq, dr), span) as block, case when dq is null then span when dq > span and dr > span then span else least(dq, dr) end as match from d)
  select chain, arg_min(qpos, (rpos, qpos)) + 1 - 15 as qs, arg_max(qpos, (rpos, qpos)) + 1 as qe, min(rpos) + 1 - 15 as rs, max(rpos) + 1 as re, cast(sum(match) as bigint) as mlen, cast(sum(block) as bigint) as blen from s group by chain""")
def fuzzy_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of chains, and the bases that their anchors cover."""
    return H.fuzzy_lengths(anchors(spark, sf_dir))


@query("inversion_mapq", f"""with {HITS}, w as (select q, id, mapq, score % 5 = 0 as inv, lag(mapq) over o as l, lead(mapq) over o as r from h window o as (partition by q order by t, ts, id))
  select q, id, case when inv then case when l is not null and r is not null then least(l, r) else 0 end else mapq end as mapq from w""")
def inversion_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.inversion_quality(hits(spark, sf_dir).withColumn("inv", F.col("score") % 5 == 0)).select("q", "id", "mapq")


@query("first_primary", f"with {HITS}, k as (select q, id, case when n > 10 then id else 1 end as parent from h) select q, id, coalesce(id = parent and id = min(case when id = parent then id end) over (partition by q), false) as sam_pri from k")
def first_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).select("q", "id", F.when(F.col("n") > 10, F.col("id")).otherwise(1).alias("parent"))
    return H.first_primary(own).select("q", "id", "sam_pri")


@query("hit_order", f"""with {HITS}, m as (select q, id, mapq as t, mapq % 7 = 0 as is_alt, case when mapq % 7 = 0 then cast(floor(score * 0.85 + 0.499) as bigint) else score end as used from h)
  select q, id, t, is_alt, used, row_number() over (partition by q order by used desc, md5(cast(id as varchar)), id) - 1 as rank from m""")
def hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in order of score, hits on alternative contigs for less."""
    own = hits(spark, sf_dir).select("q", "id", F.col("mapq").alias("t"), "score")
    return H.hit_order(own, own.where("t % 7 = 0").select("t"))


@query("base_mapq", f"""with {HITS}, x as (select q, id, cast(score % 900 + 100 as double) as score, cast(score % 700 + 300 as double) as score0, cast(mapq as double) as subsc, cast(n as double) as n, cast(score % 800 + 50 as double) as dp_max, cast(mapq * 3 as double) as dp_max2, cast(qe - qs as double) as mlen, cast(te - ts as double) as blen, cast(n % 4 as double) as n_sub from h),
  y as (select *, least(least(1.0, 0.01 * score) * (5000.0 / (5000.0 + n)), case when n > 10 then 1.0 else 0.1 * n end) as trust, greatest(subsc, 40) as sec, mlen / blen as idt from x),
  z as (select *, case when dp_max2 > 0 then least(floor(idt * trust * 40 * (1 - (dp_max2 * sec / dp_max / score0) * (dp_max2 * sec / dp_max / score0)) * ln(dp_max / 2)), floor(6.02 * idt * idt * (dp_max - dp_max2) / 2 + 0.499))
    else floor(idt * trust * 40 * (1 - sec / score0) * ln(dp_max / 2)) end - floor(4.343 * ln(n_sub + 1) + 0.499) as raw from y)
  select q, id, cast(case when least(60, greatest(0, raw)) = 0 and dp_max > dp_max2 then 1 else least(60, greatest(0, raw)) end as int) as mapq from z""")
def base_mapq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping quality from base alignments."""
    d = lambda c: c.cast("double")
    s = F.col("score")
    cols = {"score": d(s % 900 + 100), "score0": d(s % 700 + 300), "subsc": d(F.col("mapq")), "n": d(F.col("n")), "dp_max": d(s % 800 + 50), "dp_max2": d(F.col("mapq") * 3), "mlen": d(F.col("qe") - F.col("qs")), "blen": d(F.col("te") - F.col("ts")), "n_sub": d(F.col("n") % 4), "sum_score": F.lit(5000.0), "rep_len": d(F.col("n"))}
    return hits(spark, sf_dir).select("q", "id", H.base_mapping_quality(cols).alias("mapq"))


@query("hit_filter", f"with {HITS} select q, id from h where n >= 3 and te - ts >= 100 and score >= 1000 and not (qs > 0.3 * 4000 and 4000 - qe > 0.3 * 4000)")
def hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = hits(spark, sf_dir).select("q", "id", "n", (F.col("te") - F.col("ts")).alias("mlen"), F.col("score").alias("dp_max"), "qs", "qe", F.lit(4000).alias("qlen"))
    return H.kept_hits(own, 3, 100, 1000, 0.3).select("q", "id")


@query("pair_ends", f"""with {HITS}, a as (select * from h where id % 2 = 0), b as (select * from h where id % 2 = 1),
  m as (select a.q, a.id as a, b.id as b, a.score + b.score as score from a join b on a.q = b.q and a.t = b.t and a.rev <> b.rev
    where case when a.rev = 0 then a.ts <= b.ts and b.ts - a.te <= 900 else b.ts <= a.ts and a.ts - b.te <= 900 end),
  k as (select q, max(score) filter (where id % 2 = 0) as ta, max(score) filter (where id % 2 = 1) as tb from h group by q),
  g as (select m.* from m join k using (q) where score >= greatest(ta + tb - 20000, 0)),
  r as (select *, row_number() over (partition by q order by score desc, a, b) as rn, max(score) over (partition by q) as top from g),
  o as (select q, count(*) - 1 as others from r where score + 20000 >= top group by q)
  select r.q, r.a, r.b, r.score, o.others from r join o using (q) where rn = 1""")
def pair_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two ends put together as pairs."""
    own = hits(spark, sf_dir)
    return H.pairs(own.where("id % 2 = 0"), own.where("id % 2 = 1"), 900, 20_000)


@query("read_through", f"""with {HITS}, one as (select q from h group by q having count(*) = 1), p as (select h.*, qe as qlen from h join one using (q)),
  b as (select q, t, rev, ts + n % 5 as ts, te + n % 5 as te, 0 as qs, qe, qe + mapq % 2 as qlen from p)
  select p.q from p join b using (q, t, rev) where abs(p.ts - b.ts) < 3 and abs(p.te - b.te) < 3 and ((p.qs = 0 and b.qe = b.qlen) or (b.qs = 0 and p.qe = p.qlen and p.n > 0))""")
def read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments shorter than their reads."""
    own = hits(spark, sf_dir)
    p = own.join(own.groupBy("q").count().where("count = 1").select("q"), "q", "left_semi").withColumn("qlen", F.col("qe"))
    move = F.col("n") % 5
    b = p.select("q", "t", "rev", (F.col("ts") + move).alias("ts"), (F.col("te") + move).alias("te"), F.lit(0).alias("qs"), "qe", (F.col("qe") + F.col("mapq") % 2).alias("qlen"))
    return H.read_through(p, b)


@query("segment_split", f"""with {HITS}, s as (select q as frag, id as seg, n * 50 as len from h), p as (select *, coalesce(sum(len) over (partition by frag order by seg rows between unbounded preceding and 1 preceding), 0) as st from s)
  select p.frag, p.seg, cast(h.qs - p.st as bigint) as seg_pos, h.ts as rpos from h join p on p.frag = h.q and h.qs >= p.st and h.qs < p.st + p.len""")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of joined segments given back to each segment."""
    own = hits(spark, sf_dir)
    return H.by_segment(own.select(F.col("q").alias("frag"), F.col("qs").alias("qpos"), F.col("ts").alias("rpos")), own.select(F.col("q").alias("frag"), F.col("id").alias("seg"), (F.col("n") * 50).alias("len")))


@query("merge_parts", f"""with {HITS}, u as (select q, id as rid, score from h where t = 0 union all select q, id + 100, score from h where t = 1),
  r as (select *, row_number() over (partition by q order by score desc, rid) - 1 as rank from u) select q, rid, score, rank from r where rank < 3""")
def merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits against the parts of an index as one list."""
    own = hits(spark, sf_dir).select("q", F.col("id").alias("rid"), "score", "t")
    return H.merged_parts([own.where("t = 0"), own.where("t = 1")], [0, 100], 3)


REPEAT_MOST = 15


@query("repeat_length", f"""with {_minimizer_sql()}, o as (select minimizer from mins group by minimizer having count(*) >= {REPEAT_MOST}),
  e as (select read_id, pos as st, pos + {MINIMIZER_K} as en from mins where minimizer in (select minimizer from o)),
  r as (select *, max(en) over (partition by read_id order by st, en rows between unbounded preceding and 1 preceding) as reach from e)
  select read_id, cast(sum(greatest(en - greatest(st, coalesce(reach, st)), 0)) as bigint) as rep_len from r group by read_id""")
def repeat_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of reads under frequent minimizers."""
    return H.repeat_length(minimizer_index(spark, sf_dir), MINIMIZER_K, REPEAT_MOST)


@query("seed_rules", f"""with {HITS} select q as query_id, id * 40000 as read_id, rev, qs as query_pos, ts as ref_pos from h where q <= id * 40000 and rev = 0""")
def seed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds without the diagonal, each pair once, on the forward strand."""
    own = hits(spark, sf_dir).select(F.col("q").alias("query_id"), (F.col("id") * 40_000).alias("read_id"), "rev", F.col("qs").alias("query_pos"), F.col("ts").alias("ref_pos"))
    return H.seed_rules(own, diagonal=True, dual=False, strand="forward")


@query("unmasked_minimizers", f"""with {_minimizer_sql()}, mk as (select read_id, cast(read_id % 7 * 20 as int) as st, cast(read_id % 7 * 20 + 60 as int) as en from reads)
  select mins.read_id, pos, strand, minimizer from mins join mk using (read_id) where greatest(least(en, pos + {MINIMIZER_K}) - greatest(st, pos), 0) <= {MINIMIZER_K // 2}""")
def unmasked_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers of which masks cover at most half."""
    own = minimizer_index(spark, sf_dir)
    st = (F.col("read_id") % 7 * 20).cast("int")
    masks = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id")).select("read_id", st.alias("st"), (st + 60).alias("en"))
    return H.unmasked(own, masks, MINIMIZER_K)


@query("ov_eval", """with iv as (select event_id as name, user_id as ctg, cast(floor(epoch(ts)) as bigint) as st, cast(floor(epoch(ts)) as bigint) + 3600 as en from events),
  l as (select distinct a.name as a, b.name as b from iv a join iv b on a.ctg = b.ctg and a.name < b.name and least(a.en, b.en) - greatest(a.st, b.st) >= 600),
  p as (select distinct a, b from l where (a + b) % 3 <> 0) select count(*) as overlaps, count(*) filter (where p.a is null) as missing, count(p.a) / count(*) as sensitivity from l left join p using (a, b)""")
def ov_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps that mappings imply against predicted ones; two of three are predicted here, in either order."""
    from .interval_queries import BIN, events
    from strandlake.operators.intervals import overlap_join

    own = events(spark, sf_dir).withColumnRenamed("event_id", "name")
    met = overlap_join(own, own, ["ctg"], BIN).where("name < b_name")
    predicted = met.where((F.col("name") + F.col("b_name")) % 3 != 0).select(F.col("b_name").alias("a"), F.col("name").alias("b"))
    return H.overlap_sensitivity(own, predicted, 600, BIN)
