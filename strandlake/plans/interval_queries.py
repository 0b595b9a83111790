"""Queries over intervals, alignments and variants, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import alignments as A
from strandlake.operators import intervals as I

from .registry import query

HOUR, BIN, WEEK = 3600, 7200, 604_800
DAY_BIN = 64

EVENTS = f"iv as (select event_id, user_id as ctg, cast(floor(epoch(ts)) as bigint) as st, cast(floor(epoch(ts)) as bigint) + {HOUR} as en from events)"
ITEMS = "li as (select l_linenumber as id, l_orderkey as ctg, cast(floor(epoch(l_shipdate) / 86400) as bigint) as st, cast(floor(epoch(l_shipdate) / 86400) as bigint) + cast(l_quantity as bigint) as en from lineitem)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.unix_seconds(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("ctg"), st.alias("st"), (st + HOUR).alias("en"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.expr("cast(floor(unix_seconds(cast(l_shipdate as timestamp)) / 86400) as bigint)")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("ctg"), st.alias("st"), (st + F.col("l_quantity").cast("bigint")).alias("en"))


def _islands_sql(source: str, by: str = "ctg") -> str:
    return f"""m as (select *, max(en) over (partition by {by} order by st, en rows between unbounded preceding and 1 preceding) as reach from {source}),
    f as (select *, sum(cast(reach is null or st > reach as int)) over (partition by {by} order by st, en rows unbounded preceding) as isl from m),
    isl as (select {by}, isl, min(st) as st, max(en) as en, count(*) as members from f group by {by}, isl)"""


@query("interval_merge", f"with {EVENTS}, {_islands_sql('iv')} select ctg, st, en, members from isl")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(events(spark, sf_dir), ["ctg"], width=WEEK)


@query("interval_union_len", f"with {EVENTS}, {_islands_sql('iv')} select ctg, cast(sum(en - st) as bigint) as covered, count(*) as islands from isl group by ctg")
def interval_union_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(events(spark, sf_dir), ["ctg"], width=WEEK)


DEPTH_SQL = f"""{EVENTS}, ends as (select ctg, st as pos, 1 as d from iv union all select ctg, en, -1 from iv),
  steps as (select ctg, pos, sum(d) as d from ends group by all),
  swept as (select ctg, pos as st, lead(pos) over w as en, cast(sum(d) over (w rows unbounded preceding) as bigint) as depth from steps window w as (partition by ctg order by pos))"""


@query("depth_profile", f"with {DEPTH_SQL} select ctg, st, en, depth from swept where en is not null and depth > 0")
def depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.depth(events(spark, sf_dir), ["ctg"], width=WEEK)


@query("depth_eq_1", f"with {DEPTH_SQL} select ctg, cast(sum(en - st) as bigint) as once from swept where en is not null and depth = 1 group by ctg")
def depth_eq_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.depth(events(spark, sf_dir), ["ctg"], width=WEEK).where("depth = 1").groupBy("ctg").agg(F.sum(F.col("en") - F.col("st")).alias("once"))


@query("overlap_join", f"with {EVENTS} select a.event_id, b.event_id as other from iv a join iv b on a.ctg = b.ctg and a.st < b.en and b.st < a.en and a.event_id < b.event_id")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    return I.overlap_join(own, own, ["ctg"], BIN).where("event_id < b_event_id").select("event_id", F.col("b_event_id").alias("other"))


CLICKS = "event_type = (select min(event_type) from events)"


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of the first type in order, and all others, as two interval sets."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    least = t.agg(F.min("event_type")).scalar()
    own = events(spark, sf_dir).join(t, "event_id").withColumn("first", least)
    cols = ["event_id", "ctg", "st", "en"]
    return own.where("event_type = first").select(*cols), own.where("event_type <> first").select(*cols)


KINDS_SQL = f"{EVENTS}, tg as (select iv.* from iv join events using (event_id) where {CLICKS}), ot as (select iv.* from iv join events using (event_id) where not {CLICKS})"


@query(
    "bedcov",
    f"""with {KINDS_SQL}, p as (select tg.*, greatest(tg.st, ot.st) as s, least(tg.en, ot.en) as e from tg join ot on tg.ctg = ot.ctg and tg.st < ot.en and ot.st < tg.en),
    h as (select event_id, count(*) as hits, count(*) filter (where s = st and e = en) as full_hits from p group by event_id),
    m as (select event_id, s, e, max(e) over (partition by event_id order by s, e rows between unbounded preceding and 1 preceding) as r from p),
    c as (select event_id, cast(sum(greatest(e - greatest(s, coalesce(r, s)), 0)) as bigint) as covered from m group by event_id)
    select tg.event_id, tg.ctg, tg.st, tg.en, coalesce(hits, 0) as hits, coalesce(full_hits, 0) as full_hits, coalesce(covered, 0) as covered from tg left join h using (event_id) left join c using (event_id)""",
)
def bedcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the reads that overlap them: hits, whole hits, covered length."""
    targets, others = _kinds(spark, sf_dir)
    return I.coverage_of_targets(targets, others, ["ctg"], BIN)


@query("exclude_overlap", f"with {KINDS_SQL} select event_id, ctg, st, en from tg where not exists (select 1 from ot where ot.ctg = tg.ctg and tg.st < ot.en and ot.st < tg.en)")
def exclude_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, others = _kinds(spark, sf_dir)
    return I.overlap_join(targets, others, ["ctg"], BIN, how="left_anti")


@query("semi_overlap", f"with {KINDS_SQL} select event_id, ctg, st, en from tg where exists (select 1 from ot where ot.ctg = tg.ctg and tg.st < ot.en and ot.st < tg.en)")
def semi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, others = _kinds(spark, sf_dir)
    return I.overlap_join(targets, others, ["ctg"], BIN, how="left_semi")


@query("asof_prev", f"with {KINDS_SQL} select tg.event_id, tg.st, (select max(ot.st) from ot where ot.ctg = tg.ctg and ot.st <= tg.st) as prev_st from tg")
def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, others = _kinds(spark, sf_dir)
    found = I.previous(targets, others.withColumnRenamed("st", "prev_st"), ["ctg"], "st", "prev_st", "prev_st", width=WEEK)
    return found.select("event_id", "st", "prev_st")


@query("contained_join", f"with {KINDS_SQL} select tg.event_id, ot.event_id as inner_id from tg join ot on tg.ctg = ot.ctg and tg.st - 1800 <= ot.st and ot.en <= tg.en + 1800")
def contained_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals within a window around each target."""
    targets, others = _kinds(spark, sf_dir)
    wide = targets.withColumn("st", F.col("st") - 1800).withColumn("en", F.col("en") + 1800)
    return I.overlap_join(wide, others, ["ctg"], BIN).where("st <= b_st and b_en <= en").select("event_id", F.col("b_event_id").alias("inner_id"))


@query("approx_junction", f"with {KINDS_SQL} select distinct tg.event_id from tg join ot on tg.ctg = ot.ctg and abs(tg.st - ot.st) <= 600 and abs(tg.en - ot.en) <= 600")
def approx_junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that another interval matches at both ends within a tolerance."""
    targets, others = _kinds(spark, sf_dir)
    met = I.overlap_join(targets, others, ["ctg"], BIN)
    return met.where((F.abs(F.col("st") - F.col("b_st")) <= 600) & (F.abs(F.col("en") - F.col("b_en")) <= 600)).select("event_id").distinct()


@query("interval_jaccard", f"with {KINDS_SQL} select tg.event_id, ot.event_id as other, (least(tg.en, ot.en) - greatest(tg.st, ot.st)) / (greatest(tg.en, ot.en) - least(tg.st, ot.st)) as jaccard from tg join ot on tg.ctg = ot.ctg and tg.st < ot.en and ot.st < tg.en where (least(tg.en, ot.en) - greatest(tg.st, ot.st)) / (greatest(tg.en, ot.en) - least(tg.st, ot.st)) > 0.1")
def interval_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, others = _kinds(spark, sf_dir)
    met = I.overlap_join(targets, others, ["ctg"], BIN)
    share = (F.least("en", "b_en") - F.greatest("st", "b_st")) / (F.greatest("en", "b_en") - F.least("st", "b_st"))
    return met.select("event_id", F.col("b_event_id").alias("other"), share.alias("jaccard")).where("jaccard > 0.1")


@query("break_points", f"with {EVENTS}, g as (select ctg, st - lag(en) over (partition by ctg order by st, en, event_id) as gap from iv) select ctg, count(*) filter (where gap > 0) as gaps, count(*) filter (where gap <= 0) as overlaps, max(gap) as widest from g group by ctg")
def break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("ctg").orderBy("st", "en", "event_id")
    g = events(spark, sf_dir).select("ctg", (F.col("st") - F.lag("en").over(order)).alias("gap"))
    return g.groupBy("ctg").agg(F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(F.col("gap") <= 0).alias("overlaps"), F.max("gap").alias("widest"))


@query("longest_per_island", f"""with {ITEMS}, {_islands_sql("li")}, r as (select li.ctg, isl.st as island, li.id, li.st, li.en,
    row_number() over (partition by li.ctg, isl.st order by li.en - li.st desc, li.st, li.id) as rn from li join isl on li.ctg = isl.ctg and li.st >= isl.st and li.en <= isl.en)
    select ctg, island, id, st, en from r where rn = 1""")
def longest_per_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest interval of each cluster of overlapping ones."""
    own = items(spark, sf_dir)
    order = Window.partitionBy("ctg").orderBy("st", "en")
    reach = F.max("en").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = own.withColumn("new", F.when(reach.isNull() | (F.col("st") > reach), F.col("st")))
    named = flagged.withColumn("island", F.last("new", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = Window.partitionBy("ctg", "island").orderBy((F.col("en") - F.col("st")).desc(), "st", "id")
    return named.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("ctg", "island", "id", "st", "en")


@query("dedupe_intervals", f"with {ITEMS} select distinct ctg, st, en from li")
def dedupe_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("ctg", "st", "en").distinct()


@query("introns", f"with {ITEMS}, p as (select ctg, lag(en) over (partition by ctg order by st, en) as st, st as en from li) select ctg, st, en from p where st < en")
def introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between consecutive blocks of a group."""
    order = Window.partitionBy("ctg").orderBy("st", "en")
    return items(spark, sf_dir).select("ctg", F.lag("en").over(order).alias("st"), F.col("st").alias("en")).where("st < en")


@query("primary_pick", """with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, max(o_totalprice) over (partition by o_custkey) as best from orders)
    select o_custkey, o_orderkey, cast(rn as int) as rn from r where rn <= 6 and o_totalprice >= 0.8 * best""")
def primary_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each query, and at most 5 more within a ratio of its score."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    hits = t.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return A.select_hits(hits, 5, 0.8).select(F.col("q").alias("o_custkey"), F.col("id").alias("o_orderkey"), "rn")


@query("top_edge", "select l_suppkey, arg_max(l_partkey, (c, -l_partkey)) as l_partkey, max(c) as n from (select l_suppkey, l_partkey, count(*) as c from lineitem group by all) group by l_suppkey")
def top_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest edge out of each node, the first of equal ones."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("c"))
    return t.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("c", -F.col("l_partkey"))).alias("l_partkey"), F.max("c").alias("n"))


@query("set_ops_ids", """with s as (select o_custkey as k, list_sort(list(distinct o_orderkey % 97)) as a, list_sort(list(distinct o_orderkey % 89)) as b from orders group by o_custkey)
    select k, len(list_intersect(a, b)) as both, len(list_distinct(list_concat(a, b))) as either, len(list_filter(a, lambda x: not list_contains(b, x))) as only_a from s""")
def set_ops_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union and difference of id lists."""
    s = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.col("o_orderkey") % 97).alias("a"), F.collect_set(F.col("o_orderkey") % 89).alias("b"))
    n = lambda c: F.size(c).cast("bigint")
    return s.select("k", n(F.array_intersect("a", "b")).alias("both"), n(F.array_union("a", "b")).alias("either"), n(F.array_except("a", "b")).alias("only_a"))


@query("canonical_pairs", """with p as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_returnflag = 'R'),
    t as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_returnflag = 'A')
    select a, b, exists (select 1 from t where t.a = p.a and t.b = p.b) as found from p""")
def canonical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted pairs in canonical order, and whether the truth holds them."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_returnflag")
    truth = t.where("l_returnflag = 'A'").select("a", "b").distinct().withColumn("found", F.lit(True))
    return t.where("l_returnflag = 'R'").select("a", "b").distinct().join(truth, ["a", "b"], "left").select("a", "b", F.coalesce("found", F.lit(False)).alias("found"))


@query("mapq_cum_acc", """with h as (select cast(l_quantity as int) as mapq, count(*) as n, count(*) filter (where l_returnflag = 'R') as n_err from lineitem group by all)
    select mapq, n, n_err, cast(sum(n) over w as bigint) as cum_n, sum(n_err) over w / sum(n) over w as cum_err_rate from h window w as (order by mapq desc rows unbounded preceding)""")
def mapq_cum_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of all alignments of at least a mapping quality; quantity and return flag stand in for quality and error."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("int").alias("mapq"), (F.col("l_returnflag") == "R").alias("wrong"))
    return A.cumulative_accuracy(t)


CIGARS = "cg as (select l_orderkey as id, l_linenumber as n, cast(l_linenumber + 2 as varchar) || 'S' || cast(cast(l_quantity as int) as varchar) || 'M' || cast(l_partkey % 9 + 1 as varchar) || 'I' || cast(l_suppkey % 40 + 1 as varchar) || 'M' || cast(l_partkey % 700 + 1 as varchar) || 'D10M' as cigar from lineitem)"


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat((F.col("l_linenumber") + 2).cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M"), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit("I"), (F.col("l_suppkey") % 40 + 1).cast("string"), F.lit("M"), (F.col("l_partkey") % 700 + 1).cast("string"), F.lit("D10M"))
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), text.alias("cigar"))


OPS_SQL = f"{CIGARS}, ops as (select id, n, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1))::int as len, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2)) as op from cg)"


@query("cigar_hist", f"""with {OPS_SQL} select op, case when len < 10 then 0 when len < 50 then 1 when len < 100 then 2 when len < 300 then 3 when len < 400 then 4 else 5 end as bin, count(*) as n from ops where op in ('I', 'D') group by all""")
def cigar_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions and deletions by length bin."""
    return A.indel_histogram(cigars(spark, sf_dir))


@query("cigar_totals", f"with {OPS_SQL} select op, count(*) as n, cast(sum(len) as bigint) as bases from ops group by op")
def cigar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = cigars(spark, sf_dir).select(F.explode(S.cigar_ops(F.col("cigar"))).alias("o"))
    return ops.groupBy(F.col("o.op").alias("op")).agg(F.count("*").alias("n"), F.sum(F.col("o.len")).alias("bases"))


CIGAR_LISTS = f"{CIGARS}, ls as (select id, n, list_transform(regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 1), lambda x: cast(x as bigint)) as ln, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=XB])', 2) as op from cg)"


def _kind_sum(kinds: str) -> str:
    return f"cast(list_sum(list_transform(generate_series(1, len(ln)), lambda i: case when contains('{kinds}', op[i]) then ln[i] else 0 end)) as bigint)"


@query("cigar_spans", f"with {CIGAR_LISTS} select id, n, {_kind_sum('MI')} as q_len, {_kind_sum('MD')} as r_len, len(list_filter(op, lambda o: o in ('I', 'D'))) as gap_opens from ls")
def cigar_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query and reference lengths of an alignment, in its own row."""
    ops = S.cigar_ops(F.col("cigar"))
    c = cigars(spark, sf_dir)
    return c.select("id", "n", S.cigar_sum(ops, "MI").alias("q_len"), S.cigar_sum(ops, "MD").alias("r_len"), F.size(F.filter(ops, lambda o: o["op"].isin("I", "D"))).cast("bigint").alias("gap_opens"))


VARIANTS = "v as (select l_orderkey as ctg, l_partkey as pos, substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) || case when l_linenumber = 3 then 'TT' else '' end as ref, substr('GATC', cast(l_suppkey % 4 as int) + 1, 1) || case when l_linenumber = 5 then 'CCC' else '' end as alt from lineitem)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ref = F.concat(F.substr(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)), F.when(F.col("l_linenumber") == 3, "TT").otherwise(""))
    alt = F.concat(F.substr(F.lit("GATC"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)), F.when(F.col("l_linenumber") == 5, "CCC").otherwise(""))
    return t.select(F.col("l_orderkey").alias("ctg"), F.col("l_partkey").alias("pos"), ref.alias("ref"), alt.alias("alt"))


@query("ts_tv", f"""with {VARIANTS} select count(*) filter (where ref || alt in ('AG', 'GA', 'CT', 'TC')) as ts, count(*) filter (where len(ref) = 1 and len(alt) = 1 and ref <> alt and ref || alt not in ('AG', 'GA', 'CT', 'TC')) as tv,
    count(*) filter (where len(alt) > len(ref)) as ins, count(*) filter (where len(alt) < len(ref)) as del from v""")
def ts_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.variant_counts(variants(spark, sf_dir))


@query("asmgene_classes", """with h as (select l_partkey as gene, l_suppkey as ctg, sum(l_quantity) as cov from lineitem group by all), b as (select gene, max(cov) as best, count(*) filter (where cov >= 60) as whole from h group by gene)
    select case when whole = 1 then 'full_sgl' when whole > 1 then 'full_dup' when best >= 50 then 'part50+' when best >= 10 then 'part10+' else 'part10-' end as class, count(*) as n from b group by all""")
def asmgene_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes by how completely one contig holds them; quantity stands in for percent covered."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("ctg")).agg(F.sum("l_quantity").alias("cov"))
    return A.gene_classes(t, 60)


@query("events_sessions", f"with {EVENTS}, {_islands_sql('iv')} select ctg, count(*) as sessions, max(members) as longest, max(en - st) as widest from isl group by ctg")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merged(events(spark, sf_dir), ["ctg"], width=WEEK).groupBy("ctg").agg(F.count("*").alias("sessions"), F.max("members").alias("longest"), F.max(F.col("en") - F.col("st")).alias("widest"))
