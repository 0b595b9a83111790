"""Queries over assemblies, genes, junctions and variants made of line items and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import assembly as A

from .hit_queries import HITS, hits
from .interval_queries import BIN, KINDS_SQL, VARIANTS, _kinds, variants
from .registry import query
from .sequence_queries import lengths_of

REFERENCE = 2_000_000
PAF = HITS + """, p as (select q, qs, qe, case when rev = 1 then '-' else '+' end as strand, t, ts + q * 40 as ts, te + q * 40 as te from h), ctg as (select q, max(qe) + 100 as qlen from h group by q)"""


def paf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, sf_dir)
    strand = F.when(F.col("rev") == 1, "-").otherwise("+")
    move = F.col("q") * 40
    return h.select("q", "qs", "qe", strand.alias("strand"), "t", (F.col("ts") + move).alias("ts"), (F.col("te") + move).alias("te")), h.groupBy("q").agg((F.max("qe") + 100).alias("qlen"))


BLOCKS = """bl0 as (select *, lag(qe) over (partition by q order by qs, qe, ts, te) as last from {0}),
  bl as (select *, qe - greatest(qs, coalesce(last, qs)) as blen from bl0 where last is null or qs >= last or qe >= last),
  bk as (select *, case when lag(qe) over w is null then null when lag(t) over w = t and lag(strand) over w = strand then abs(qs - lag(qe) over w - case when strand = '+' then ts - lag(te) over w else lag(ts) over w - te end) else 1000000000 end as gap from bl window w as (partition by q order by qs, qe, ts, te))"""


@query("ngx", "with l as (select n_chars as len, sum(n_chars) over (order by n_chars desc, doc_id rows unbounded preceding) as cum from documents), s as (select unnest([0.25, 0.5, 0.75]) as share) select cast(share as double) as share, max(len) filter (where cum > share * 300000) as n from s, l group by share")
def ngx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NG25, NG50 and NG75 for a reference of a stated length."""
    return A.ngx(lengths_of(spark, sf_dir), 300_000, [0.25, 0.5, 0.75])


@query("aunga", "with l as (select n_chars as len, coalesce(sum(n_chars) over (order by n_chars desc, doc_id rows between unbounded preceding and 1 preceding), 0) as cum from documents), c as (select greatest(least(len, 1500000 - cum), 0) as x from l) select sum(cast(x as double) * x / 1500000) as area from c")
def aunga(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.area_under(lengths_of(spark, sf_dir), 1_500_000)


@query("query_breaks", f"with {PAF}, {BLOCKS.format('p')} select q, count(*) as blocks, cast(sum(blen) as bigint) as bases, count(*) filter (where gap >= 0) as breaks, count(*) filter (where gap >= 10000) as far from bk group by q")
def query_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of queries, what each adds, and breaks between them."""
    b = A.query_blocks(paf(spark, sf_dir)[0])
    return b.groupBy("q").agg(F.count("*").alias("blocks"), F.sum("blen").alias("bases"), F.count_if(F.col("gap") >= 0).alias("breaks"), F.count_if(F.col("gap") >= 10_000).alias("far"))


def _union_sql(name: str, by: str, st: str, en: str) -> str:
    return f"{name}m as (select *, max({en}) over (partition by {by} order by {st}, {en} rows between unbounded preceding and 1 preceding) as r from big), {name} as (select cast(sum(greatest({en} - greatest({st}, coalesce(r, {st})), 0)) as bigint) as n from {name}m)"


@query("asm_stat", f"""with {PAF}, big as (select * from p where qe - qs >= 200), {BLOCKS.format('big')}, {_union_sql('cov', 't', 'ts', 'te')}, {_union_sql('qc', 'q', 'qs', 'qe')},
  ends as (select t, ts as pos, 1 as d from big union all select t, te, -1 from big), st as (select t, pos, sum(d) as d from ends group by all),
  sw as (select t, lead(pos) over (partition by t order by pos) - pos as n, sum(d) over (partition by t order by pos rows unbounded preceding) as depth from st), once as (select sum(n) as n from sw where depth = 1),
  lc as (select qlen, sum(qlen) over (order by qlen desc, q rows unbounded preceding) as cum from ctg), bc as (select blen, sum(blen) over (order by blen desc, q, qs, qe, gap rows unbounded preceding) as cum from bk),
  ar as (select cast(round(sum(x * x / {REFERENCE})) as bigint) as a from (select cast(greatest(least(blen, {REFERENCE} - (cum - blen)), 0) as double) as x from bc))
  select cast((select sum(qlen) from ctg) as bigint) as length, cov.n as l_cov, cov.n / {REFERENCE} as ref_cov, (cov.n - once.n) / cov.n as ref_dup, qc.n / (select sum(qlen) from ctg) as query_cov,
  (select max(qlen) from lc where cum > 0.75 * {REFERENCE}) as ng75, (select max(qlen) from lc where cum > 0.5 * {REFERENCE}) as ng50, (select max(blen) from bc where cum > 0.5 * {REFERENCE}) as nga50, ar.a as aunga,
  cast((select sum(c - 1) from (select count(*) as c from p group by q)) as bigint) as breaks, (select count(*) from bk where blen >= 200 and gap >= 0) as breaks_long, (select count(*) from bk where blen >= 200 and gap >= 10000) as breaks_far from cov, qc, once, ar""")
def asm_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembly summary: coverage, duplication, NGx, NGA50, area and breaks."""
    rows, contigs = paf(spark, sf_dir)
    return A.assembly_stats(rows, contigs, REFERENCE, 200)


GENES = "g as (select l_suppkey % 3 as asm, l_partkey as gene, 500 as qlen, l_linenumber * 40 as qs, l_linenumber * 40 + l_quantity * 9 as qe, l_quantity * 10 - l_suppkey % 4 as mlen, l_quantity * 10 as blen from lineitem)"
GENE_COV = f"""{GENES}, ok as (select * from g where mlen >= blen * 0.99), cn as (select asm, gene, count(*) filter (where qe - qs >= qlen * 0.8) as f, count(*) as n from ok group by all),
  mm as (select *, max(qe) over (partition by asm, gene order by qs, qe rows between unbounded preceding and 1 preceding) as r from ok), cv as (select asm, gene, sum(greatest(qe - greatest(qs, coalesce(r, qs)), 0)) / 500 as share from mm group by asm, gene)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    st, n = F.col("l_linenumber") * 40, F.col("l_quantity")
    return t.select((F.col("l_suppkey") % 3).alias("asm"), F.col("l_partkey").alias("gene"), F.lit(500).alias("qlen"), st.alias("qs"), (st + n * 9).alias("qe"), (n * 10 - F.col("l_suppkey") % 4).alias("mlen"), (n * 10).alias("blen"))


@query("gene_coverage", f"with {GENE_COV} select asm, gene, f as full, share, n from cn join cv using (asm, gene)")
def gene_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes in assemblies: like hits, whole ones, and the share covered."""
    return A.gene_coverage(genes(spark, sf_dir), 0.99, 0.8)


@query("gene_matrix", f"""with {GENE_COV}, ow as (select asm, gene, f, share from cn join cv using (asm, gene)), base as (select gene, f as rf from ow where asm = 0), ev as (select a.asm, base.gene, rf, ow.f, ow.share from base cross join (select distinct asm from g) a left join ow on ow.asm = a.asm and ow.gene = base.gene)
  select asm, case when f is null then 'part10-' when f = 1 then 'full_sgl' when f > 1 then 'full_dup' when share >= 0.8 then 'frag' when share >= 0.5 then 'part50+' when share >= 0.1 then 'part10+' else 'part10-' end as class, count(*) as n from ev where rf = 1 group by all
  union all select asm, 'dup_cnt', count(*) filter (where f > 1) from ev where rf > 1 group by asm union all select asm, 'dup_sum', cast(coalesce(sum(f), 0) as bigint) from ev where rf > 1 group by asm""")
def gene_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene completeness of each assembly against the first."""
    return A.gene_matrix(genes(spark, sf_dir).withColumn("asm", F.col("asm").cast("bigint")), 0, 0.99, 0.8)


@query("vcf_stat", f"""with {VARIANTS}, w as (select ref || repeat('A', cast(pos % 3 * 30 as int)) as ref, unnest([alt, alt || repeat('C', cast(ctg % 60 as int)), '<DEL>']) as alt from v), o as (select * from w where alt not like '<%' and substr(alt, 2, 1) <> '>'),
  d as (select unnest(list_transform(generate_series(1, least(len(ref), len(alt))), lambda i: substr(ref, i, 1) || substr(alt, i, 1))) as p from o), x as (select len(alt) - len(ref) as n from o where len(alt) <> len(ref))
  select case when p in ('AG', 'GA', 'CT', 'TC') then 'ts' else 'tv' end as kind, count(*) as n from d where substr(p, 1, 1) <> substr(p, 2, 1) group by 1
  union all select case when n > 0 then 'ins' else 'del' end || case when abs(n) <= 1 then '1' when abs(n) <= 2 then '2' when abs(n) < 50 then '50' when abs(n) < 1000 then '1k' when abs(n) < 7000 then '7k' else 'inf' end, count(*) from x group by 1""")
def vcf_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions, and insertions and deletions by length class, over all alleles."""
    v = variants(spark, sf_dir)
    ref = F.concat("ref", F.expr("repeat('A', cast(pos % 3 * 30 as int))"))
    return A.variant_stats(v.select(ref.alias("ref"), F.array("alt", F.concat("alt", F.expr("repeat('C', cast(ctg % 60 as int))")), F.lit("<DEL>")).alias("alt")))


GTS = """gt as (select case l_suppkey % 5 when 0 then 'chrX' when 1 then 'Y' when 2 then 'chr7' when 3 then '12' else 'un_3' end as chrom, l_partkey * 1000 as pos, repeat('A', cast(l_linenumber as int)) as ref,
  case l_partkey % 4 when 0 then './.' when 1 then '0/1' when 2 then '1/1' else '0/0' end as g1, case l_linenumber % 3 when 0 then './.' when 1 then '1/1' else '2/1' end as g2 from lineitem)"""


@query("vcf_pair", f"""with {GTS}, f as (select *, list_filter([case when g1 = './.' then 'GAP1' when g1[1] <> g1[3] then 'HET1' end, case when g2 = './.' then 'GAP2' when g2[1] <> g2[3] then 'HET2' end], lambda x: x is not null) as bad,
  case when chrom = 'chrX' and not (pos >= 0 and pos + len(ref) <= 900000) then 'GAP1' when chrom = 'Y' then 'GAP2' end as ok from gt where chrom <> 'un_3')
  select chrom, pos, case when len(bad) = 0 or (len(bad) = 1 and bad[1] = ok) then '.' else array_to_string(bad, ';') end as filter, (case when g1[1] = g1[3] then g1[1] else '.' end) || '|' || (case when g2[1] = g2[3] then g2[1] else '.' end) as genotype from f""")
def vcf_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two haplotypes' genotypes as one phased one, a male's X and Y apart."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    chrom = F.expr("case l_suppkey % 5 when 0 then 'chrX' when 1 then 'Y' when 2 then 'chr7' when 3 then '12' else 'un_3' end")
    g1 = F.expr("case l_partkey % 4 when 0 then './.' when 1 then '0/1' when 2 then '1/1' else '0/0' end")
    g2 = F.expr("case l_linenumber % 3 when 0 then './.' when 1 then '1/1' else '2/1' end")
    v = t.select(chrom.alias("chrom"), (F.col("l_partkey") * 1000).alias("pos"), F.expr("repeat('A', cast(l_linenumber as int))").alias("ref"), g1.alias("gt1"), g2.alias("gt2"))
    return A.phased_pairs(v, True, [(0, 900_000)])


@query("junc_eval", f"""with {KINDS_SQL}, m as (select tg.event_id, max(cast(abs(tg.st - ot.st) <= 600 and abs(tg.en - ot.en) <= 600 as int)) as hit from tg join ot on tg.ctg = ot.ctg and tg.st < ot.en and ot.st < tg.en group by 1)
  select count(*) as introns, count(*) filter (where hit is null) as novel, cast(coalesce(sum(hit), 0) as bigint) as correct from tg left join m using (event_id)""")
def junc_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted introns against known ones, with tolerance at both ends."""
    targets, others = _kinds(spark, sf_dir)
    return A.junction_stats(targets.withColumnRenamed("event_id", "id"), others, 600, BIN)


@query("cs_rates", """with c as (select cast(l_quantity as bigint) as same, l_linenumber % 4 as ins, l_suppkey % 3 as del from lineitem) select count(*) / sum(same + 1 + del) as p_sub, sum(ins) / sum(same + 1 + del) as p_ins, sum(del) / sum(same + 1 + del) as p_del from c""")
def cs_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates from difference strings."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    some = lambda sign, n, base: F.expr(f"case when {n} > 0 then '{sign}' || repeat('{base}', cast({n} as int)) else '' end")
    cs = F.concat(F.lit(":"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("*ag"), some("+", "l_linenumber % 4", "c"), some("-", "l_suppkey % 3", "t"))
    return A.difference_rates(t.select(cs.alias("cs")))


@query("aligner_profile", "select count(*) as tried, count(*) filter (where l_returnflag <> 'R') / count(*) as success, avg(cast(l_quantity as double)) filter (where l_returnflag <> 'R') as edits, avg(cast(l_linenumber as double)) filter (where l_returnflag <> 'R') as st_off, avg(cast(l_suppkey as double)) filter (where l_returnflag <> 'R') as en_off from lineitem")
def aligner_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return A.aligner_profile(t.select((F.col("l_returnflag") != "R").alias("ok"), F.col("l_quantity").alias("edits"), F.col("l_linenumber").alias("st_off"), F.col("l_suppkey").alias("en_off")))


@query("path_weight", "select l_suppkey as path, count(*) as edges, avg(cast(l_quantity as double)) as weight from lineitem group by 1")
def path_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.path_weight(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("path"), F.col("l_quantity").alias("n")))


@query("position_errors", """with o as (select l_suppkey as contig, l_partkey * 7 as pos, l_orderkey as truth, (l_partkey * 7 - l_orderkey) % 100000 as r from lineitem), n as (select *, case when r < 0 then r + 100000 else r end as o from o),
  f as (select *, first(o) over (partition by contig order by pos, truth) as f0 from n), d as (select contig, ((o - f0 + 50000) % 100000 + 100000) % 100000 - 50000 as d from f)
  select contig, count(*) as n, percentile_disc(0.25) within group (order by d) as q1, percentile_disc(0.5) within group (order by d) as median, percentile_disc(0.75) within group (order by d) as q3 from d group by contig""")
def position_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of placement errors on a circular genome."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return A.position_errors(t.select(F.col("l_suppkey").alias("contig"), (F.col("l_partkey") * 7).alias("pos"), F.col("l_orderkey").alias("truth")), 100_000)


@query("cigar_stats", """with c as (select l_orderkey as id, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint) as m, l_suppkey % 4 + 1 as x, l_partkey % 9 + 1 as i, l_linenumber + 1 as d, l_partkey % 2 as a from lineitem)
  select id, m + 5 as mlen, m + 5 + x + i + d - a as blen, 2 as gap_opens, x + a + i + d as edits, (x + 2) / (m + 5 + x + 2) as divergence from c""")
def cigar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, block lengths and differences from CIGARs."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lambda c: c.cast("bigint").cast("string")
    cigar = F.concat(n(F.col("l_quantity")), F.lit("="), n(F.col("l_suppkey") % 4 + 1), F.lit("X"), n(F.col("l_partkey") % 9 + 1), F.lit("I5="), n(F.col("l_linenumber") + 1), F.lit("D"))
    return A.cigar_stats(t.select(F.col("l_orderkey").alias("id"), cigar.alias("cigar"), (F.col("l_partkey") % 2).alias("n_ambi")))
