"""Queries that write a format to the shared folder and read it back, and queries over pairs of aligned reads, with their SQL."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import pairwise as P
from strandlake.functions import sequences as S
from strandlake.functions.extension import least_ops
from strandlake.operators import alignments as A
from strandlake.operators import archive, probes
from strandlake.operators import sketches as K
from strandlake.sources import converters, files

from .hit_queries import HITS, LINES, hits, lines
from .registry import query
from .sequence_queries import HASHES, KMER, LEAST, MINIMIZER_K, MINIMIZER_W, PAIRS_SQL, READS, _minimizer_sql, _sketch_sql, minimizer_index, reads
from .tables import materialize, new_path


def _written(rows: DataFrame, order: list[str], name: str) -> str:
    """Texts (column value) as files in the order of some columns."""
    path = new_path(rows.sparkSession, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)
    return path


DENSE = f"{READS}, d as (select row_number() over (order by read_id) - 1 as read_id, cast(read_id as varchar) as name, seq from reads where seq <> '')"


@query("fastq_roundtrip", f"with {DENSE} select read_id, name, seq, repeat('I', len(seq)) as qual from d")
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as records of four lines and back; their ids are their places in the files."""
    own = reads(spark, sf_dir).where("seq <> ''")
    text = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" about\n"), F.col("seq"), F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
    return files.fastq(spark, _written(own.withColumn("value", text), ["read_id"], "fastq"))


@query("fasta_roundtrip", f"with {DENSE} select read_id as record, name, 'length ' || len(seq) as comment, seq from d")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in wrapped lines and back."""
    own = reads(spark, sf_dir).where("seq <> ''")
    text = F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" length "), F.length("seq").cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{1,70})(?=.)", "$1\n"))
    return files.fasta(spark, _written(own.withColumn("value", text), ["read_id"], "fasta"))


@query("simulated_roundtrip", f"with {DENSE} select read_id, read_id % 2 = 1 as is_rc, read_id * 17 as pos, 'u' || len(seq) as edit_string, seq from d")
def simulated_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated reads with strand, place and edits, and back."""
    # ids by the order of the file: numbered from the table's own dictionary
    own = reads(spark, sf_dir).where("seq <> ''")
    ids = archive.dictionary(own, "read_id")
    numbered = own.join(ids, "read_id")
    text = F.concat(F.when(F.col("id") % 2 == 1, "c").otherwise("n"), F.lit(":"), (F.col("id") * 17).cast("string"), F.lit(":u"), F.length("seq").cast("string"), F.lit("\n"), F.col("seq"))
    return files.simulated(spark, _written(numbered.withColumn("value", text), ["id"], "simulated"))


@query("ordered_reads", f"with {DENSE} select read_id as line_no, seq as value from d")
def ordered_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read a line, in the order of their ids over all files."""
    path = new_path(spark, "ordered")
    files.write_reads(reads(spark, sf_dir).where("seq <> ''"), path)
    return files.numbered_lines(spark, path)


def _paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir)
    i = lambda c: c.cast("int")
    tags = F.create_map(F.lit("NM"), (F.col("n") + 1).cast("string"), F.lit("tp"), F.when(F.col("n") > 5, "P").otherwise("S"))
    return h.select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("qname"), i(F.lit(9000)).alias("qlen"), i(F.col("qs")).alias("qstart"), i(F.col("qe")).alias("qend"), F.when(F.col("rev") == 1, "-").otherwise("+").alias("strand"), F.concat(F.lit("t"), F.col("t").cast("string")).alias("tname"), i(F.lit(8000)).alias("tlen"), i(F.col("ts")).alias("tstart"), i(F.col("te")).alias("tend"), i(F.col("n") * 10).alias("nmatch"), i(F.col("te") - F.col("ts")).alias("blen"), i(F.col("mapq")).alias("mapq"), tags.alias("tags"))


PAF_SQL = HITS + ", pf as (select 'q' || q as qname, qs as qstart, qe as qend, case when rev = 1 then '-' else '+' end as strand, 't' || t as tname, ts as tstart, te as tend, n * 10 as nmatch, te - ts as blen, mapq, n + 1 as nm, case when n > 5 then 'P' else 'S' end as tp from h)"


@query("paf_roundtrip", f"with {PAF_SQL} select qname, qstart, qend, strand, tname, tstart, tend, nmatch, blen, mapq, cast(nm as varchar) as nm, tp from pf")
def paf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the columns of PAF with tags, and back."""
    path = new_path(spark, "paf")
    files.write_paf(_paf(spark, sf_dir), path)
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return files.paf(spark, path).select("qname", "qstart", "qend", "strand", "tname", "tstart", "tend", "nmatch", "blen", "mapq", tag("NM").alias("nm"), tag("tp").alias("tp"))


@query("paf_stat", f"with {PAF_SQL} select count(distinct qname) filter (where tp = 'P') as mapped, count(*) filter (where tp = 'P') as primary_hits, count(*) filter (where tp = 'S') as secondary, cast(sum(nmatch) filter (where tp = 'P') as bigint) as matches, cast(sum(blen) filter (where tp = 'P') as bigint) as block, cast(sum(qend - qstart) filter (where tp = 'P') as bigint) as query_bases from pf")
def paf_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped queries and aligned bases of primary hits."""
    return A.paf_stat(_paf(spark, sf_dir)).withColumnRenamed("primary", "primary_hits")


@query("bed_introns", "with " + LINES + ", f as (select 'c' || l_suppkey % 5 as ctg, l_orderkey * 1000 + l_linenumber as name, l_partkey as st, cast(l_quantity as int) + 1 as a, l_linenumber * 7 as gap from li) select ctg, cast(name as varchar) as name, cast(st + a as int) as st, cast(st + a + gap as int) as en from f")
def bed_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of twelve-column annotations written, read, and the introns between them."""
    t = lines(spark, sf_dir)
    a, gap, st = F.col("l_quantity").cast("int") + 1, F.col("l_linenumber") * 7, F.col("l_partkey")
    s = lambda c: c.cast("string")
    name = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    text = F.concat_ws("\t", F.concat(F.lit("c"), s(F.col("l_suppkey") % 5)), s(st), s(st + a + gap + 20), s(name), F.lit("0"), F.lit("+"), s(st), s(st), F.lit("0"), F.lit("2"), F.concat(s(a), F.lit(",20,")), F.concat(F.lit("0,"), s(a + gap), F.lit(",")))
    path = _written(t.withColumn("value", text), ["l_orderkey"], "bed12")
    return files.bed12_introns(spark, path).select("ctg", "name", "st", "en")


@query("vcf_roundtrip", "with " + LINES + ", v as (select 'c' || l_suppkey % 5 as chrom, l_partkey as pos, l_orderkey as o, l_linenumber as n from li) select chrom, cast(pos as int) as pos, cast(o as varchar) as id, 'A' as ref, 2 as alleles, cast(n as double) as qual, '0|' || n as sample from v")
def vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with two alleles and a sample, and back."""
    t = lines(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    text = F.concat_ws("\t", F.concat(F.lit("c"), (F.col("l_suppkey") % 5).cast("string")), s("l_partkey"), s("l_orderkey"), F.lit("A"), F.lit("G,AT"), s("l_linenumber"), F.lit("."), F.lit("."), F.lit("GT"), F.concat(F.lit("0|"), s("l_linenumber")))
    path = _written(t.withColumn("value", text), ["l_orderkey"], "vcf")
    return files.vcf(spark, path).select("chrom", "pos", "id", "ref", F.size("alt").alias("alleles"), "qual", F.col("samples")[0].alias("sample"))


@query("index_roundtrip", f"with {_minimizer_sql()} select read_id, pos, strand, minimizer from mins")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index stored by value in buckets, and loaded."""
    path = new_path(spark, "stored-index")
    archive.save_index(minimizer_index(spark, sf_dir), path, 8, k=MINIMIZER_K, w=MINIMIZER_W)
    return archive.load_index(spark, path)[0].select("read_id", "pos", "strand", "minimizer")


LIFT = "with " + LINES + """, p as (select l_orderkey * 10 + l_linenumber as aln, l_orderkey as q, 100 * l_linenumber as qs, cast(l_quantity as bigint) as a, l_partkey % 5 + 1 as i, l_suppkey % 7 + 1 as d, l_partkey as ts from li)"""


@query("liftover", LIFT + """, x as (select q, aln, o, qs + o as pos, case when o < a then ts + o when o < a + i then ts + a else ts + a + d + (o - a - i) end as tpos from p, (select unnest([0, 3, 30, 52]) as o) where o < a + i + 10)
  select q, pos, tpos, aln from x""")
def liftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on queries carried over to targets through CIGARs of a match, an insertion, a deletion and a match."""
    t = lines(spark, sf_dir)
    a, i, d, line = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 5 + 1, F.col("l_suppkey") % 7 + 1, F.col("l_linenumber").cast("bigint")
    s = lambda c: c.cast("string")
    # a query of its own for each alignment, so that points meet one of them
    rows = t.select((F.col("l_orderkey") * 10 + line).alias("aln"), F.col("l_orderkey").alias("q"), (100 * line).alias("qstart"), (100 * line + a + i + 10).alias("qend"), F.lit("+").alias("strand"), F.lit("t").alias("tname"), F.col("l_partkey").alias("tstart"), F.concat(s(a), F.lit("M"), s(i), F.lit("I"), s(d), F.lit("D10M")).alias("cigar")).withColumn("qname", F.col("aln"))
    points = rows.select("qname", F.explode(F.array(*[F.lit(x) for x in (0, 3, 30, 52)])).alias("o"), "qstart", "qend").where(F.col("qstart") + F.col("o") < F.col("qend")).select("qname", (F.col("qstart") + F.col("o")).alias("pos"))
    return A.liftover(rows, points).join(rows.select("aln", "q"), "aln").select("q", "pos", "tpos", "aln")


CALLS = "with " + LINES + """, c as (select l_orderkey * 10 + l_linenumber as q, l_partkey as ts, cast(l_quantity as bigint) as a, l_linenumber as n, l_suppkey % 61 as mapq from li)"""


@query("call_variants", CALLS + """ select q, ts + a as st, ts + a + 1 as en, 'a' as ref, 'g' as alt, mapq from c union all select q, ts + a + 4, ts + a + 4, '-', repeat('c', cast(n as int)), mapq from c union all select q, ts + a + 4, ts + a + 6, 'tt', '-', mapq from c""")
def call_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of difference strings, at their places on the target."""
    t = lines(spark, sf_dir)
    cs = F.concat(F.lit(":"), F.col("l_quantity").cast("bigint").cast("string"), F.lit("*ag:3+"), F.expr("repeat('c', cast(l_linenumber as int))"), F.lit("-tt:9"))
    rows = t.select(F.lit("t").alias("tname"), F.col("l_partkey").alias("tstart"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qname"), (F.col("l_suppkey") % 61).alias("mapq"), cs.alias("cs"))
    return A.call_variants(rows).select(F.col("qname").alias("q"), "st", "en", "ref", "alt", "mapq")


@query("confident_calls", CALLS + """, o as (select q // 10 as t, ts as st, ts + a + 15 as en from c where mapq >= 20), e as (select t, st as pos, 1 as d from o union all select t, en, -1 from o), s as (select t, pos, sum(d) as d from e group by t, pos),
  dp as (select t, pos as st, lead(pos) over (partition by t order by pos) as en, sum(d) over (partition by t order by pos rows unbounded preceding) as depth from s), v as (select q, ts + a as st from c where mapq >= 20)
  select v.q, v.st from v join dp on dp.t = v.q // 10 and dp.depth = 1 and dp.st <= v.st and v.st < dp.en""")
def confident_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions of well mapped alignments where exactly one covers the target."""
    t = lines(spark, sf_dir)
    a = F.col("l_quantity").cast("bigint")
    cs = F.concat(F.lit(":"), a.cast("string"), F.lit("*ag:14"))
    rows = t.select(F.col("l_orderkey").alias("tname"), F.col("l_partkey").alias("tstart"), (F.col("l_partkey") + a + 15).alias("tend"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qname"), (F.col("l_suppkey") % 61).alias("mapq"), (a + 15).alias("blen"), cs.alias("cs"))
    return A.confident_calls(rows, 20, 0, 256).select(F.col("qname").alias("q"), "st")


#: Runs of one operation.
RUNS = re.compile(r"(.)\1*", re.S)


def _replays(a: int, b: int, x: list[str | None], y: list[str | None]) -> list[tuple]:
    """A row for each text of a and of b; of repeated ids one may have none."""
    return [(a, b, *(replayed(p, q) if p is not None and q is not None else (q, p, True, None))) for p in x for q in y]


def replayed(x: str, y: str) -> tuple[str, str, bool, int]:
    """Two reads aligned base by base with the least number of edits: the target from CIGAR and MD, the query from CIGAR, whether the CIGAR survives its merged form, and the edits."""
    return _replayed(x, y) if len(x) + len(y) <= 4_000 else _replayed.__wrapped__(x, y)


@lru_cache(10_000)
def _replayed(x: str, y: str) -> tuple[str, str, bool, int]:
    ops = least_ops(x, y)
    cigar = "".join([f"{run.end() - run.start()}{run[1]}" for run in RUNS.finditer(ops)])
    return P.target_of_md(cigar, P.md_tag(cigar, x, y), x), "".join(q for _, q, _ in P.walk(cigar, x, y)), P.eqx(P.merged(cigar), x, y) == cigar, len(ops) - ops.count("=")


@query("align_replay", f"with {_sketch_sql(KMER, HASHES)}, {PAIRS_SQL} select a, b, y.seq as target, x.seq as query, true as same, levenshtein(x.seq, y.seq) as edits from pairs join reads x on x.read_id = a join reads y on y.read_id = b")
def align_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping reads aligned base by base: the target from CIGAR and MD, the query from CIGAR, and the least number of edits."""
    own = reads(spark, sf_dir)
    lists = probes.by_read(K.minhash(own, KMER, HASHES), "sketch-lists", probes.texts_of(own))
    return probes.sketch_pair_texts(lists, LEAST, _replays, "a bigint, b bigint, target string, query string, same boolean, edits bigint")


SAMS = "with " + LINES + """, s as (select l_orderkey * 10 + l_linenumber as id, l_suppkey % 4 as t, l_partkey as ts, cast(l_quantity as bigint) as a, l_partkey % 5 + 1 as i, l_suppkey % 7 + 1 as d, l_linenumber % 2 as rev, l_suppkey % 61 as mapq, l_linenumber % 3 as nm from li)"""


@query("sam2paf", SAMS + """ select cast(id as varchar) as qname, a + i + 18 as qlen, case when rev = 1 then 3 else 5 end as qstart, case when rev = 1 then 3 else 5 end + a + i + 10 as qend, case when rev = 1 then '-' else '+' end as strand,
  't' || t as tname, 5000 + t as tlen, ts as tstart, ts + a + d + 10 as tend, a + i + d + 10 - nm as nmatch, a + i + d + 10 as blen, mapq, a || 'M' || i || 'I' || d || 'D10M' as cigar from s""")
def sam2paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as SAM, read with the lengths of their header, as PAF."""
    t = lines(spark, sf_dir)
    s = lambda c: c.cast("string")
    a, i, d = F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 5 + 1, F.col("l_suppkey") % 7 + 1
    cigar = F.concat(F.lit("5S"), s(a), F.lit("M"), s(i), F.lit("I"), s(d), F.lit("D10M3H"))
    row = F.concat_ws("\t", s(F.col("l_orderkey") * 10 + F.col("l_linenumber")), s(F.col("l_linenumber") % 2 * 16), F.concat(F.lit("t"), s(F.col("l_suppkey") % 4)), s(F.col("l_partkey") + 1), s(F.col("l_suppkey") % 61), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), s(F.col("l_linenumber") % 3)))
    head = spark.range(4).select(F.concat(F.lit("@SQ\tSN:t"), s(F.col("id")), F.lit("\tLN:"), s(F.col("id") + 5000)).alias("value"))
    path = new_path(spark, "sam")
    t.select(row.alias("value")).unionByName(head).write.text(path)
    rows, lengths = files.sam(spark, path)
    return converters.sam_to_paf(rows, lengths).drop("tp")


@query("gff2bed", "with " + LINES + """, e as (select distinct 'c' || l_orderkey % 3 as ctg, 'tx' || l_orderkey as name, case when l_orderkey % 2 = 1 then '-' else '+' end as strand, l_linenumber * 100 as st, l_linenumber * 100 + cast(l_quantity as bigint) as en from li)
  select ctg, min(st) as st, max(en) as en, name, 1000 as score, strand, count(*) as n_blocks, string_agg(cast(en - st as varchar), ',' order by st, en) || ',' as sizes, string_agg(cast(st - lo as varchar), ',' order by st, en) || ',' as starts
  from (select *, min(st) over (partition by ctg, name, strand) as lo from e) group by ctg, name, strand""")
def gff2bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of annotation rows as a row of blocks a transcript."""
    t = lines(spark, sf_dir)
    s = lambda c: c.cast("string")
    st = F.col("l_linenumber") * 100
    row = F.concat_ws("\t", F.concat(F.lit("c"), s(F.col("l_orderkey") % 3)), F.lit("src"), F.lit("exon"), s(st + 1), s(st + F.col("l_quantity").cast("bigint")), F.lit("."), F.when(F.col("l_orderkey") % 2 == 1, "-").otherwise("+"), F.lit("."), F.concat(F.lit('gene_id "g"; transcript_id "tx'), s(F.col("l_orderkey")), F.lit('";')))
    path = _written(t.withColumn("value", row), ["l_orderkey"], "gtf")
    return converters.annotations_to_bed(converters.annotations(spark, path))


@query("interleaved_mates", f"with {DENSE} select read_id, m as mate, name || '/' || (m + 1) as name, case when m = 0 then seq else translate(reverse(seq), 'ACGT', 'TGCA') end as seq from d, (select unnest([0, 1]) as m)")
def interleaved_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of mates read in turn."""
    own = reads(spark, sf_dir).where("seq <> ''")
    paths = []
    for k, seq in enumerate((F.col("seq"), S.reverse_complement(F.col("seq")))):
        text = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(f"/{k + 1}\n"), seq, F.lit("\n+\n"), F.expr("repeat('I', length(seq))"))
        path = new_path(spark, f"mates-{k}") + ".fastq"
        own.withColumn("value", text).repartitionByRange("read_id").sortWithinPartitions("read_id").select("value").write.text(path)
        paths.append(path)
    return files.interleaved(spark, paths)


@query("mini_batches", f"with {DENSE}, b as (select *, coalesce(sum(len(seq)) over (order by read_id rows between unbounded preceding and 1 preceding), 0) as before from d) select read_id, name, seq, cast(before // 50000 as bigint) as batch from b")
def mini_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads dealt into batches of a number of bases, in order."""
    return files.mini_batches(ordered(spark, sf_dir), 50_000, block=100)


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with dense ids in order of their own."""
    own = reads(spark, sf_dir).where("seq <> ''")
    return own.join(archive.dictionary(own, "read_id"), "read_id").select(F.col("id").alias("read_id"), F.col("read_id").cast("string").alias("name"), "seq")


@query("unmapped_rows", f"with {PAF_SQL}, a as (select qname from pf union all select 'x' || q from h where id = 1) select qname, count(*) as n from a group by qname")
def unmapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and a row for each query without one."""
    own = _paf(spark, sf_dir)
    lost = hits(spark, sf_dir).where("id = 1").select(F.concat(F.lit("x"), F.col("q").cast("string")).alias("qname"), F.lit(9000).alias("qlen"))
    every = files.with_unmapped(own, own.select("qname", "qlen").distinct().unionByName(lost))
    return every.groupBy("qname").agg(F.count("*").alias("n"))
