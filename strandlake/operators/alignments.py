"""Analytics over alignment, variant and gene tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S

#: Upper bounds of the indel length bins.
INDEL_BINS = (10, 50, 100, 300, 400)
TRANSITIONS = ("AG", "GA", "CT", "TC")


def select_hits(hits: DataFrame, most: int, ratio: float) -> DataFrame:
    """(q, id, score, rn): the best hit of each query and at most `most` others that reach ratio times its score."""
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rn", F.row_number().over(by_score)).withColumn("best", F.max("score").over(Window.partitionBy("q")))
    return ranked.where((F.col("rn") <= most + 1) & (F.col("score") >= ratio * F.col("best"))).drop("best")


def cumulative_accuracy(alignments: DataFrame) -> DataFrame:
    """alignments: mapq, wrong. One row a mapping quality, cumulated from the best down; the window runs over qualities only."""
    by = alignments.groupBy("mapq").agg(F.count("*").alias("n"), F.count_if(F.col("wrong")).alias("n_err"))
    w = Window.orderBy(F.desc("mapq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by.select("mapq", "n", "n_err", F.sum("n").over(w).alias("cum_n"), (F.sum("n_err").over(w) / F.sum("n").over(w)).alias("cum_err_rate"))


def _bin(n: Column) -> Column:
    out = F.lit(len(INDEL_BINS))
    for j in range(len(INDEL_BINS) - 1, -1, -1):
        out = F.when(n < INDEL_BINS[j], j).otherwise(out)
    return out


def indel_histogram(alignments: DataFrame) -> DataFrame:
    """alignments: cigar. Insertions and deletions counted by length bin."""
    ops = alignments.select(F.explode(F.filter(S.cigar_ops(F.col("cigar")), lambda o: o["op"].isin("I", "D"))).alias("o"))
    return ops.groupBy(F.col("o.op").alias("op"), _bin(F.col("o.len")).alias("bin")).agg(F.count("*").alias("n"))


def variant_counts(variants: DataFrame) -> DataFrame:
    """variants: ref, alt. Transitions, transversions, insertions, deletions."""
    ref, alt = F.col("ref"), F.col("alt")
    single = (F.length(ref) == 1) & (F.length(alt) == 1) & (ref != alt)
    ts = F.concat(ref, alt).isin(*TRANSITIONS)
    return variants.agg(F.count_if(single & ts).alias("ts"), F.count_if(single & ~ts).alias("tv"), F.count_if(F.length(alt) > F.length(ref)).alias("ins"), F.count_if(F.length(alt) < F.length(ref)).alias("del"))


def gene_classes(coverage: DataFrame, full: float) -> DataFrame:
    """coverage: gene, ctg, cov (percent). Genes by completeness of their best contig."""
    best = coverage.groupBy("gene").agg(F.max("cov").alias("best"), F.count_if(F.col("cov") >= full).alias("full"))
    name = F.when(F.col("full") == 1, "full_sgl").when(F.col("full") > 1, "full_dup").when(F.col("best") >= 50, "part50+").when(F.col("best") >= 10, "part10+").otherwise("part10-")
    return best.groupBy(name.alias("class")).agg(F.count("*").alias("n"))


def paf_stat(paf: DataFrame) -> DataFrame:
    """paf: qname, qstart, qend, nmatch, blen, mapq, tags (map with tp and cg). Mapped queries, primary and secondary hits, aligned bases."""
    primary = F.coalesce(F.col("tags")["tp"], F.lit("P")) != "S"
    return paf.agg(
        F.count_distinct(F.when(primary, F.col("qname"))).alias("mapped"),
        F.count_if(primary).alias("primary"),
        F.count_if(~primary).alias("secondary"),
        F.sum(F.when(primary, F.col("nmatch"))).alias("matches"),
        F.sum(F.when(primary, F.col("blen"))).alias("block"),
        F.sum(F.when(primary, F.col("qend") - F.col("qstart"))).alias("query_bases"),
    )


def liftover(paf: DataFrame, points: DataFrame) -> DataFrame:
    """Positions of queries on targets. paf: aln, qname, qstart, qend, strand, qlen, tname, tstart, cigar; points: qname, pos. Out: qname, pos, tname, tpos, aln; a point in an insertion goes to the base after it."""
    ops = F.transform(S.cigar_ops(F.col("cigar")), lambda o: o)
    blocks = paf.select("aln", "qname", "qstart", "qend", "strand", "tname", "tstart", F.posexplode(ops).alias("k", "o"))
    q = F.when(F.col("o.op").isin("M", "I", "=", "X"), F.col("o.len")).otherwise(0)
    r = F.when(F.col("o.op").isin("M", "D", "N", "=", "X"), F.col("o.len")).otherwise(0)
    before = Window.partitionBy("aln").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("q0", F.coalesce(F.sum(q).over(before), F.lit(0))).withColumn("r0", F.coalesce(F.sum(r).over(before), F.lit(0))).withColumn("qn", q).withColumn("rn", r).where("qn > 0")
    met = points.join(placed, "qname")
    at = F.when(F.col("strand") == "-", F.col("qend") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("qstart"))
    met = met.withColumn("at", at).where("at >= q0 and at < q0 + qn")
    tpos = F.col("tstart") + F.col("r0") + F.when(F.col("rn") > 0, F.col("at") - F.col("q0")).otherwise(0)
    return met.select("qname", "pos", "tname", tpos.alias("tpos"), "aln")


def call_variants(aligned: DataFrame) -> DataFrame:
    """aligned: tname, tstart, qname, mapq, cs. Substitutions, insertions and deletions with their place on the target."""
    pattern = F.lit(r"([:=*+\-~])([A-Za-z0-9]+)")
    ops = F.arrays_zip(F.regexp_extract_all("cs", pattern, F.lit(1)).alias("op"), F.regexp_extract_all("cs", pattern, F.lit(2)).alias("arg"))
    own = aligned.select("tname", "tstart", "qname", "mapq", F.posexplode(ops).alias("k", "o"))
    op, arg = F.col("o.op"), F.col("o.arg")
    step = F.when(op == ":", F.expr("try_cast(o.arg as int)")).when(op == "=", F.length(arg)).when(op == "*", 1).when(op == "-", F.length(arg)).otherwise(0)
    before = Window.partitionBy("tname", "qname", "tstart").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("st", F.col("tstart") + F.coalesce(F.sum(step).over(before), F.lit(0))).where(op.isin("*", "+", "-"))
    ref = F.when(op == "*", F.substring(arg, 1, 1)).when(op == "-", arg).otherwise("-")
    alt = F.when(op == "*", F.substring(arg, 2, 1)).when(op == "+", arg).otherwise("-")
    return placed.select("tname", "st", (F.col("st") + F.when(op == "+", 0).otherwise(F.length(ref))).alias("en"), ref.alias("ref"), alt.alias("alt"), "qname", "mapq")


def confident_calls(aligned: DataFrame, least_quality: int, least_block: int, width: int) -> DataFrame:
    """aligned: tname, tstart, tend, qname, mapq, blen, cs. Variants of alignments of some quality and length, where exactly one of these covers the target."""
    from .intervals import depth, overlap_join

    good = aligned.where((F.col("mapq") >= least_quality) & (F.col("blen") >= least_block))
    once = depth(good.select("tname", F.col("tstart").alias("st"), F.col("tend").alias("en")), ["tname"]).where("depth = 1").select("tname", "st", "en")
    found = call_variants(good)
    # an insertion has no base of its own on the target: it is covered where the base after it is
    spans = found.withColumn("own_en", F.col("en")).withColumn("en", F.greatest("en", F.col("st") + 1))
    met = overlap_join(spans, once, ["tname"], width).where("b_st <= st and en <= b_en")
    return met.select("tname", "st", F.col("own_en").alias("en"), "ref", "alt", "qname", "mapq")
