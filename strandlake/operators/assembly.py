"""Statistics of assemblies, genes, junctions and variants over tables of alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S

from .intervals import depth, merged, overlap_join

#: Upper bounds of the length classes of insertions and deletions, and their names.
LENGTH_CLASSES = ((1, "1"), (2, "2"), (49, "50"), (999, "1k"), (6999, "7k"))
TRANSITIONS = ("AG", "GA", "CT", "TC")
#: A gap between two alignments of a query that don't follow each other on one target and strand.
FAR = 1_000_000_000


def ngx(lengths: DataFrame, total: int | None, shares: list[float], length: str = "len") -> DataFrame:
    """(share, n): for each share the length at which the longest ones first pass it of `total` (all of them, if none). The running sum is over distinct lengths."""
    by = lengths.groupBy(F.col(length).alias("len")).agg(F.sum(length).alias("bases"))
    order = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = by.withColumn("cum", F.sum("bases").over(order)).withColumn("total", F.sum("bases").over(Window.partitionBy()) if total is None else F.lit(total))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return cum.select("len", "cum", "total", asked).groupBy("share").agg(F.max(F.when(F.col("cum") > F.col("share") * F.col("total"), F.col("len"))).alias("n"))


def area_under(lengths: DataFrame, total: int | None, length: str = "len") -> DataFrame:
    """One row, area: of the Nx curve up to `total` bases; what goes beyond is cut."""
    by = lengths.groupBy(F.col(length).alias("len")).agg(F.sum(length).alias("bases"), F.count("*").alias("n"))
    order = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    t = F.sum("bases").over(Window.partitionBy()) if total is None else F.lit(total)
    cum = by.withColumn("before", F.coalesce(F.sum("bases").over(order), F.lit(0))).withColumn("total", t)
    room = F.greatest(F.col("total") - F.col("before"), F.lit(0))
    whole = F.least(F.floor(room / F.col("len")), F.col("n"))
    rest = F.when(whole < F.col("n"), room - whole * F.col("len")).otherwise(0)
    x = F.col("len").cast("double")
    return cum.agg(F.sum((whole * x * x + rest.cast("double") * rest) / F.col("total")).alias("area"))


def query_blocks(paf: DataFrame) -> DataFrame:
    """paf: q, qs, qe, strand, t, ts, te. Blocks of queries in order without those inside the one before: blen (what a block adds), flank and gap to the block before it."""
    order = Window.partitionBy("q").orderBy("qs", "qe", "ts", "te")
    last_end = F.lag("qe").over(order)
    kept = paf.withColumn("last", last_end).where(F.col("last").isNull() | (F.col("qs") >= F.col("last")) | (F.col("qe") >= F.col("last")))
    sized = kept.withColumn("blen", F.col("qe") - F.greatest("qs", F.coalesce("last", "qs")))
    before = {c: F.lag(c).over(order) for c in ("t", "strand", "qe", "ts", "te", "blen")}
    on_query = F.col("qs") - before["qe"]
    on_target = F.when(F.col("strand") == "+", F.col("ts") - before["te"]).otherwise(before["ts"] - F.col("te"))
    same = (before["t"] == F.col("t")) & (before["strand"] == F.col("strand"))
    gap = F.when(before["qe"].isNull(), F.lit(None)).when(same, F.abs(on_query - on_target)).otherwise(FAR)
    return sized.select("q", "qs", "qe", "blen", gap.alias("gap"))


def assembly_stats(paf: DataFrame, contigs: DataFrame, reference: int, least: int = 500) -> DataFrame:
    """contigs: q, qlen; paf: q, qs, qe, strand, t, ts, te of primary hits; one row: length, ref_cov, ref_dup (percent covered more than once), query_cov, ng75, ng50, nga50, aunga, breaks, breaks_long, breaks_far."""
    hits = paf.where(F.col("qe") - F.col("qs") >= least)
    blocks = query_blocks(hits)
    covered = merged(hits.select("t", F.col("ts").alias("st"), F.col("te").alias("en")), ["t"]).agg(F.sum(F.col("en") - F.col("st")).alias("l_cov"))
    once = depth(hits.select("t", F.col("ts").alias("st"), F.col("te").alias("en")), ["t"]).where("depth = 1").agg(F.sum(F.col("en") - F.col("st")).alias("l_once"))
    on_query = merged(hits.select("q", F.col("qs").alias("st"), F.col("qe").alias("en")), ["q"]).agg(F.sum(F.col("en") - F.col("st")).alias("q_cov"))
    size = contigs.agg(F.sum("qlen").alias("length"))
    ng = ngx(contigs, reference, [0.75, 0.5], "qlen").agg(F.max(F.when(F.col("share") == 0.75, F.col("n"))).alias("ng75"), F.max(F.when(F.col("share") == 0.5, F.col("n"))).alias("ng50"))
    nga = ngx(blocks, reference, [0.5], "blen").select(F.col("n").alias("nga50"))
    area = area_under(blocks, reference, "blen").select(F.round("area").cast("bigint").alias("aunga"))
    per = paf.groupBy("q").agg((F.count("*") - 1).alias("b")).agg(F.sum("b").alias("breaks"))
    bp = blocks.agg(F.count_if((F.col("blen") >= least) & (F.col("gap") >= 0)).alias("breaks_long"), F.count_if((F.col("blen") >= least) & (F.col("gap") >= 10_000)).alias("breaks_far"))
    row = size
    for other in (covered, once, on_query, ng, nga, area, per, bp):
        row = row.crossJoin(other)  # tables of one row each
    return row.select("length", "l_cov", (F.col("l_cov") / reference).alias("ref_cov"), ((F.col("l_cov") - F.col("l_once")) / F.col("l_cov")).alias("ref_dup"), (F.col("q_cov") / F.col("length")).alias("query_cov"), "ng75", "ng50", "nga50", "aunga", "breaks", "breaks_long", "breaks_far")


def gene_coverage(hits: DataFrame, identity: float, coverage: float) -> DataFrame:
    """hits: asm, gene, qlen, qs, qe, mlen, blen. (asm, gene, full, share, n): hits that are like enough, those that hold the gene whole, and the share of it that all cover (gaps between islands are left out)."""
    good = hits.where(F.col("mlen") >= F.col("blen") * identity)
    counts = good.groupBy("asm", "gene").agg(F.count_if(F.col("qe") - F.col("qs") >= F.col("qlen") * coverage).alias("full"), F.count("*").alias("n"), F.max("qlen").alias("qlen"))
    islands = merged(good.select("asm", "gene", F.col("qs").alias("st"), F.col("qe").alias("en")), ["asm", "gene"]).groupBy("asm", "gene").agg(F.sum(F.col("en") - F.col("st")).alias("cov"))
    return counts.join(islands, ["asm", "gene"]).select("asm", "gene", "full", (F.col("cov") / F.col("qlen")).alias("share"), "n")


def gene_matrix(hits: DataFrame, reference: str, identity: float = 0.99, coverage: float = 0.99) -> DataFrame:
    """(asm, class, n): genes that the reference holds once, by how an assembly holds them, and copies of those it holds several times (dup_cnt, dup_sum)."""
    own = gene_coverage(hits, identity, coverage)
    base = own.where(F.col("asm") == reference).select("gene", F.col("full").alias("ref_full"))
    assemblies = hits.select("asm").distinct()
    # one row a gene and assembly, missing ones included; assemblies are few
    every = base.crossJoin(F.broadcast(assemblies)).join(own, ["asm", "gene"], "left")
    name = F.when(F.col("full").isNull(), "part10-").when(F.col("full") == 1, "full_sgl").when(F.col("full") > 1, "full_dup").when(F.col("share") >= coverage, "frag").when(F.col("share") >= 0.5, "part50+").when(F.col("share") >= 0.1, "part10+").otherwise("part10-")
    single = every.where("ref_full = 1").groupBy("asm", name.alias("class")).agg(F.count("*").alias("n"))
    many = every.where("ref_full > 1")
    twice = many.groupBy("asm").agg(F.count_if(F.col("full") > 1).alias("n")).select("asm", F.lit("dup_cnt").alias("class"), "n")
    copies = many.groupBy("asm").agg(F.coalesce(F.sum("full"), F.lit(0)).cast("bigint").alias("n")).select("asm", F.lit("dup_sum").alias("class"), "n")
    return single.unionByName(twice).unionByName(copies)


def _length_class(n: Column) -> Column:
    out = F.lit("inf")
    for most, name in reversed(LENGTH_CLASSES):
        out = F.when(n <= most, name).otherwise(out)
    return out


def variant_stats(variants: DataFrame) -> DataFrame:
    """variants: ref, alt (array). (kind, n): transitions and transversions of equal places, insertions and deletions by length class; symbolic alleles are skipped."""
    one = variants.select("ref", F.explode("alt").alias("alt")).where(~F.col("alt").startswith("<") & (F.substring("alt", 2, 1) != ">"))
    places = F.sequence(F.lit(1), F.least(F.length("ref"), F.length("alt")))
    pair = F.transform(F.when(F.least(F.length("ref"), F.length("alt")) > 0, places).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substr("ref", i, F.lit(1)), F.substr("alt", i, F.lit(1))))
    differ = one.select(F.explode(pair).alias("p")).where(F.substring("p", 1, 1) != F.substring("p", 2, 1))
    subs = differ.groupBy(F.when(F.col("p").isin(*TRANSITIONS), "ts").otherwise("tv").alias("kind")).agg(F.count("*").alias("n"))
    d = F.length("alt") - F.length("ref")
    indels = one.where(d != 0).groupBy(F.concat(F.when(d > 0, "ins").otherwise("del"), _length_class(F.abs(d))).alias("kind")).agg(F.count("*").alias("n"))
    return subs.unionByName(indels)


def phased_pairs(variants: DataFrame, male: bool, regions: list[tuple[int, int]]) -> DataFrame:
    """variants: chrom, pos, ref, gt1, gt2 (such as 0/1) of two haplotypes. filter and phased genotype; on a male's X outside `regions`, and on Y, the missing haplotype is no fault."""
    parts = lambda c: (F.split(c, "/")[0], F.split(c, "/")[1])
    columns, faults = [], []
    for j, c in ((1, "gt1"), (2, "gt2")):
        a, b = parts(c)
        faults.append(F.when(a == ".", f"GAP{j}").when(a != b, f"HET{j}"))
        columns.append(F.when(a == b, a).otherwise("."))
    found = F.filter(F.array(*faults), lambda x: x.isNotNull())
    inside = F.lit(False)
    for st, en in regions:
        inside = inside | ((F.col("pos") >= st) & (F.col("pos") + F.length("ref") <= en))
    x, y = F.col("chrom").rlike("^(chr)?X"), F.col("chrom").rlike("^(chr)?Y")
    excused = F.when(x & ~inside, "GAP1").when(y, "GAP2") if male else F.lit(None).cast("string")
    clean = F.when((F.size(found) == 1) & (found[0] == excused), F.array().cast("array<string>")).otherwise(found)
    known = F.col("chrom").rlike("^(chr)?([0-9]+|X|Y)$" if male else "^(chr)?([0-9]+|X)$")
    return variants.where(known).select("chrom", "pos", F.when(F.size(clean) > 0, F.array_join(clean, ";")).otherwise(".").alias("filter"), F.concat_ws("|", *columns).alias("genotype"))


def junction_stats(introns: DataFrame, known: DataFrame, fuzz: int, width: int) -> DataFrame:
    """introns: id, ctg, st, en; known: ctg, st, en. One row: predicted introns, those that no known one overlaps, those that one matches at both ends."""
    own = introns.select("id", "ctg", "st", "en")
    met = overlap_join(own, known.select("ctg", "st", "en"), ["ctg"], width)
    near = (F.abs(F.col("st") - F.col("b_st")) <= fuzz) & (F.abs(F.col("en") - F.col("b_en")) <= fuzz)
    hit = met.groupBy("id").agg(F.max(near.cast("int")).alias("hit"))
    return own.join(hit, "id", "left").agg(F.count("*").alias("introns"), F.count_if(F.col("hit").isNull()).alias("novel"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("correct"))


def difference_rates(alignments: DataFrame) -> DataFrame:
    """alignments: cs. One row: rates of substituted, inserted and deleted bases to bases of the target that are aligned."""
    pattern = F.lit(r"([:*+-])([A-Za-z0-9]+)")
    ops = alignments.select(F.explode(F.arrays_zip(F.regexp_extract_all("cs", pattern, F.lit(1)).alias("op"), F.regexp_extract_all("cs", pattern, F.lit(2)).alias("arg"))).alias("o")).select("o.op", "o.arg")
    n = lambda op, size: F.coalesce(F.sum(F.when(F.col("op") == op, size)), F.lit(0))
    same, sub, ins, gone = n(":", F.col("arg").try_cast("bigint")), n("*", F.lit(1)), n("+", F.length("arg")), n("-", F.length("arg"))
    return ops.agg((sub / (same + sub + gone)).alias("p_sub"), (ins / (same + sub + gone)).alias("p_ins"), (gone / (same + sub + gone)).alias("p_del"))


def aligner_profile(tried: DataFrame) -> DataFrame:
    """tried: ok, edits, st_off, en_off. One row: share of successes, and means over them."""
    mean = lambda c: F.avg(F.when(F.col("ok"), F.col(c).cast("double")))
    return tried.agg(F.count("*").alias("tried"), (F.count_if(F.col("ok")) / F.count("*")).alias("success"), mean("edits").alias("edits"), mean("st_off").alias("st_off"), mean("en_off").alias("en_off"))


def path_weight(edges: DataFrame) -> DataFrame:
    """edges: path, n. Edges of each path and their mean weight."""
    return edges.groupBy("path").agg(F.count("*").alias("edges"), F.avg(F.col("n").cast("double")).alias("weight"))


def position_errors(placed: DataFrame, genome: int) -> DataFrame:
    """placed: contig, pos, truth, on a circle of `genome` bases. Quartiles of the offsets from the contig's first one: (contig, n, q1, median, q3)."""
    offset = F.pmod(F.col("pos") - F.col("truth"), F.lit(genome))
    order = Window.partitionBy("contig").orderBy("pos", "truth")
    turned = placed.withColumn("o", offset).withColumn("first", F.first("o").over(order)).withColumn("d", F.pmod(F.col("o") - F.col("first") + genome // 2, F.lit(genome)) - genome // 2)
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by d)").cast("bigint")
    return turned.groupBy("contig").agg(F.count("*").alias("n"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def cigar_stats(aligned: DataFrame) -> DataFrame:
    """aligned: id, cigar of =, X, I, D, and n_ambi. Matches, block length, gap openings, and differences counted by gap."""
    ops = S.cigar_ops(F.col("cigar"))
    opens = F.size(F.filter(ops, lambda o: o["op"].isin("I", "D"))).cast("bigint")
    gaps, block, same = S.cigar_sum(ops, "ID"), S.cigar_sum(ops, "=XID"), S.cigar_sum(ops, "=")
    return aligned.select("id", same.alias("mlen"), (block - F.col("n_ambi")).alias("blen"), opens.alias("gap_opens"), (S.cigar_sum(ops, "X") + F.col("n_ambi") + gaps).alias("edits"), ((block - gaps - same + opens) / (block - gaps + opens)).alias("divergence"))
