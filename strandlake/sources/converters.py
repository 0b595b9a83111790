"""Conversions between alignment, annotation and read formats; all are DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S

from .files import numbered_lines


def _sections(lines: DataFrame, head: Column, name: str) -> DataFrame:
    """Lines that follow a heading, with it and its number. Headings are numbered alone; lines find theirs by range."""
    order = Window.orderBy("line_no")
    heads = lines.where(head).select(F.col("line_no").alias(name), F.coalesce(F.lead("line_no").over(order), F.lit(1 << 62)).alias("until"), F.col("value").alias(f"{name}_line"))
    return lines.where(~head).join(heads, (F.col("line_no") > F.col(name)) & (F.col("line_no") < F.col("until"))).drop("until")


def delta_to_paf(spark: SparkSession, path: str) -> DataFrame:
    """Whole-genome alignment deltas as PAF rows. A positive step ends with a base of the target alone, a negative one with a base of the query alone."""
    lines = numbered_lines(spark, path)
    pairs = _sections(lines, F.col("value").startswith(">"), "pair")
    f = F.split("value", " ")
    is_head = F.size(f) == 7
    order = Window.partitionBy("pair").orderBy("line_no")
    placed = pairs.withColumn("aln", F.sum(is_head.cast("int")).over(order)).where("aln > 0")
    n = F.expr("try_cast(value as int)")
    steps = F.transform(F.array_sort(F.collect_list(F.when(~is_head & (n != 0), F.struct("line_no", n.alias("n"))))), lambda x: x["n"])
    own = placed.groupBy("pair", "pair_line", "aln").agg(F.max(F.when(is_head, F.col("value"))).alias("at"), steps.alias("steps"))
    p, a = F.split(F.substr("pair_line", F.lit(2)), r"\s+"), F.transform(F.split("at", " "), lambda x: x.cast("int"))
    rows = own.select(p[1].alias("qname"), p[3].cast("int").alias("qlen"), p[0].alias("tname"), p[2].cast("int").alias("tlen"), a.alias("a"), "steps")
    rows = rows.select("qname", "qlen", "tname", "tlen", "steps", (F.least(F.col("a")[0], F.col("a")[1]) - 1).alias("tstart"), F.greatest(F.col("a")[0], F.col("a")[1]).alias("tend"), (F.least(F.col("a")[2], F.col("a")[3]) - 1).alias("qstart"), F.greatest(F.col("a")[2], F.col("a")[3]).alias("qend"), ((F.col("a")[0] < F.col("a")[1]) == (F.col("a")[2] < F.col("a")[3])).alias("same"), F.col("a")[4].alias("nm"))
    ops = F.flatten(F.transform("steps", lambda d: F.filter(F.array(F.struct((F.abs(d) - 1).alias("len"), F.lit("M").alias("op")), F.struct(F.lit(1).alias("len"), F.when(d > 0, "D").otherwise("I").alias("op"))), lambda o: o["len"] > 0)))
    used = F.aggregate("steps", F.lit(0), lambda acc, d: acc + F.abs(d) - F.when(d > 0, 0).otherwise(1))
    rows = rows.withColumn("ops", F.concat(ops, F.array(F.struct((F.col("tend") - F.col("tstart") - used).alias("len"), F.lit("M").alias("op")))))
    block = F.aggregate("ops", F.lit(0), lambda acc, o: acc + o["len"])
    return rows.select("qname", "qlen", "qstart", "qend", F.when(F.col("same"), "+").otherwise("-").alias("strand"), "tname", "tlen", "tstart", "tend", (block - F.col("nm")).alias("nmatch"), block.alias("blen"), F.lit(0).alias("mapq"), cigar_text(F.col("ops")).alias("cigar"), F.col("nm"))


def cigar_text(ops: Column) -> Column:
    """Text of (len, op), with equal neighbours put together."""
    grown = F.aggregate(
        ops,
        F.array().cast("array<struct<len:int,op:string>>"),
        lambda acc, o: F.when((F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))).getField("op") == o["op"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((F.element_at(acc, F.greatest(F.size(acc), F.lit(1))).getField("len") + o["len"]).alias("len"), o["op"].alias("op"))))).otherwise(F.concat(acc, F.array(F.struct(o["len"].alias("len"), o["op"].alias("op"))))),
    )
    return F.array_join(F.transform(grown, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def sam_to_paf(alignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Mapped SAM rows as PAF; lengths: name, length. Clips give the query's length and start; NM gives the matches."""
    ops = S.cigar_ops(F.col("cigar"))
    clip = lambda pattern: F.coalesce(F.regexp_extract("cigar", pattern, 1).try_cast("int"), F.lit(0))
    head, tail = clip(r"^(\d+)[SH]"), clip(r"(\d+)[SH]$")
    inner, back = S.cigar_sum(ops, "MI=X"), F.col("flag").bitwiseAND(16) != 0
    block = S.cigar_sum(ops, "MID=X")
    rows = alignments.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("rname") != "*")).join(lengths, F.col("rname") == F.col("name"), "left")
    nm = F.try_element_at("tags", F.lit("NM")).cast("int")
    return rows.select(
        "qname", (head + inner + tail).alias("qlen"), F.when(back, tail).otherwise(head).alias("qstart"), (F.when(back, tail).otherwise(head) + inner).alias("qend"), F.when(back, "-").otherwise("+").alias("strand"),
        F.col("rname").alias("tname"), F.col("length").alias("tlen"), (F.col("pos") - 1).alias("tstart"), (F.col("pos") - 1 + S.cigar_sum(ops, "MDN=X")).alias("tend"),
        (block - F.coalesce(nm, F.lit(0))).alias("nmatch"), block.alias("blen"), "mapq", F.when(F.col("flag").bitwiseAND(256) != 0, "S").otherwise("P").alias("tp"), F.regexp_replace("cigar", r"\d+[SH]", "").alias("cigar"),
    )


def blocks_of(paf: DataFrame) -> DataFrame:
    """paf with starts and sizes: the target's blocks between introns (N), from the alignment's start."""
    ops = S.cigar_ops(F.col("cigar"))
    start = F.struct(F.lit(0).alias("at"), F.array(F.struct(F.lit(0).alias("st"), F.lit(0).alias("en"))).alias("b"))

    def step(acc: Column, o: Column) -> Column:
        ahead = acc["at"] + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["len"]).otherwise(0)
        last = F.element_at(acc["b"], -1)
        more = F.concat(acc["b"], F.array(F.struct(ahead.alias("st"), ahead.alias("en"))))
        same = F.concat(F.slice(acc["b"], F.lit(1), F.size(acc["b"]) - 1), F.array(F.struct(last["st"].alias("st"), ahead.alias("en"))))
        return F.struct(ahead.alias("at"), F.when(o["op"] == "N", more).otherwise(same).alias("b"))

    b = F.aggregate(ops, start, step, lambda acc: acc["b"])
    return paf.withColumn("starts", F.transform(b, lambda x: x["st"])).withColumn("sizes", F.transform(b, lambda x: x["en"] - x["st"]))


def splice_to_bed(paf: DataFrame) -> DataFrame:
    """BED12 columns of spliced alignments (qname, strand, tname, tstart, tend, mapq, cigar)."""
    own = blocks_of(paf)
    text = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    return own.select(F.col("tname").alias("ctg"), F.col("tstart").alias("st"), F.col("tend").alias("en"), F.col("qname").alias("name"), F.col("mapq").alias("score"), "strand", F.size("sizes").alias("n_blocks"), text("sizes").alias("sizes"), text("starts").alias("starts"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF3 rows with transcript, gene and type; 0-based starts."""
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f")).where(F.size("f") >= 9)
    info = F.col("f")[8]
    pick = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract(info, rf'(?:^|[;\s]){n}(?:=|\s+")([^";]+)', 1), F.lit("")) for n in names])
    return rows.select(F.col("f")[0].alias("ctg"), F.col("f")[2].alias("kind"), (F.col("f")[3].cast("int") - 1).alias("st"), F.col("f")[4].cast("int").alias("en"), F.col("f")[6].alias("strand"), pick("transcript_id", "Parent").alias("transcript"), pick("gene_name", "gene_id", "gene").alias("gene"), pick("transcript_biotype", "transcript_type", "gene_biotype", "gene_type").alias("biotype"))


def annotations_to_bed(rows: DataFrame) -> DataFrame:
    """One BED12 row a transcript, from its exons."""
    exons = rows.where("kind = 'exon' and transcript is not null").groupBy("ctg", "transcript", "strand").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.array_sort(F.collect_set(F.struct("st", "en"))).alias("x"))
    text = lambda c: F.concat(F.array_join(c, ","), F.lit(","))
    return exons.select("ctg", "st", "en", F.col("transcript").alias("name"), F.lit(1000).alias("score"), "strand", F.size("x").alias("n_blocks"), text(F.transform("x", lambda e: (e["en"] - e["st"]).cast("string"))).alias("sizes"), text(F.transform("x", lambda e: (e["st"] - F.col("st")).cast("string"))).alias("starts"))


def sam_lines(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """(value): SAM rows of mapped hits (as map_reads gives them) and of reads without one. Secondary rows carry no bases."""
    names = reads.select(F.col("read_id").alias("query_id"), "seq")
    both = names.join(hits.withColumnRenamed("read_id", "target"), "query_id", "left")
    back, second = F.col("strand") == "-", F.col("rank") != F.col("parent")
    unmapped = F.col("target").isNull()
    further = (F.col("rank") > 0) | (F.col("part") > 0) if "part" in hits.columns else F.col("rank") > 0
    flag = F.when(unmapped, 4).otherwise(F.when(back, 16).otherwise(0) + F.when(second, 256).when(further, 2048).otherwise(0))
    left = F.when(back, F.col("qlen") - F.col("qend")).otherwise(F.col("qstart"))
    right = F.col("qlen") - (F.col("qend") - F.col("qstart")) - left
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    bases = F.when(second, "*").when(back, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    cigar = F.when(unmapped, "*").otherwise(F.concat(clip(left), F.col("cigar"), clip(right)))
    tags = F.when(~unmapped, F.concat(F.lit("NM:i:"), (F.col("blen") - F.col("nmatch")).cast("string"), F.lit("\tAS:i:"), F.col("dp_score").cast("string"), F.lit("\tMD:Z:"), F.col("md"), F.lit("\tcs:Z:"), F.col("cs")))
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    return both.select(F.concat_ws("\t", F.col("query_id").cast("string"), flag.cast("string"), text("target", "*"), F.coalesce((F.col("tstart") + 1).cast("string"), F.lit("0")), text("mapq", "0"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.when(F.length("seq") == 0, "*").otherwise(F.coalesce(bases, F.col("seq"))), F.lit("*"), tags).alias("value"))


def sam_header(targets: DataFrame) -> DataFrame:
    """(value): one @SQ line a target."""
    return targets.select(F.concat(F.lit("@SQ\tSN:"), F.col("read_id").cast("string"), F.lit("\tLN:"), F.length("seq").cast("string")).alias("value"))


def write_sam(hits: DataFrame, reads: DataFrame, targets: DataFrame, path: str) -> None:
    """Header and rows as text files of one folder: the header's file comes first by name."""
    rows = sam_header(targets).coalesce(1).unionByName(sam_lines(hits, reads))
    rows.write.text(path)
