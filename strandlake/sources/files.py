"""Sequence and alignment files as DataFrames, with explicit schemas; formats are chosen by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S

PAF = "qname STRING, qlen INT, qstart INT, qend INT, strand STRING, tname STRING, tlen INT, tstart INT, tend INT, nmatch INT, blen INT, mapq INT"
BED = "ctg STRING, st INT, en INT, name STRING, score INT, strand STRING"
BED12 = BED + ", thick_st INT, thick_en INT, rgb STRING, n_blocks INT, sizes STRING, starts STRING"


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with the file and block they stand in and their order there; and one row a block: first number, lines, headers, and lines and headers before it in the order of files."""
    scan = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = scan.withColumn("id", F.monotonically_increasing_id())
    own = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.count_if(F.col("value").startswith(">")).alias("heads"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks alone meet in one task, never their lines
    return lines, own.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("heads_before"))


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """(line_no, value), from 0 in file order: a block's lines are numbered in their task, from the number of lines in the blocks before it."""
    lines, blocks = _blocks(spark, path)
    own = lines.join(blocks, ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")
    return own if comment is None else own.where(~F.col("value").startswith(comment))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, name, seq, qual): records of four lines; .gz is decompressed by Spark and dealt anew, as one file is one task."""
    lines = numbered_lines(spark, path)
    part = (F.col("line_no") % 4).cast("int")
    records = lines.groupBy(F.expr("line_no div 4").alias("read_id")).agg(*[F.max(F.when(part == k, F.col("value"))).alias(n) for k, n in ((0, "name"), (1, "seq"), (3, "qual"))])
    return records.where("seq is not null").select("read_id", F.regexp_replace(F.regexp_extract("name", r"^@?(\S*)", 1), "^@", "").alias("name"), F.translate("seq", "uU", "tT").alias("seq"), "qual")


def simulated(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, is_rc, pos, edit_string, seq): lines of strand:position:edits, each followed by its read."""
    lines = numbered_lines(spark, path)
    odd = F.col("line_no") % 2 == 1
    pairs = lines.groupBy(F.expr("line_no div 2").alias("read_id")).agg(F.max(F.when(~odd, F.col("value"))).alias("head"), F.max(F.when(odd, F.col("value"))).alias("seq"))
    head = F.split("head", ":")
    return pairs.where("seq is not null").select("read_id", (head[0] == "c").alias("is_rc"), head[1].cast("bigint").alias("pos"), F.get(head, F.lit(2)).alias("edit_string"), "seq")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record, name, comment, seq): wrapped lines are joined; U is read as T. A line's record is the number of headers up to it: those of earlier blocks and those before it in its own."""
    lines, blocks = _blocks(spark, path)
    head = F.col("value").startswith(">")
    order = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = lines.join(blocks, ["file", "block"]).withColumn("record", F.col("heads_before") + F.sum(head.cast("bigint")).over(order) - 1).where("record >= 0")
    line = F.struct((F.col("before") + F.col("id") - F.col("first")).alias("line_no"), F.trim("value").alias("v"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, line))), lambda x: x["v"]), "")
    joined = own.groupBy("record").agg(F.max(F.when(head, F.col("value"))).alias("head"), text.alias("seq"))
    return joined.select("record", F.regexp_extract("head", r"^>(\S*)", 1).alias("name"), F.regexp_extract("head", r"^>\S*\s+(.*)$", 1).alias("comment"), F.translate("seq", "uU", "tT").alias("seq"))


def interleaved(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(read_id, mate, name, seq): the records of several files in turn; records that another file lacks are left out."""
    each = [sequences(spark, p) for p in paths]
    both = each[0].select("read_id")
    for e in each[1:]:
        both = both.join(e.select("read_id"), "read_id")
    every = [e.join(both, "read_id").select("read_id", F.lit(k).alias("mate"), "name", "seq") for k, e in enumerate(each)]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def mini_batches(reads: DataFrame, bases: int, block: int = 10_000) -> DataFrame:
    """reads: read_id (dense, in order), name, seq; with batch: a new one begins where the bases before pass a multiple of `bases`; mates (names that differ in /1 and /2) share one. Running sums are by blocks of read ids."""
    stem = F.regexp_replace("name", "/[12]$", "")
    own = reads.withColumn("stem", stem).withColumn("n", F.length("seq").cast("bigint")).withColumn("block", F.expr(f"read_id div {block}"))
    totals = own.groupBy("block").agg(F.sum("n").alias("t"))
    starts = totals.select("block", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("read_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.join(starts, "block").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    first = placed.groupBy("stem").agg(F.min("before").alias("at"))
    return placed.join(first, "stem").select(*reads.columns, F.expr(f"at div {bases}").alias("batch"))


def alternatives(spark: SparkSession, path: str) -> DataFrame:
    """(t): names of alternative contigs, the first word of each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(\S+)", 1).alias("t")).where("t <> ''").distinct()


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """Reads by extension: FASTQ (.fastq, .fq, also gzipped), FASTA, or simulated reads for any other."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".fastq", ".fq")):
        out = fastq(spark, path)
        return out.repartition(spark.sparkContext.defaultParallelism) if path.lower().endswith(".gz") else out
    if name.endswith((".fasta", ".fa")):
        return fasta(spark, path).withColumnRenamed("record", "read_id")
    return simulated(spark, path)


def _columns(schema: str, fields: Column) -> list[Column]:
    return [F.expr(f"try_cast(get(f, {k}) as {kind})").alias(name) for k, (name, kind) in enumerate(x.split() for x in schema.split(", "))]


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns and a map of tags."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("f"))
    rest = F.array_join(F.slice("f", F.lit(13), F.greatest(F.size("f") - 12, F.lit(0))), "\t")
    return rows.select(*_columns(PAF, F.col("f")), S.tags(rest).alias("tags"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track')").select(F.split("value", "\t").alias("f"))
    return rows.select(*_columns(BED, F.col("f")))


def bed12_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(ctg, st, en, name, strand, block): one row a block."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("f")).select(*_columns(BED12, F.col("f")))
    ints = lambda c: F.filter(F.split(c, ","), lambda x: x != "").cast("array<int>")
    both = rows.select("ctg", F.col("st").alias("from"), "name", "strand", F.posexplode(F.arrays_zip(ints("sizes").alias("n"), ints("starts").alias("at"))).alias("block", "b"))
    return both.select("ctg", (F.col("from") + F.col("b.at")).alias("st"), (F.col("from") + F.col("b.at") + F.col("b.n")).alias("en"), "name", "strand", "block")


def bed12_introns(spark: SparkSession, path: str) -> DataFrame:
    order = Window.partitionBy("ctg", "name", "strand").orderBy("block")
    return bed12_blocks(spark, path).select("ctg", F.lag("en").over(order).alias("st"), F.col("st").alias("en"), "name", "strand").where("st is not null")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("f"))
    g = lambda k: F.get("f", F.lit(k))
    return rows.select(g(0).alias("chrom"), g(1).cast("int").alias("pos"), g(2).alias("id"), g(3).alias("ref"), F.split(g(4), ",").alias("alt"), F.expr("try_cast(get(f, 5) as double)").alias("qual"), g(6).alias("filter"), g(7).alias("info"), g(8).alias("format"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("samples"))


def sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments, and the lengths of the reference sequences from the header."""
    lines = spark.read.text(path)
    head = lines.where("startswith(value, '@SQ')").select(F.regexp_extract("value", r"\tSN:(\S+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int").alias("length"))
    f = lines.where("value <> '' and not startswith(value, '@')").select(F.split("value", "\t").alias("f"))
    schema = "qname STRING, flag INT, rname STRING, pos INT, mapq INT, cigar STRING, rnext STRING, pnext INT, tlen INT, seq STRING, qual STRING"
    rest = F.array_join(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), "\t")
    return f.select(*_columns(schema, F.col("f")), S.tags(rest).alias("tags")), head


def write_paf(hits: DataFrame, path: str) -> None:
    names = [x.split()[0] for x in PAF.split(", ")]
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*") if c in ("strand", "tname") else F.lit("0"))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.when(e["value"].rlike(r"^-?\d+$"), ":i:").otherwise(":Z:"), e["value"])), "\t")
    line = F.concat_ws("\t", *[star(c) for c in names], F.when(F.size("tags") > 0, tags))
    hits.select(line.alias("value")).write.text(path)


def with_unmapped(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits in PAF columns, and a row for each query (qname, qlen) that has none: no strand, target or places."""
    names = [x.split() for x in PAF.split(", ")]
    lost = queries.join(hits.select("qname").distinct(), "qname", "left_anti")
    empty = [F.col(c) if c in ("qname", "qlen") else F.lit(None).cast(t).alias(c) for c, t in names]
    return hits.select(*[c for c, _ in names], "tags").unionByName(lost.select(*empty, F.create_map().cast("map<string,string>").alias("tags")))


def write_reads(reads: DataFrame, path: str) -> None:
    """One read a line, in the order of read_id over the files."""
    reads.repartitionByRange("read_id").sortWithinPartitions("read_id").select("seq").write.text(path)
