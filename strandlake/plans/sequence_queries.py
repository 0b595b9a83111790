"""Queries over sequences: statistics, k-mers, sketches, minimizers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import archive, consensus, edits, intervals
from strandlake.operators import sketches as K
from strandlake.operators.components import connected_components

from .registry import query
from .tables import materialize

#: k-mer length, hashes and least matches of the sketch queries.
KMER, HASHES, LEAST = 23, 60, 6
ALIGN_K, ALIGN_LEAST = 8, 10
MINIMIZER_K, MINIMIZER_W = 15, 10

READS = "reads as (select doc_id as read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reads_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _kmers_sql(k: int, least: int = 32) -> str:
    return f"""km as (select read_id, i - 1 as pos, substring(seq, i, {k}) as s from
      (select read_id, seq, unnest(generate_series(1, len(seq) - {k - 1})) as i from reads where len(seq) >= {max(k, least)}))"""


def _code_sql(s: str, digits: str = "ATCG") -> str:
    return f"list_reduce(list_transform(string_split({s}, ''), lambda c: cast(instr('{digits}', c) - 1 as bigint)), lambda a, b: a * 4 + b)"


def _ints_sql(k: int, least: int = 32) -> str:
    return f"{_kmers_sql(k, least)}, ki as (select read_id, pos, {_code_sql('s')} as kmer from km)"


def _sketch_sql(k: int, n: int) -> str:
    seeds = ", ".join(f"({j}, {s}::bigint)" for j, s in enumerate(S.seeds(k, n)))
    return f"""{READS}, {_ints_sql(k)}, seeds(hash_idx, r) as (values {seeds}),
      sk as (select read_id, hash_idx, min(xor(kmer, r)) as min_hash from ki, seeds group by read_id, hash_idx)"""


PAIRS_SQL = f"pairs as (select x.read_id as a, y.read_id as b, count(*) as matches from sk x join sk y using (hash_idx, min_hash) where x.read_id < y.read_id group by all having count(*) >= {LEAST})"


@query("read_stats", f"with {READS} select count(*) as n_reads, cast(sum(len(seq)) // count(*) as bigint) as avg_len, cast(max(len(seq)) as bigint) as max_len from reads")
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq").cast("bigint")
    one = reads(spark, sf_dir).agg(F.count("*").alias("n_reads"), F.sum(n).alias("t"), F.max(n).alias("max_len"))
    return one.select("n_reads", F.expr("t div n_reads").alias("avg_len"), "max_len")


def length_shares(lengths: DataFrame) -> DataFrame:
    """Distinct lengths with their bases, and the bases in lengths at least as great: the window runs over distinct lengths, not rows."""
    by_length = lengths.groupBy("len").agg(F.count("*").alias("n"), F.sum("len").alias("bases"))
    longer = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_length.withColumn("cum", F.sum("bases").over(longer)).withColumn("total", F.sum("bases").over(Window.partitionBy()))


def lengths_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("n_chars").alias("len"))


LENGTHS_SQL = "l as (select n_chars as len, sum(n_chars) over (order by n_chars desc, doc_id rows unbounded preceding) as cum, sum(n_chars) over () as total from documents)"


@query("n50_n90", f"with {LENGTHS_SQL} select max(len) filter (cum >= 0.5 * total) as n50, max(len) filter (cum >= 0.9 * total) as n90, max(len) as largest, cast(max(total) as bigint) as total from l")
def n50_n90(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = length_shares(lengths_of(spark, sf_dir))
    reach = lambda q: F.max(F.when(F.col("cum") >= q * F.col("total"), F.col("len")))
    return s.agg(reach(0.5).alias("n50"), reach(0.9).alias("n90"), F.max("len").alias("largest"), F.max("total").alias("total"))


@query("aun", "select sum(cast(n_chars as double) * n_chars) / sum(n_chars) as aun from documents")
def aun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the Nx curve."""
    x = F.col("len").cast("double")
    return lengths_of(spark, sf_dir).agg((F.sum(x * F.col("len")) / F.sum("len")).alias("aun"))


@query("revcomp", f"with {READS} select read_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc, translate(seq, 'ACGT', 'TGCA') as comp from reads")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"), S.complement(F.col("seq")).alias("comp"))


@query("iupac_revcomp", "select doc_id, translate(reverse(text), 'WSATUGCYRKMBDHVNwsatugcyrkmbdhvn', 'WSTAACGRYMKVHDBNwstaacgrymkvhdbn') as rc from documents")
def iupac_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", S.iupac_reverse_complement(F.col("text")).alias("rc"))


@query("base_codes", f"with {READS} select read_id, translate(seq, 'ATCG', '0123') as codes, translate(seq, 'ACGT', '0123') as nt4 from reads")
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", S.base_codes(F.col("seq")).alias("codes"), S.nt4_codes(F.col("seq")).alias("nt4"))


@query("kmer_count", f"with {READS}, {_ints_sql(11)} select read_id, count(*) as n, count(distinct kmer) as kinds, cast(sum(kmer) as bigint) as total from ki group by read_id")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kmer_totals(reads(spark, sf_dir), 11)


@query("int_to_kmer", f"with {READS}, {_ints_sql(12)} select ki.read_id, ki.pos, km.s as kmer, ki.kmer as code from ki join km on km.read_id = ki.read_id and km.pos = ki.pos")
def int_to_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each k-mer to an integer and back."""
    return K.kmers(reads(spark, sf_dir), 12).select("read_id", F.col("pos").cast("bigint").alias("pos"), S.int_to_kmer(F.col("kmer"), 12).alias("kmer"), F.col("kmer").alias("code"))


@query(
    "repetitive_reads",
    f"""with {READS}, s as (select read_id, seq, unnest(generate_series(1, 6)) as k from reads where len(seq) > 0),
    r as (select read_id, k, len(list_filter(generate_series(1, len(seq)), lambda i: substring(seq, i, 1) = substring(seq, ((i - 1 + k) % len(seq)) + 1, 1))) / len(seq) as share from s where k < len(seq))
    select reads.read_id, coalesce(bool_or(share > 0.7), false) as repetitive from reads left join r on r.read_id = reads.read_id group by reads.read_id""",
)
def repetitive_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", S.is_repetitive(F.col("seq")).alias("repetitive"))


@query("tail_homopolymer", f"with {READS} select read_id, cast(len(regexp_extract(seq, '(A+|C+|G+|T+)$', 1)) as int) as run from reads")
def tail_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", S.tail_homopolymer(F.col("seq")).alias("run"))


def sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.minhash(reads(spark, sf_dir), KMER, HASHES)


@query("minhash_sketch", f"with {_sketch_sql(KMER, HASHES)} select read_id, hash_idx, min_hash from sk")
def minhash_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch(spark, sf_dir)


@query("sketch_self_join", f"with {_sketch_sql(KMER, HASHES)}, {PAIRS_SQL} select a, b, matches from pairs")
def sketch_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sketch_self_join(materialize(sketch(spark, sf_dir), "sketches"), LEAST)


@query(
    "sketch_join_benchmark",
    f"""with {_sketch_sql(KMER, HASHES)},
    breads as (select item_id as read_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from benchmark),
    bkm as (select read_id, substring(seq, i, {KMER}) as s from (select read_id, seq, unnest(generate_series(1, len(seq) - {KMER - 1})) as i from breads where len(seq) >= 32)),
    bsk as (select read_id, hash_idx, min(xor({_code_sql("s")}, r)) as min_hash from bkm, seeds group by read_id, hash_idx)
    select x.read_id as a, y.read_id as b, count(*) as matches from sk x join bsk y using (hash_idx, min_hash) group by all having count(*) >= {LEAST}""",
)
def sketch_join_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    return K.sketch_join(sketch(spark, sf_dir), K.minhash(K.reads_of(items), KMER, HASHES), LEAST)


@query("sketch_index_stats", f"with {_sketch_sql(KMER, HASHES)}, c as (select hash_idx, min_hash, count(*) as n from sk group by all) select hash_idx, count(*) as kinds, count(*) filter (where n = 1) as single, max(n) as most from c group by hash_idx")
def sketch_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sketch(spark, sf_dir).groupBy("hash_idx", "min_hash").agg(F.count("*").alias("n"))
    return counts.groupBy("hash_idx").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("most"))


def components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = materialize(sketch(spark, sf_dir), "sketches")
    return own.select("read_id").distinct(), connected_components(K.sketch_self_join(own, LEAST), "a", "b")


COMPONENTS_SQL = f"""{_sketch_sql(KMER, HASHES)}, {PAIRS_SQL}, both_ways as (select a, b from pairs union all select b, a from pairs),
  walk(node, reach) as (select a, a from both_ways union select walk.node, both_ways.b from walk join both_ways on walk.reach = both_ways.a),
  comp as (select node, min(reach) as component from walk group by node)"""


@query("overlap_components", f"with recursive {COMPONENTS_SQL} select node, component from comp")
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs-to-be: components of the overlap graph, named by their seed, the least read."""
    return components(spark, sf_dir)[1]


@query("seed_per_component", f"with recursive {COMPONENTS_SQL} select component as seed, count(*) as members from comp group by component")
def seed_per_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir)[1].groupBy(F.col("component").alias("seed")).agg(F.count("*").alias("members"))


@query("lone_reads", f"with recursive {COMPONENTS_SQL} select distinct read_id from sk where read_id not in (select node from comp)")
def lone_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = components(spark, sf_dir)
    return own.join(found, own["read_id"] == found["node"], "left_anti")


@query(
    "sortmerge_kmer_align",
    f"""with {_sketch_sql(KMER, HASHES)}, {PAIRS_SQL},
    km8 as (select read_id, i - 1 as pos, {_code_sql(f"substring(seq, i, {ALIGN_K})")} as kmer from (select read_id, seq, unnest(generate_series(1, len(seq) - {ALIGN_K - 1})) as i from reads where len(seq) >= 32)),
    rk as (select *, row_number() over (partition by read_id, kmer order by pos) as rn from km8)
    select a, b, count(*) as shared, cast(trunc(sum(x.pos - y.pos) / count(*)) as bigint) as rel_pos
    from pairs join rk x on x.read_id = a join rk y on y.read_id = b and y.kmer = x.kmer and y.rn = x.rn group by a, b having count(*) >= {ALIGN_LEAST}""",
)
def sortmerge_kmer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return K.sketch_align(r, sketch(spark, sf_dir), LEAST, ALIGN_K, ALIGN_LEAST)


def _hash64_sql(x: str, bits: int) -> list[str]:
    """Steps of hash64 as nested selects over a column h."""
    m = (1 << bits) - 1
    left = lambda v, s: f"(({v} & {m >> s}) << {s})"
    return [
        f"(((~{x}) & {m}) + {left(x, 21)}) & {m}",
        "xor(h, h >> 24)",
        f"((((h + {left('h', 3)}) & {m}) + {left('h', 8)}) & {m})",
        "xor(h, h >> 14)",
        f"((((h + {left('h', 2)}) & {m}) + {left('h', 4)}) & {m})",
        "xor(h, h >> 28)",
        f"((h + {left('h', 31)}) & {m})" if bits > 31 else "h",
    ]


def _minimizer_sql() -> str:
    k, w = MINIMIZER_K, MINIMIZER_W
    steps = _hash64_sql("h", 2 * k)
    chain = f"h0 as (select read_id, pos, cast(rev < fwd as int) as strand, least(fwd, rev) as h from nt where fwd <> rev)"
    for j, step in enumerate(steps):
        chain += f", h{j + 1} as (select read_id, pos, strand, {step} as h from h{j})"
    return f"""{READS}, {_kmers_sql(k, 1)},
    nt as (select read_id, pos, {_code_sql("s", "ACGT")} as fwd, {_code_sql("translate(reverse(s), 'ACGT', 'TGCA')", "ACGT")} as rev from km), {chain},
    win as (select read_id, min((h, -pos, strand)) over (partition by read_id order by pos rows between {w - 1} preceding and current row) as m,
      row_number() over (partition by read_id order by pos) as rn, count(*) over (partition by read_id) as n from h{len(steps)}),
    mins as (select distinct read_id, -m[2] as pos, m[3] as strand, m[1] as minimizer from win where rn >= {w} or rn = n)"""


def minimizer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.minimizers(reads(spark, sf_dir), MINIMIZER_K, MINIMIZER_W)


@query("minimizers", f"with {_minimizer_sql()} select read_id, pos, strand, minimizer from mins")
def minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimizer_index(spark, sf_dir)


@query("minimizer_stats", f"with {_minimizer_sql()}, c as (select minimizer, count(*) as n from mins group by all) select count(*) as kinds, count(*) filter (where n = 1) as single, cast(sum(n) as bigint) as total, max(n) as most from c")
def minimizer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = minimizer_index(spark, sf_dir).groupBy("minimizer").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("occ_cutoff", f"with {_minimizer_sql()}, c as (select minimizer, count(*) as n from mins group by all) select percentile_disc(0.998) within group (order by n) + 1 as mid_occ from c")
def occ_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = minimizer_index(spark, sf_dir).groupBy("minimizer").agg(F.count("*").alias("n"))
    return counts.agg((F.expr("percentile_disc(0.998) within group (order by n)") + 1).cast("bigint").alias("mid_occ"))


@query("tandem_flag", f"""with {_minimizer_sql()}, t as (select *, lag(minimizer) over w as p, lead(minimizer) over w as q from mins window w as (partition by read_id order by pos))
    select read_id, count(*) as n, cast(sum(cast(coalesce(minimizer = p, false) or coalesce(minimizer = q, false) as int)) as bigint) as tandem from t group by read_id""")
def tandem_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tandem_flags(minimizer_index(spark, sf_dir)).groupBy("read_id").agg(F.count("*").alias("n"), F.sum("tandem").alias("tandem"))


SEED_RARE = 0.002


@query(
    "seed_join",
    f"""with {_minimizer_sql()}, c as (select minimizer, count(*) as n from mins group by minimizer), rare as (select minimizer from c where n < (select percentile_disc({1 - SEED_RARE}) within group (order by n) + 1 from c))
    select q.read_id as query_id, r.read_id, cast(q.strand <> r.strand as int) as rev, count(*) as anchors, min(q.pos) as q_first, max(r.pos) as r_last
    from mins q join mins r using (minimizer) where q.read_id <> r.read_id and minimizer in (select minimizer from rare) group by all""",
)
def seed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors between reads on minimizers below the corpus' own occurrence cut-off, summed up by pair and strand."""
    own = materialize(minimizer_index(spark, sf_dir), "minimizers")
    return K.seed_pairs(own, K.occurrence_cutoff(own, SEED_RARE))


@query("sample_min_len", f"with {READS} select read_id, cast(len(seq) as int) as len from reads where len(seq) >= 500")
def sample_min_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", F.length("seq").alias("len")).where("len >= 500")


@query("delta_encode", "select source, doc_id, doc_id - lag(doc_id, 1, 0) over (partition by source order by doc_id) as delta from documents")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id")
    return intervals.delta_encoded(d, ["source"], "doc_id", 10_000)


@query("delta_decode", "select source, doc_id from documents")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sum of delta_encode gives the ids again; the encoded rows stand in the order of their file, here of doc_id."""
    own = delta_encode(spark, sf_dir).withColumnRenamed("doc_id", "ordinal")
    return intervals.delta_decoded(own, ["source"], "ordinal", 10_000, "doc_id").select("source", "doc_id")


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reads, every third turned, encoded against consensus paths of their components on both strands."""
    plain = materialize(reads(spark, sf_dir), "reads")
    own = plain.select("read_id", F.when(F.col("read_id") % 3 == 1, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return consensus.encode(own, connected_components(K.links(own, KMER, HASHES, LEAST, 2), "a", "b"))


@query("roundtrip", f"with {READS} select read_id, case when read_id % 3 = 1 then translate(reverse(seq), 'ACGT', 'TGCA') else seq end as seq from reads")
def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of both strands encoded as consensus paths, edit scripts and lone reads, then decoded."""
    contigs, placements, lone, _ = encoded(spark, sf_dir)
    return consensus.decode(contigs, placements, lone)


@query("seed_roundtrip", f"with {READS} select read_id, seq from reads")
def seed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plainer archive: each contig's first read is its reference."""
    own = materialize(reads(spark, sf_dir), "reads")
    contigs, placements, lone = edits.encode(own, connected_components(K.links(own, KMER, HASHES, LEAST), "a", "b"))
    return edits.decode(materialize(contigs, "contigs"), materialize(placements, "placements"), materialize(lone, "lone"))


@query("consensus_status")
def consensus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig graphs: reads, nodes, edges, mean weight of the main path."""
    return encoded(spark, sf_dir)[3]


@query("archive_metadata", f"with {READS} select count(*) as reads from reads")
def archive_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read is in one stream of the archive: the count that its metadata gives."""
    contigs, placements, lone, _ = encoded(spark, sf_dir)
    return archive.metadata(contigs, placements, lone).select((F.col("placed") + F.col("lone")).alias("reads"))


@query("edit_optimize", "select l_orderkey as id, l_linenumber as line, repeat('sT', least(d, n)) || repeat('d-', greatest(d - n, 0)) || repeat('iT', greatest(n - d, 0)) || 'u5sA' || 'd-' as text from (select l_orderkey, l_linenumber, cast(l_partkey % 4 as int) as d, cast(l_suppkey % 4 as int) as n from lineitem)")
def edit_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions and insertions in a row as substitutions."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    op = lambda o, n, b: F.struct(F.lit(o).alias("op"), F.lit(n).alias("len"), F.lit(b).cast("string").alias("base"))
    run = lambda e, n: F.array_repeat(e, n.cast("int"))
    script = F.concat(run(op("d", 1, None), F.col("l_partkey") % 4), run(op("i", 1, "T"), F.col("l_suppkey") % 4), F.array(op("u", 5, None), op("s", 1, "A"), op("d", 1, None)))
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), edits.edit_text(edits.optimized(script)).alias("text"))
