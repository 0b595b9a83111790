"""Queries over packed bases, codes, checksums and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import packing as P
from strandlake.functions import sequences as S
from strandlake.operators import archive, mapping
from strandlake.operators import sketches as K

from .registry import query
from .sequence_queries import HASHES, KMER, LEAST, PAIRS_SQL, READS, _sketch_sql, reads, sketch

CODE = "list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({}, ''), lambda c: cast(instr('ATCG', c) - 1 as bigint))), lambda a, b: a * 4 + b)"


@query("pack_bases", f"""with {READS}, w as (select read_id, seq, unnest(generate_series(0, (len(seq) - 1) // 31)) as i from reads where len(seq) > 0),
  p as (select read_id, i, {CODE.format("substring(seq, i * 31 + 1, 31)")} as word from w)
  select read_id, len(seq) as n, seq as back, coalesce((select string_agg(cast(word as varchar), ' ' order by i) from p where p.read_id = reads.read_id), '') as words from reads""")
def pack_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as two bits a base, and back."""
    own = reads(spark, sf_dir).withColumn("w", P.pack_bases(F.col("seq")))
    return own.select("read_id", F.length("seq").cast("bigint").alias("n"), P.unpack_bases(F.col("w"), F.length("seq")).alias("back"), F.array_join(F.transform("w", lambda x: x.cast("string")), " ").alias("words"))


_BYTE = "printf('%02X', cast((v // {p}) % 128 + case when v >= {n} then 128 else 0 end as int))"


@query("varint", "select l_orderkey as id, l_linenumber as line, v as back, " + " || ".join(f"case when v >= {128**i if i else 0} then {_BYTE.format(p=128**i, n=128 ** (i + 1))} else '' end" for i in range(5)) + " as bytes from (select l_orderkey, l_linenumber, l_partkey * 997 as v from lineitem)")
def varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as bytes of seven bits, and back."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), P.varint(F.col("l_partkey") * 997).alias("bytes"))
    return t.select("id", "line", P.read_varint(F.col("bytes")).alias("back"), "bytes")


def _full_hash_sql(x: str) -> str:
    """Unsigned arithmetic in 128 bits, cut to 64."""
    m = "18446744073709551616"
    steps = [f"(({m} - 1 - {x}) + ({x} * 2097152) % {m}) % {m}", "xor(h, h // 16777216)", f"(h + (h * 8) % {m} + (h * 256) % {m}) % {m}", "xor(h, h // 16384)", f"(h + (h * 4) % {m} + (h * 16) % {m}) % {m}", "xor(h, h // 268435456)", f"(h + (h * 2147483648) % {m}) % {m}"]
    return steps


def _hash_chain() -> str:
    steps = _full_hash_sql("h")
    out = "h0 as (select o_orderkey as id, cast(o_orderkey as hugeint) as h from orders)"
    for j, s in enumerate(steps):
        out += f", h{j + 1} as (select id, cast({s} as hugeint) as h from h{j})"
    return out


@query("full_hash64", f"with {_hash_chain()} select id, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as hash from h7")
def full_hash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tie-breaking hash over all 64 bits."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), P.full_hash64(F.col("o_orderkey")).alias("hash"))


@query("adler32", f"""with {READS} select read_id, cast((b % 65521) * 65536 + a % 65521 as bigint) as adler from (select read_id,
  1 + coalesce(list_sum(list_transform(string_split(seq, ''), lambda c: ascii(c))), 0) as a, len(seq) + coalesce(list_sum(list_transform(generate_series(1, len(seq)), lambda i: (len(seq) - i + 1) * ascii(substring(seq, i, 1)))), 0) as b from reads where seq <> '')""")
def adler32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of reads."""
    return reads(spark, sf_dir).where("seq <> ''").select("read_id", P.adler32(F.col("seq")).alias("adler"))


@query("random_names", "select doc_id, substring(md5(cast(doc_id as varchar) || ':0') || md5(cast(doc_id as varchar) || ':1'), 1, 40) as name from documents")
def random_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", P.random_text(40, F.col("doc_id")).alias("name"))


@query("log2_floor", "select l_orderkey as id, l_linenumber as line, case when l_partkey < 2 then 0 else cast(len(bin(l_partkey)) - 1 as int) end as bits from lineitem")
def log2_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), P.log2_floor(F.col("l_partkey")).alias("bits"))


@query("subsequence", f"with {READS} select o_orderkey as id, read_id, substring(seq, cast(o_custkey % 300 as int) + 1, 40) as part from orders join reads on read_id = o_custkey")
def subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of named sequences."""
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("read_id"), (F.col("o_custkey") % 300).alias("st"))
    return archive.fetch(asked.withColumn("en", F.col("st") + 40), reads(spark, sf_dir)).select("id", "read_id", "part")


@query("name_ids", "select doc_id, source as name, cast(dense_rank() over (order by source) - 1 as bigint) as id from documents where source is not null")
def name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as numbers, by a dictionary."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("name"))
    return d.join(archive.dictionary(d, "name"), "name").select("doc_id", "name", "id")


@query("bernoulli_sample", "select doc_id from documents where cast('0x' || substr(md5(cast(doc_id as varchar) || ':7'), 1, 8) as bigint) < cast(floor(0.3 * 4294967296) as bigint)")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reads of ten, the same ones each time."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").where(P.sampled(F.col("doc_id"), 0.3, 7))


@query("divergence", """select l_orderkey as id, l_linenumber as line, ln((l_partkey % 200 + 100) / cast(l_suppkey % 90 + 5 as double)) / 15 as dv from lineitem""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence from the share of minimizers in a chain."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), mapping.divergence((F.col("l_partkey") % 200 + 100).cast("double"), (F.col("l_suppkey") % 90 + 5).cast("double"), 15).alias("dv"))


@query("candidate_pairs", f"""with {_sketch_sql(KMER, HASHES)}, {PAIRS_SQL}, f as (select read_id from reads where len(seq) >= 32 and len(seq) <= 3000 and
    not list_bool_or(list_transform(generate_series(1, 6), lambda k: k < len(seq) and len(list_filter(generate_series(1, len(seq)), lambda i: substring(seq, i, 1) = substring(seq, ((i - 1 + k) % len(seq)) + 1, 1))) / len(seq) > 0.7)))
    select a, b, matches from pairs where a in (select read_id from f) and b in (select read_id from f)""")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap candidates between reads that are long enough, not too long and not repetitive."""
    own = K.alignable(reads(spark, sf_dir), most=3000)
    return K.sketch_self_join(K.minhash(own, KMER, HASHES), LEAST)


@query("read_entropy", "select l_orderkey as id, l_linenumber as line, (case when l_tax <= 0 or l_tax >= 1 then 0 else -l_tax * log2(l_tax) - (1 - l_tax) * log2(1 - l_tax) end) + l_tax * log2(3.0) + (case when l_discount <= 0 or l_discount >= 1 then 0 else -l_discount * log2(l_discount) - (1 - l_discount) * log2(1 - l_discount) end) + l_discount * 2 + 0.0 as bits from lineitem")
def read_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a base of a channel of substitutions and insertions."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), S.entropy_per_base(F.col("l_tax"), F.col("l_discount"), F.lit(0.0)).alias("bits"))


@query("gap_identity", "select l_orderkey as id, l_linenumber as line, (l_quantity * 10) / (l_quantity * 10 + l_suppkey % 30 + 20 + l_partkey % 4 - l_suppkey % 20 + l_partkey % 3) as identity from lineitem")
def gap_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity where a gap counts as one difference."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = F.col("l_quantity") * 10
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), S.gap_compressed_identity(m, m + F.col("l_suppkey") % 30 + 20, F.col("l_partkey") % 4, F.col("l_suppkey") % 20, F.col("l_partkey") % 3).alias("identity"))
