"""Genomes and reads made up from a seed, and the formats that read simulators write."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import numbered_lines

#: Shapes and scales of the mixed gamma lengths, and the share of the first.
MIXED = ((1.28, 6300.0, 0.7), (6.0, 2000.0, 0.3))
CHUNK = 10_000


def genome(spark: SparkSession, length: int, seed: int) -> DataFrame:
    """(chunk, seq): random bases in pieces of CHUNK, the same for the same seed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = [np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng([seed, i]).integers(0, 4, min(CHUNK, length - i * CHUNK))].tobytes().decode() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.string())], ["chunk", "seq"])

    return spark.range(-(-length // CHUNK)).mapInArrow(of, "chunk bigint, seq string")


def length_of(r: np.random.Generator, kind: str, mean: float) -> int:
    """A read length: const, exponential, beta or mixed (two gammas)."""
    if kind == "const":
        n = mean
    elif kind == "exponential":
        n = r.exponential(mean)
    elif kind == "beta":
        n = 2 * mean * r.beta(2.0, 2.0)
    elif kind == "mixed":
        shape, scale, _ = MIXED[0] if r.random() < MIXED[0][2] else MIXED[1]
        n = r.gamma(shape, scale) * mean / sum(a * b * p for a, b, p in MIXED)
    else:
        raise ValueError(f"no such lengths: {kind}")
    return max(1, int(n))


def noisy(r: np.random.Generator, piece: str, p_ins: float, p_del: float, p_sub: float) -> tuple[str, str]:
    """A read of a channel that inserts, drops and replaces bases, and its edits as text."""
    out, edits, same = [], [], 0

    def flush() -> None:
        nonlocal same
        if same:
            edits.append(f"u{same}")
        same = 0

    for c in piece:
        while r.random() < p_ins:
            b = "ACGT"[r.integers(4)]
            flush()
            out.append(b)
            edits.append(f"i{b}")
        u = r.random()
        if u < p_del:
            flush()
            edits.append("d-")
        elif u < p_del + p_sub:
            b = "ACGT".replace(c, "")[r.integers(3)]
            flush()
            out.append(b)
            edits.append(f"s{b}")
        else:
            out.append(c)
            same += 1
    flush()
    return "".join(out), "".join(edits)


def simulated_reads(spark: SparkSession, source: str, n: int, mean: float, kind: str = "const", p_ins: float = 0.02, p_del: float = 0.02, p_sub: float = 0.02, seed: int = 1) -> DataFrame:
    """(read_id, is_rc, pos, edit_string, seq): reads of a circular genome held in one string; a read's draws depend on the seed and its number only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                r = np.random.default_rng([seed, i])
                at, size, back = int(r.integers(len(source))), min(length_of(r, kind, mean), len(source)), bool(r.integers(2))
                piece = (source + source)[at : at + size]
                read, edits = noisy(r, piece[::-1].translate(str.maketrans("ACGT", "TGCA")) if back else piece, p_ins, p_del, p_sub)
                rows.append((i, back, at, edits, read))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], k) for j, k in enumerate(kinds)], ["read_id", "is_rc", "pos", "edit_string", "seq"])

    return spark.range(n).mapInArrow(of, "read_id bigint, is_rc boolean, pos bigint, edit_string string, seq string")


def alignment_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a multiple alignment file of simulated reads, a line of the genome and one of the read: (name, ctg, st, en, strand, read), the truth in plain columns."""
    lines = numbered_lines(spark, path).where("startswith(value, 's')")
    f = F.split(F.trim("value"), r"\s+")
    kept = lines.select("line_no", f.alias("f")).where(F.size("f") >= 7)
    # the two lines of a block follow each other
    first = kept.select((F.col("line_no") + 1).alias("line_no"), F.col("f").alias("g"))
    both = kept.join(first, "line_no")
    g = lambda k: F.col("g")[k]
    st = g(2).cast("bigint")
    return both.select(F.col("f")[1].alias("name"), g(1).alias("ctg"), st.alias("st"), (st + g(3).cast("bigint")).alias("en"), F.col("f")[4].alias("strand"), F.regexp_replace(F.upper(F.col("f")[6]), "-", "").alias("read"))


def named_by_truth(truth: DataFrame) -> DataFrame:
    """truth: name, ctg, st, en, strand. Names that carry where a read is from, as accuracy checks parse them: name!ctg!st!en!strand."""
    return truth.withColumn("name", F.concat_ws("!", "name", "ctg", F.col("st").cast("string"), F.col("en").cast("string"), "strand"))


def truth_of_names(reads: DataFrame) -> DataFrame:
    """reads: name of that form. (name, ctg, st, en, strand)."""
    f = F.split("name", "!")
    return reads.where(F.size(f) == 5).select("name", f[1].alias("ctg"), f[2].cast("bigint").alias("st"), f[3].cast("bigint").alias("en"), f[4].alias("strand"))


def simulated_sam(alignments: DataFrame) -> DataFrame:
    """alignments: a simulator's SAM rows (qname, flag, rname, pos, cigar). The truth of each read in plain columns: (name, mate, ctg, st, en, strand)."""
    from strandlake.functions import sequences as S

    span = S.cigar_sum(S.cigar_ops(F.col("cigar")), "MDN=X")
    mate = F.when(F.col("flag").bitwiseAND(64) != 0, 1).when(F.col("flag").bitwiseAND(128) != 0, 2).otherwise(0)
    return alignments.select(F.col("qname").alias("name"), mate.alias("mate"), F.col("rname").alias("ctg"), (F.col("pos") - 1).cast("bigint").alias("st"), (F.col("pos") - 1 + span).cast("bigint").alias("en"), F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+").alias("strand"))
