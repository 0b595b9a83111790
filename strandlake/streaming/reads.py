"""Reads as a stream: an extension for reads that keep arriving.

A read's sketch needs its own row only, so a stream of reads joins a table of sketches without state; counts by
time window keep state for the watermark's span alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators.sketches import MIN_LENGTH


def row_sketches(reads: DataFrame, k: int, n: int) -> DataFrame:
    """(read_id, sketch): the MinHash sketch within the row, equal to the grouped one."""
    own = reads.where(F.length("seq") >= max(k, MIN_LENGTH)).select("read_id", F.transform(S.kmer_strings(F.col("seq"), k), S.kmer_to_int).alias("kmers"))

    def least(seed: int) -> Column:
        return F.array_min(F.transform("kmers", lambda x: x.bitwiseXOR(F.lit(seed).cast("bigint"))))

    return own.select("read_id", F.array(*[least(s) for s in S.seeds(k, n)]).alias("sketch"))


def candidates(stream: DataFrame, index: DataFrame, k: int, n: int) -> DataFrame:
    """(a, b, hash_idx) for each column in which an arriving read agrees with the index (read_id, hash_idx, min_hash)."""
    own = row_sketches(stream, k, n).select(F.col("read_id").alias("a"), F.posexplode("sketch").alias("hash_idx", "min_hash"))
    return own.join(index.withColumnRenamed("read_id", "b"), ["hash_idx", "min_hash"]).where("a <> b").select("a", "b", "hash_idx")


def overlaps(stream: DataFrame, index: DataFrame, k: int, n: int, least: int) -> DataFrame:
    """(a, b, matches): running matches of arriving reads; write it in update mode."""
    return candidates(stream, index, k, n).groupBy("a", "b").agg(F.count("*").alias("matches")).where(F.col("matches") >= least)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(st, en, event_type, n) of tumbling windows; events later than `late` are past the watermark."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("st"), F.col("w.end").alias("en"), "event_type", "n")
