"""MinHash sketches, their similarity join, minimizers and seed joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import kmers as A
from strandlake.functions import sequences as S
from strandlake.plans.tables import materialize

from . import probes
from .components import spanning

MIN_LENGTH = 32


def reads_of(documents: DataFrame) -> DataFrame:
    """The DNA projection of a text table: read_id, seq."""
    return documents.select(F.col("doc_id").alias("read_id"), S.dna(F.col("text")).alias("seq"))


def alignable(reads: DataFrame, least: int = MIN_LENGTH, most: int | None = None) -> DataFrame:
    """Reads that overlaps are looked for in: long enough, not too long, not repetitive (those would share a sketch with each other)."""
    out = reads.where((F.length("seq") >= least) & ~S.is_repetitive(F.col("seq")))
    return out if most is None else out.where(F.length("seq") <= most)


def kmers(reads: DataFrame, k: int, least: int = MIN_LENGTH) -> DataFrame:
    """(read_id, pos, kmer) of reads at least `least` long; shorter ones have no meaningful sketch."""
    return reads.select("read_id", "seq").mapInArrow(A.kmer_batches(k, least), "read_id bigint, pos int, kmer bigint")


def kmer_totals(reads: DataFrame, k: int, least: int = MIN_LENGTH) -> DataFrame:
    """(read_id, n, kinds, total): a read's k-mers, its distinct ones, and the sum of their numbers."""
    return reads.select("read_id", "seq").mapInArrow(A.kmer_totals(k, least), "read_id bigint, n bigint, kinds bigint, total bigint")


def minhash(reads: DataFrame, k: int, n: int, least: int = MIN_LENGTH) -> DataFrame:
    """(read_id, hash_idx, min_hash): least kmer xor seed, worked out where the read is."""
    return reads.select("read_id", "seq").mapInArrow(A.minhash_batches(k, S.seeds(k, n), least), "read_id bigint, hash_idx int, min_hash bigint")


def sketch_join(left: DataFrame, right: DataFrame, least: int, rising: bool = False) -> DataFrame:
    """(a, b, matches): pairs of sketches that agree in at least `least` columns; rising: a < b only."""
    return probes.sketch_pairs(probes.by_read(left, "sketch-lists"), probes.by_read(right, "sketch-lists"), least, rising)


def sketch_self_join(sketches: DataFrame, least: int) -> DataFrame:
    """Each pair once, a < b."""
    lists = probes.by_read(sketches, "sketch-lists")
    return probes.sketch_pairs(lists, lists, least, True)


def links(reads: DataFrame, k: int, n: int, least: int, strands: int = 1) -> DataFrame:
    """(a, b): edges whose components are those of all pairs a < b of reads whose sketches agree in at least `least` of n columns; strands 2: also a's sketch with that of b turned.

    Reads with the same bases have the same sketch: they hang on the least of them, and only that one is met with
    others. Edges that others of their task already imply go before they are written.
    """
    held = reads.where(F.col("read_id").isNotNull() & (F.length("seq") >= max(k, MIN_LENGTH))).select("read_id", "seq")
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stated number of partitions: what follows costs much time a row
    kinds = materialize(held.repartition(tasks, "seq").groupBy("seq").agg(F.min("read_id").alias("read_id"), F.max("read_id").alias("last")), "kinds")
    pair = "array<struct<hash_idx:int,min_hash:bigint>>"
    made = kinds.mapInArrow(A.sketch_batches(k, S.seeds(k, n), MIN_LENGTH, strands), f"read_id bigint, last bigint, v {pair}" + f", turned {pair}" * (strands > 1))
    lists = materialize(made, "sketch-lists")
    own = lists.select("read_id", "v")
    every = probes.sketch_pairs(own, own, least, True)
    if strands > 1:
        # of two kinds some read of the left one comes before some of the right one
        every = every.unionByName(probes.sketch_pairs(own, lists.select("read_id", "last", F.col("turned").alias("v")), least, True))
    few = materialize(spanning(every.select("a", "b").coalesce(tasks)), "links")
    copies = held.join(kinds.where("last <> read_id").select("seq", F.col("read_id").alias("a")), "seq").select("a", F.col("read_id").alias("b"))
    return spanning(few.unionByName(copies).where("a <> b").repartition(8))


def sketch_align(reads: DataFrame, sketches: DataFrame, least: int, k: int, least_shared: int = 10) -> DataFrame:
    """sort_merge_align of the pairs of the sketch join, worked out where a pair is found: no k-mer is shuffled."""
    ranked: dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]] = {}

    def kmers_of(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A read's k-mers with their rank by place among equal ones, as sorted numbers, and their places."""
        if (found := ranked.get(tuple(seqs))) is None:
            _, at, code = A.kmers(seqs, k, MIN_LENGTH)
            order = np.lexsort((at, code))
            at, code = at[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))[: len(code)]
            rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
            if len(ranked) >= 20_000:
                ranked.clear()
            # the rank in the high bits: few k-mers of a read are equal
            full = (rank << (2 * k)) | code
            again = np.argsort(full)
            found = ranked[tuple(seqs)] = full[again], at[again]
        return found

    def of(a: int, b: int, x: list[str], y: list[str]) -> list[tuple]:
        (p, at), (q, to) = kmers_of([s for s in x if s]), kmers_of([s for s in y if s])
        if not len(p) or not len(q):
            return []
        place = np.minimum(np.searchsorted(q, p), len(q) - 1)
        met = q[place] == p
        shared = int(met.sum())
        if shared < least_shared:
            return []
        offsets = int(at[met].sum() - to[place[met]].sum())
        return [(a, b, shared, offsets // shared if offsets >= 0 else -(-offsets // shared))]

    lists = probes.by_read(sketches, "sketch-lists", probes.texts_of(reads))
    return probes.sketch_pair_texts(lists, least, of, "a bigint, b bigint, shared bigint, rel_pos bigint")


def sort_merge_align(pairs: DataFrame, kmer_rows: DataFrame, least: int = 10) -> DataFrame:
    """(a, b, shared, rel_pos): k-mers of two reads paired one to one in order of position, and their mean offset cut to an integer."""
    order = Window.partitionBy("read_id", "kmer").orderBy("pos")
    ranked = kmer_rows.withColumn("rn", F.row_number().over(order))
    a = ranked.select(F.col("read_id").alias("a"), "kmer", "rn", F.col("pos").alias("pos_a"))
    b = ranked.select(F.col("read_id").alias("b"), "kmer", "rn", F.col("pos").alias("pos_b"))
    met = pairs.select("a", "b").join(a, "a").join(b, ["b", "kmer", "rn"])
    out = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum((F.col("pos_a") - F.col("pos_b")).cast("bigint")).alias("offsets"))
    return out.where(F.col("shared") >= least).select("a", "b", "shared", F.expr("offsets div shared").alias("rel_pos"))


def minimizers(reads: DataFrame, k: int, w: int, homopolymers: bool = False, spans: bool = False) -> DataFrame:
    """(read_id, pos, strand, minimizer[, span]): least hash of each w consecutive k-mers, the last of equal ones; k-mers equal to their reverse complement are skipped. homopolymers: runs of a base count as one."""
    made = reads.select("read_id", "seq").mapInArrow(A.minimizer_batches(k, w, homopolymers), "read_id bigint, pos int, strand int, minimizer bigint, span int")
    return made if spans else made.drop("span")


def occurrence_cutoff(index: DataFrame, share: float) -> int:
    """Occurrences that a share of the distinct minimizers exceeds: the exact rank, plus one."""
    counts = index.groupBy("minimizer").agg(F.count("*").alias("n"))
    return int(counts.agg(F.expr(f"percentile_disc({1 - share}) within group (order by n)")).first()[0] or 0) + 1


def seed_join(queries: DataFrame, index: DataFrame, most: int, same_ids: bool = True) -> DataFrame:
    """(query_id, read_id, rev, query_pos, ref_pos): anchors on shared minimizers that occur fewer than `most` times. same_ids: both sides name the same reads, and a read isn't joined with itself."""
    rare = index.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") < most).select("minimizer")
    ref = index.join(rare, "minimizer", "left_semi").select("minimizer", F.col("read_id"), F.col("pos").alias("ref_pos"), F.col("strand").alias("ref_strand"))
    own = ["span"] if "span" in queries.columns else []
    q = queries.select("minimizer", F.col("read_id").alias("query_id"), F.col("pos").alias("query_pos"), "strand", *own)
    met = q.join(ref, "minimizer")
    return (met.where("query_id <> read_id") if same_ids else met).select("query_id", "read_id", (F.col("strand") != F.col("ref_strand")).cast("int").alias("rev"), "query_pos", "ref_pos", *own)


def seed_pairs(index: DataFrame, most: int) -> DataFrame:
    """seed_join of reads with themselves, summed up by pair and strand: (query_id, read_id, rev, anchors, q_first, r_last). No anchor is shuffled."""
    rare = index.groupBy("minimizer").agg(F.count("*").alias("n")).where(F.col("n") < most).select("minimizer")
    own = index.join(rare, "minimizer", "left_semi").select("read_id", "pos", "strand", "minimizer")
    return probes.seed_pairs(probes.by_read(own, "minimizer-lists"))


def tandem_flags(index: DataFrame) -> DataFrame:
    """index with tandem: whether the minimizer before or after it in the read is the same."""
    order = Window.partitionBy("read_id").orderBy("pos")
    same = F.coalesce(F.lag("minimizer").over(order) == F.col("minimizer"), F.lit(False)) | F.coalesce(F.lead("minimizer").over(order) == F.col("minimizer"), F.lit(False))
    return index.withColumn("tandem", same.cast("int"))
