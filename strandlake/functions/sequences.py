"""Column expressions over DNA and alignment strings; all built in, all within whole rows.

Two base orders are in use and never mixed: A, T, C, G = 0..3 for k-mers of the sketch, and A, C, G, T =
0..3 (4 for anything else) for minimizers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
IUPAC = "WSATUGCYRKMBDHVNwsatugcyrkmbdhvn"
IUPAC_COMPLEMENT = "WSTAACGRYMKVHDBNwstaacgrymkvhdbn"
#: Fixed multiplier and width of the sketch's seeds.
SEED_FACTOR = 2654435761


def dna(text: Column) -> Column:
    """The letters A, C, G and T of a whole text: the DNA projection of a text table."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def iupac_reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), IUPAC, IUPAC_COMPLEMENT)


def base_codes(seq: Column) -> Column:
    """Digits 0 to 3 in the order A, T, C, G."""
    return F.translate(seq, "ATCG", "0123")


def nt4_codes(seq: Column) -> Column:
    """Digits 0 to 3 in the order A, C, G, T (U as T), 4 for anything else."""
    return F.regexp_replace(F.translate(F.upper(seq), "ACGTU", "01233"), "[^0-3]", "4")


def kmer_to_int(kmer: Column) -> Column:
    return F.conv(base_codes(kmer), 4, 10).cast("bigint")


def int_to_kmer(n: Column, k: int | None = None) -> Column:
    """Bases of an integer; without k, leading As are lost."""
    out = F.translate(F.conv(n.cast("string"), 10, 4), "0123", "ATCG")
    return out if k is None else F.lpad(out, k, "A")


def kmer_strings(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order, in one pass; empty where it is shorter than k."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def seeds(k: int, n: int) -> list[int]:
    """Fixed seeds of the hash family: below 4 ** k, so that sketches order as unsigned numbers."""
    return [(j * SEED_FACTOR) % (1 << (2 * k)) for j in range(n)]


def hash64(key: Column, bits: int) -> Column:
    """Invertible integer hash under a mask of `bits` bits, without multiplication: shifts are cut first, so nothing overflows."""
    mask = (1 << bits) - 1

    def left(x: Column, s: int) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(mask >> s)), s) if s < bits else F.lit(0).cast("bigint")

    def plus(*parts: Column) -> Column:
        # sums of masked numbers stay far from 64 bits for k up to 28
        total = parts[0]
        for p in parts[1:]:
            total = (total + p).bitwiseAND(F.lit(mask))
        return total

    def fold(x: Column, s: int) -> Column:
        return x.bitwiseXOR(F.shiftright(x, s))

    x = key.cast("bigint")
    x = plus(F.bitwise_not(x).bitwiseAND(F.lit(mask)), left(x, 21))
    x = fold(x, 24)
    x = plus(x, left(x, 3), left(x, 8))
    x = fold(x, 14)
    x = plus(x, left(x, 2), left(x, 4))
    x = fold(x, 28)
    return plus(x, left(x, 31))


def is_repetitive(seq: Column, ratio: float = 0.7) -> Column:
    """Whether, for a shift of 1 to 6, more than `ratio` of the bases equal the base that far on, around the end."""
    def test(bases: Column) -> Column:
        n = F.size(bases)

        def share(shift: Column) -> Column:
            return F.size(F.filter(bases, lambda x, i: x == F.get(bases, (i + shift) % n))) / n

        return F.exists(F.sequence(F.lit(1), F.lit(6)), lambda s: (s < n) & (share(s) > ratio))

    return F.when(F.length(seq) < 1, False).otherwise(F.transform(F.array(F.split(seq, "")), test)[0])


def tail_homopolymer(seq: Column) -> Column:
    """Length of the run of one base that ends a sequence."""
    return F.length(F.regexp_extract(seq, r"(.)\1*$", 0))


def parse_number(text: Column) -> Column:
    """10k, 5M, 4G as numbers."""
    n = F.regexp_extract(text, r"^([0-9.]+)", 1).cast("double")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])$", 1))
    return (n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)).cast("bigint")


def cigar_ops(cigar: Column) -> Column:
    """Array of (len, op)."""
    pattern = F.lit(r"(\d+)([MIDNSHP=XB])")
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(cigar, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(cigar, pattern, F.lit(2)).alias("b")),
        lambda x: F.struct(x["a"].cast("int").alias("len"), x["b"].alias("op")),
    )


def cigar_sum(ops: Column, kinds: str) -> Column:
    """Length of the operations of the given kinds."""
    return F.aggregate(F.filter(ops, lambda x: F.instr(F.lit(kinds), x["op"]) > 0), F.lit(0).cast("bigint"), lambda a, x: a + x["len"])


def tags(text: Column) -> Column:
    """XX:T:value fields, tab separated, as a map from XX to value."""
    pattern = F.lit(r"(?:^|\t)(\S\S):[AZif]:([^\t]*)")
    return F.map_from_arrays(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)))


def gap_compressed_identity(matches: Column, block: Column, ambiguous: Column, gap_bases: Column, gap_opens: Column) -> Column:
    return matches / (block + ambiguous - gap_bases + gap_opens)


def entropy_per_base(p_sub: Column, p_ins: Column, p_del: Column) -> Column:
    """Bits a base of a channel that substitutes, inserts and deletes independently."""

    def binary(p: Column) -> Column:
        return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))

    return binary(p_sub) + p_sub * F.log2(F.lit(3.0)) + binary(p_ins) + p_ins * F.lit(2.0) + binary(p_del)
