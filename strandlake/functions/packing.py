"""Packed bases, variable-length integers, checksums and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequences import base_codes, hash64

#: Bases in a word of 62 bits; low bits of half a word.
WORD = 31
LOW = (1 << 32) - 1
#: Fixed value: the modulus of the Adler checksum.
ADLER = 65521


def pack_bases(seq: Column) -> Column:
    """Two bits a base, WORD bases a number; the last number holds what is left."""
    codes = base_codes(seq)
    starts = F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / WORD).cast("int"))
    words = F.transform(starts, lambda i: F.conv(F.substr(codes, i * WORD + 1, F.lit(WORD)), 4, 10).cast("bigint"))
    return F.when(F.length(seq) > 0, words).otherwise(F.array().cast("array<bigint>"))


def unpack_bases(words: Column, length: Column) -> Column:
    """The bases again; length: how many."""
    size = lambda i: F.least(F.lit(WORD), length - i * WORD)
    return F.array_join(F.transform(words, lambda w, i: F.translate(F.lpad(F.conv(w.cast("string"), 10, 4), size(i), "0"), "0123", "ATCG")), "")


def varint(n: Column) -> Column:
    """Unsigned 32-bit number as hexadecimal bytes of seven bits, the lowest first; the high bit says that more follow."""
    x = n.cast("bigint")
    groups = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == 0) | (F.shiftrightunsigned(x, 0) >= F.pow(F.lit(128.0), i)))
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.hex(F.floor(x / F.pow(F.lit(128.0), i)) % 128 + F.when(x >= F.pow(F.lit(128.0), i + 1), 128).otherwise(0)), 2, "0")), "")


def read_varint(text: Column) -> Column:
    """The number of varint's bytes."""
    places = F.sequence(F.lit(0), (F.length(text) / 2).cast("int") - 1)
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: a + (F.conv(F.substr(text, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint") % 128) * F.pow(F.lit(128.0), i).cast("bigint"))


def _plus(a: Column, b: Column) -> Column:
    """Sum of two 64-bit numbers, cut to 64 bits, by halves: nothing overflows."""
    low = a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def full_hash64(key: Column) -> Column:
    """The invertible hash over all 64 bits, for breaking ties. Each step is a column of its own: sums name their parts twice."""
    step = lambda value, f: F.transform(F.array(value), f)[0]
    x = step(key.cast("bigint"), lambda x: _plus(F.bitwise_not(x), F.shiftleft(x, 21)))
    x = step(x, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 24)))
    x = step(step(x, lambda x: F.struct(x.alias("x"), _plus(x, F.shiftleft(x, 3)).alias("y"))), lambda s: _plus(s["y"], F.shiftleft(s["x"], 8)))
    x = step(x, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 14)))
    x = step(step(x, lambda x: F.struct(x.alias("x"), _plus(x, F.shiftleft(x, 2)).alias("y"))), lambda s: _plus(s["y"], F.shiftleft(s["x"], 4)))
    x = step(x, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 28)))
    return step(x, lambda x: _plus(x, F.shiftleft(x, 31)))


def seeded_hash(key: Column, seed: int, bits: int = 56) -> Column:
    """A family of hashes: the seed is mixed in before the masked one."""
    return hash64(key.cast("bigint").bitwiseXOR(F.lit(seed & ((1 << bits) - 1))).bitwiseAND(F.lit((1 << bits) - 1)), bits)


def adler32(text: Column) -> Column:
    """Checksum of ASCII text: two sums of its bytes, by place and without."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    n = F.length(text).cast("bigint")
    a = F.aggregate(codes, F.lit(1).cast("bigint"), lambda s, c: s + c)
    b = F.aggregate(F.transform(codes, lambda c, i: (n - i) * c), n, lambda s, c: s + c)
    return F.shiftleft(b % ADLER, 16).bitwiseOR(a % ADLER)


def random_text(n: int, seed: Column) -> Column:
    """n letters and digits, the same for the same seed."""
    parts = [F.md5(F.concat(seed.cast("string"), F.lit(f":{j}"))) for j in range(-(-n // 32))]
    return F.substring(F.concat(*parts), 1, n)


def log2_floor(n: Column) -> Column:
    """Position of the highest bit set; 0 for numbers below 2."""
    return F.when(n < 2, 0).otherwise(F.length(F.bin(n.cast("bigint"))) - 1)


def subsequence(seq: Column, start: Column, end: Column) -> Column:
    """Bases from start up to end, cut to the sequence; empty where nothing is left."""
    first, last = F.greatest(start, F.lit(0)), F.least(end, F.length(seq))
    return F.when(first < last, F.substr(seq, (first + 1).cast("int"), (last - first).cast("int"))).otherwise("")


def sampled(key: Column, share: float, seed: int = 0) -> Column:
    """A Bernoulli sample that reruns repeat: by a hash of the key."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32))
