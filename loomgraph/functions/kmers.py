"""Expressions over k-mers. A k-mer is a string of ACGT; its canonical form is the larger of it and its reverse complement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = ("ACGT" * 7)[:26]


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    return F.greatest(s, reverse_complement(s))


def is_canonical(s: Column) -> Column:
    return s >= reverse_complement(s)


def code(base: Column) -> Column:
    return F.instr(F.lit("ACGT"), base) - 1


def arc_slot(base: Column, forward: Column) -> Column:
    """0 to 3 for arcs that leave the canonical form, 4 to 7 for those that leave its reverse complement."""
    return (code(base) + F.when(forward, 0).otherwise(4)).cast("int")


def oriented(kmer: Column, slot: Column) -> Column:
    """The k-mer as an arc in that slot leaves it."""
    return F.when(slot < 4, kmer).otherwise(reverse_complement(kmer))


def text_to_bases(text: Column) -> Column:
    """A stand-in for DNA: letters become bases by their place in the alphabet, anything else A."""
    return F.regexp_replace(F.translate(text, LETTERS + LETTERS.upper(), AS_BASES * 2), "[^ACGT]", "A")


def sanitized(seq: Column) -> Column:
    """DNA in upper case; what is no base reads as A."""
    return F.regexp_replace(F.translate(F.rtrim(seq, F.lit("\r")), "acgt", "ACGT"), "[^ACGT]", "A")


def encode(kmer: Column) -> Column:
    """Two bits a base, first base highest; null for k over 31, which does not fit a long."""
    kmer = F.when(F.length(kmer) <= 31, kmer)
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def decode(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def partition_hash(kmer: Column) -> Column:
    """Base-19 polynomial over the bytes of the smaller strand, modulo 2^32; the same for both strands.

    The strand is packed at two bits a base, first base highest, and its bytes are taken from the lowest on.
    """
    small = F.least(kmer, reverse_complement(kmer))
    n = F.ceil(F.length(small) / 4).cast("int")
    padded = F.lpad(small, n * 4, F.lit("A"))
    digits = F.transform(F.sequence(n - 1, F.lit(0)), lambda b: encode(F.substring(padded, b * 4 + 1, F.lit(4))))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * 19 + c) % (1 << 32))
