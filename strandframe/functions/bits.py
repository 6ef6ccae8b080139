"""Packed k-mers: two bits for each base, A=0 C=1 G=2 T=3, the first base highest.

Codes are BIGINT up to k = 31; k = 32 takes all 64 bits and is DECIMAL(20,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions.sequence import _col, _positive, reverse_complement

LONGEST = 32


def code_type(k: int) -> str:
    _positive(k, LONGEST)
    return "bigint" if k <= 31 else "decimal(20,0)"


def encode(kmer: Column | str, k: int) -> Column:
    """The code of a k-mer of good bases; case is folded."""
    return F.conv(F.translate(F.upper(_col(kmer)), "ACGT", "0123"), 4, 10).cast(code_type(k))


def decode(code: Column | str, k: int) -> Column:
    """The k-mer of a code, in upper case."""
    code_type(k)
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def bit_reverse_complement(code: Column | str, k: int) -> Column:
    """The code of the reverse complement.

    Up to k = 31 groups of two bits are swapped in five steps of masks and shifts,
    inverted and shifted down.
    """
    if k == 32:
        return encode(reverse_complement(decode(code, k)), k)
    code_type(k)
    x = F.bitwise_not(_col(code).cast("bigint"))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask).cast("bigint")
        x = F.shiftleft(x.bitwiseAND(low), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(low))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def bit_canonical(code: Column | str, k: int) -> Column:
    """STRUCT<code, was_rc> of the lesser of both strands; a palindrome is not was_rc."""
    c, rc = _col(code), bit_reverse_complement(code, k)
    return F.struct(F.least(c, rc).alias("code"), (c > rc).alias("was_rc"))


def bit_minimizer(code: Column | str, k: int, m: int) -> Column:
    """The least over windows of m bases and their reverse complements taken at length k.

    The reverse complement of a window so carries k - m trailing T; the result is
    comparable within one k only.  ``window_minimizer`` takes it at length m.
    """
    if not 1 <= m <= k <= 31:
        raise ValueError(f"1 <= m <= k <= 31 is needed, not m={m}, k={k}")
    return _least(code, k, m, lambda w: bit_reverse_complement(w, k))


def window_minimizer(code: Column | str, k: int, m: int) -> Column:
    """The least code of a window of m bases over both strands."""
    if not 1 <= m <= k <= 31:
        raise ValueError(f"1 <= m <= k <= 31 is needed, not m={m}, k={k}")
    return _least(code, k, m, lambda w: bit_reverse_complement(w, m))


def _least(code: Column | str, k: int, m: int, other) -> Column:
    mask = F.lit((1 << 2 * m) - 1).cast("bigint")
    ws = [F.shiftrightunsigned(_col(code).cast("bigint"), 2 * j).bitwiseAND(mask) for j in range(k - m + 1)]
    both = [x for w in ws for x in (w, other(w))]
    return F.least(*both) if len(both) > 1 else both[0]
