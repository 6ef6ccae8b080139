"""Nucleotide functions: columns of byte strings in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.schema import COMPLEMENT_FROM, COMPLEMENT_TO


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_string(c: Column | str) -> Column:
    """One character for each byte of a binary or text column."""
    return F.decode(_col(c).cast("binary"), "ISO-8859-1")


def public_text(c: Column | str) -> Column:
    """A byte string as text: its bytes as UTF-8, broken ones as U+FFFD."""
    return F.make_valid_utf8(F.encode(_col(c), "ISO-8859-1").cast("string"))


def normalize(seq: Column | str, iupac: bool = False) -> Column:
    """Upper case; white space dropped, U to T, ``.`` and ``~`` to ``-``, all else to N.

    Ambiguity codes are kept if ``iupac`` says so.
    """
    codes = "BDHVRYSWKM" if iupac else ""
    found = F.translate(_col(seq), "acgtuU.~" + codes.lower() + " \t\r\n", "ACGTTT--" + codes)
    return F.regexp_replace(found, f"[^ACGTN\\-{codes}]", "N")


def normalize_changed(seq: Column | str, iupac: bool = False) -> Column:
    """Whether normalize gives another sequence."""
    return normalize(seq, iupac) != _col(seq)


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), COMPLEMENT_FROM, COMPLEMENT_TO)


def canonical(seq: Column | str) -> Column:
    """The lesser, by bytes, of a sequence and its reverse complement."""
    return F.least(_col(seq), reverse_complement(seq))


def minimizer(seq: Column | str, length: int) -> Column:
    """The least window of either strand; null if the sequence is shorter.

    Both strands are built once for each row, and cut as bytes if all are ASCII.
    """
    _positive(length)
    s = _col(seq)
    places = F.sequence(F.lit(1), F.length(s) - length + 1)
    least = lambda a, b: lambda p: F.least(F.substring(a, p, F.lit(length)), F.substring(b, p, F.lit(length)))
    both = lambda kind: F.array(F.struct(s.cast(kind).alias("a"), reverse_complement(s).cast(kind).alias("b"), places.alias("p")))
    # a lambda's variable holds the strands, which else were built for each window
    found = lambda kind: F.element_at(F.transform(both(kind), lambda t: F.array_min(F.transform(t["p"], least(t["a"], t["b"])))), 1).cast("string")
    narrow = F.octet_length(s) == F.length(s)
    return F.when(F.length(s) >= length, F.when(narrow, found("binary")).otherwise(found("string")))


def strip_returns(seq: Column | str) -> Column:
    return F.translate(_col(seq), "\r\n", "")


def is_good(seq: Column | str) -> Column:
    """Whether all bytes are A, C, G or T of either case; an empty sequence is not."""
    return (F.length(_col(seq)) > 0) & (F.translate(_col(seq), "ACGTacgt", "") == "")


def _positive(k: int, most: int | None = None) -> None:
    if not isinstance(k, int) or k < 1 or most and k > most:
        raise ValueError(f"a length of {'at least 1' if not most else f'1 to {most}'} is needed, not {k!r}")
