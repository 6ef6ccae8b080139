"""Phred qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions.sequence import _col

OFFSETS = {"phred33": 33, "phred64": 64}


def _offset(encoding: str | int) -> int:
    offset = OFFSETS.get(encoding, encoding)
    if offset not in (33, 64):
        raise ValueError(f"phred33 or phred64 is needed, not {encoding!r}")
    return offset


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _first_low(qual: Column, offset: int) -> Column:
    low = "".join(f"\\x{b:02x}" for b in (0, offset - 1))
    return F.regexp_extract(qual, f"(?s)([{low[:4]}-{low[4:]}])", 1)


def decode_phred(qual: Column | str, encoding: str | int = "phred33") -> Column:
    """ARRAY<INT> of bytes less the offset; a byte below it raises.  Null stays null."""
    q, offset = _col(qual), _offset(encoding)
    low = _first_low(q, offset)
    message = F.concat(F.lit("Phred score "), F.ascii(low).cast("string"), F.lit(f" is below the offset {offset}"))
    return F.when(low != "", F.raise_error(message).cast("array<int>")).otherwise(try_decode_phred(q, offset))


def try_decode_phred(qual: Column | str, encoding: str | int = "phred33") -> Column:
    """As decode_phred, but null where a byte is below the offset."""
    q, offset = _col(qual), _offset(encoding)
    return F.when(_first_low(q, offset) == "", F.transform(_letters(q), lambda c: (F.ascii(c) - offset).cast("int")))


def quality_mask(seq: Column | str, qual: Column | str, score: int | str) -> Column:
    """``seq`` with N where the quality's byte is below ``score``, cut to the shorter of both.

    ``score`` is an undecoded byte, or the character that it is.
    """
    least = ord(score) if isinstance(score, str) else score
    n = F.least(F.length(_col(seq)), F.length(_col(qual)))
    cut = lambda c: _letters(F.substring(_col(c), F.lit(1), n))
    return F.array_join(F.zip_with(cut(seq), cut(qual), lambda b, q: F.when(F.ascii(q) < least, "N").otherwise(b)), "")
