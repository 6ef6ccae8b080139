"""Projections of records: names, lengths, headers, equality and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import _col, normalize


def name(id: Column | str = "id") -> Column:
    """The id before its first white space, of Unicode's."""
    return F.regexp_extract(_col(id), r"(?U)^(\S*)", 1)


def description(id: Column | str = "id") -> Column:
    """What follows the first white space, its left side trimmed; null without white space."""
    return F.when(_col(id).rlike(r"(?U)\s"), F.regexp_replace(_col(id), r"(?U)^\S*\s+", ""))


def num_bases(seq: Column | str = "seq") -> Column:
    return F.length(F.translate(_col(seq), "\r\n", "")).cast("bigint")


def byte_length(seq: Column | str = "seq") -> Column:
    """Bytes of a text column."""
    return F.octet_length(_col(seq)).cast("bigint")


def is_fasta(qual: Column | str = "qual") -> Column:
    return _col(qual).isNull()


def is_fastq(qual: Column | str = "qual") -> Column:
    return _col(qual).isNotNull()


def checked(df: DataFrame) -> DataFrame:
    """Records (id, seq, qual) whose quality, if any, is as long as the sequence; else it raises."""
    fits = F.col("qual").isNull() | (F.octet_length("qual") == F.octet_length("seq"))
    message = F.lit("Sequence and quality strings must have the same length")
    return df.withColumn("seq", F.when(fits, F.col("seq")).otherwise(F.raise_error(message).cast("string")))


def normalized(df: DataFrame, iupac: bool = False) -> DataFrame:
    """Records with their sequence normalized; the quality stays as it is."""
    return df.withColumn("seq", normalize("seq", iupac))


def equal(left: str, right: str) -> Column:
    """Whether two record aliases agree in id, sequence and quality."""
    same = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("id", "seq", "qual")]
    return same[0] & same[1] & same[2]


def record_hash() -> Column:
    return F.xxhash64("id", "seq", F.col("qual").isNull(), "qual")


def record_text(id: Column | str = "id", seq: Column | str = "seq", qual: Column | str = "qual") -> Column:
    """A record as FASTA text without a quality, else as FASTQ text."""
    i, s, q = _col(id), _col(seq), _col(qual)
    return F.when(q.isNull(), F.concat(F.lit(">"), i, F.lit("\n"), s, F.lit("\n"))).otherwise(F.concat(F.lit("@"), i, F.lit("\n"), s, F.lit("\n+\n"), q, F.lit("\n")))


def snippet(c: Column | str, longest: int = 20) -> Column:
    x = _col(c)
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest - 4), F.lit("…"), F.right(x, F.lit(3)))).otherwise(x)


def record_repr(id: Column | str = "id", seq: Column | str = "seq", qual: Column | str = "qual") -> Column:
    """A short display form."""
    shown = F.when(name(id) != _col(id), F.concat(name(id), F.lit("…"))).otherwise(_col(id))
    return F.concat(F.lit("Record(id="), shown, F.lit(", seq="), snippet(seq), F.lit(", qual="), F.coalesce(snippet(qual), F.lit("None")), F.lit(")"))


def mask_header_tabs(id: Column | str = "id") -> Column:
    """Tabs as ``|``; null where there is none."""
    return F.when(F.contains(_col(id), F.lit("\t")), F.translate(_col(id), "\t", "|"))


def mask_header_utf8(id: Column | str = "id") -> Column:
    """A byte-string id with broken UTF-8 as U+FFFD; null where it is valid."""
    raw = F.encode(_col(id), "ISO-8859-1").cast("string")
    return F.when(~F.is_valid_utf8(raw), F.make_valid_utf8(raw))
