"""Writers of FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.sequence import _col

ENDINGS = {"unix": "\n", "windows": "\r\n"}


def ending(line_ending: Column | str) -> Column:
    """The bytes of a line ending column."""
    return F.when(_col(line_ending) == "windows", "\r\n").otherwise("\n")


def fasta_text(id: Column | str, seq: Column | str, eol: Column | str = "\n") -> Column:
    """``>id``, the sequence as it is, without the last line end."""
    e = F.lit(eol) if isinstance(eol, str) else eol
    return F.concat(F.lit(">"), _col(id), e, _col(seq))


def fastq_text(id: Column | str, seq: Column | str, qual: Column | str | None = None, eol: Column | str = "\n") -> Column:
    """Four lines with a bare ``+``, without the last line end; a missing quality is all ``I``."""
    e = F.lit(eol) if isinstance(eol, str) else eol
    q = F.repeat(F.lit("I"), F.length(_col(seq)))
    q = F.coalesce(_col(qual), q) if qual is not None else q
    return F.concat(F.lit("@"), _col(id), e, _col(seq), e, F.lit("+"), e, q)


def record_bytes(forced: str | None = None) -> Column:
    """A parsed record in its own format, without the last line end.

    FASTA keeps the line ends within its sequence, even if another is forced.
    """
    e = F.lit(ENDINGS[forced]) if forced else ending("line_ending")
    return F.when(F.col("format") == "fasta", fasta_text("id", "raw_seq", e)).otherwise(fastq_text("id", "seq", "qual", e))


def _write(df: DataFrame, text: Column, path: str, eol: str, mode: str, compression: str | None) -> None:
    # a byte string becomes its bytes again
    out = df.select(F.encode(text, "ISO-8859-1").cast("string").alias("value"))
    writer = out.write.mode(mode).option("lineSep", eol)
    (writer.option("compression", compression) if compression else writer).text(path)


def write_fasta(df: DataFrame, path: str, id: str = "id", seq: str = "seq", line_ending: str = "unix", mode: str = "errorifexists", compression: str | None = None) -> None:
    eol = ENDINGS[line_ending]
    _write(df, fasta_text(id, seq, eol), path, eol, mode, compression)


def write_fastq(df: DataFrame, path: str, id: str = "id", seq: str = "seq", qual: str | None = "qual", line_ending: str = "unix", mode: str = "errorifexists", compression: str | None = None) -> None:
    eol = ENDINGS[line_ending]
    _write(df, fastq_text(id, seq, qual, eol), path, eol, mode, compression)


def write_records(df: DataFrame, path: str, line_ending: str | None = None, mode: str = "errorifexists", compression: str | None = None) -> None:
    """Parsed records in their formats, each with its own line ending unless one is forced."""
    last = F.lit(ENDINGS[line_ending]) if line_ending else ending("line_ending")
    text = F.concat(record_bytes(line_ending), F.when(last == "\r\n", "\r").otherwise(""))
    _write(df, text, path, "\n", mode, compression)
