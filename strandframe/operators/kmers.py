"""K-mers as row generators.

Each takes a DataFrame and adds columns, a row for each window.  Long sequences
are cut into chunks of ``CHUNK`` starts first, which overlap by k - 1, so no array
of positions grows with a chromosome, and the sequence itself is dropped early.

Windows are cut from binary columns, where a cut costs its own length and not that
of what lies before it.  Bases that are none are blanked, and strands turned, once
for each chunk; the window of the other strand is the mirrored one.  Only built-in
expressions are used, and explode stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import bits
from strandframe.functions.sequence import _positive

CHUNK = 1 << 16
_BLANK = b" "


def _names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of ``df`` has."""
    taken, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"__{i}") not in taken:
            out.append(name)
        i += 1
    return out


def _chunks(df: DataFrame, k: int, whole: Column, n: Column, keep: list[str], at: str, cut: str, chunk: int, width: Column | int = 1) -> DataFrame:
    """Rows (keep, at, cut) of the binary column ``whole`` of ``n`` characters, those of at least k."""
    one = (F.col(at) * chunk * width + 1).cast("int")
    starts = df.where(n >= k).select(*keep, whole.alias(cut), F.explode(F.sequence(F.lit(0), F.floor((n - k) / chunk).cast("int"))).alias(at))
    return starts.select(*keep, (F.col(at) * chunk).alias(at), F.substring(cut, one, F.lit(chunk + k - 1) * width if not isinstance(width, int) else F.lit(chunk + k - 1)).alias(cut))


def kmers(df: DataFrame, k: int, seq: str = "seq", pos: str = "pos", kmer: str = "kmer", keep_seq: bool = False, chunk: int = CHUNK) -> DataFrame:
    """All windows of k characters of any alphabet, with their place from 0."""
    _positive(k)
    rest = [c for c in df.columns if c not in (pos, kmer) and (keep_seq or c != seq)]
    at, cut, p, width, s = _names(df, 5)
    # a character has one byte, or four in a text that has others than ASCII
    text = F.col(seq).cast("string")
    wide = df.select(*rest, text.alias(s), F.when(F.octet_length(text) == F.length(text), 1).otherwise(4).alias(width))
    whole = F.when(F.col(width) == 1, F.col(s).cast("binary")).otherwise(F.encode(F.col(s), "UTF-32"))
    parts = _chunks(wide, k, whole, F.length(s), [*rest, width], at, cut, chunk, F.col(width))
    n = F.floor(F.length(cut) / F.col(width)).cast("int")
    placed = parts.select(*rest, at, cut, width, F.explode(F.sequence(F.lit(0), n - k)).alias(p))
    window = F.substring(cut, F.col(p) * F.col(width) + 1, F.lit(k) * F.col(width))
    return placed.select(*rest, (F.col(at) + F.col(p)).cast("int").alias(pos), F.when(F.col(width) == 1, window.cast("string")).otherwise(F.decode(window, "UTF-32")).alias(kmer))


def _good_windows(df: DataFrame, k: int, seq: str, keep_seq: bool, clean: str, letters: str, other: str | None, new: tuple[str, ...]) -> tuple[DataFrame, list[str], str, str]:
    """(rest, pos, window, window of the other strand) of the windows of good bases, binary.

    ``letters`` are what good bases become; ``other`` are their complements.
    """
    _positive(k)
    rest = [c for c in df.columns if c not in new and (keep_seq or c != seq)]
    at, cut, p, w, r, s = _names(df, 6)
    blanked = F.translate(F.regexp_replace(F.col(seq), "[^ACGTacgt]", " "), "ACGTacgt", clean)
    made = df.select(*rest, blanked.cast("binary").alias(s))
    parts = _chunks(made, k, F.col(s), F.length(s), rest, at, cut, CHUNK)
    turned = F.translate(F.reverse(F.col(cut).cast("string")), letters, other).cast("binary") if other else F.lit(None).cast("binary")
    parts = parts.select(*rest, at, cut, turned.alias(r))
    placed = parts.select(*rest, at, cut, r, F.explode(F.sequence(F.lit(0), F.length(cut) - k)).alias(p))
    found = placed.select(
        *rest, (F.col(at) + F.col(p)).cast("int").alias("pos"), F.substring(cut, F.col(p) + 1, F.lit(k)).alias(w),
        (F.substring(r, F.length(cut) - F.col(p) - k + 1, F.lit(k)) if other else F.lit(None).cast("binary")).alias(r),
    )
    return found.where(~F.contains(F.col(w), F.lit(_BLANK))), rest, w, r


def canonical_kmers(df: DataFrame, k: int, seq: str = "seq", keep_seq: bool = False) -> DataFrame:
    """Windows of good bases as the lesser of both strands; case is kept.

    was_rc is true unless the window itself is the lesser: a palindrome is was_rc.
    """
    found, rest, w, r = _good_windows(df, k, seq, keep_seq, "ACGTacgt", "ACGTacgt", "TGCAtgca", ("pos", "kmer", "was_rc"))
    return found.select(*rest, "pos", F.least(w, r).cast("string").alias("kmer"), (~(F.col(w) < F.col(r))).alias("was_rc"))


def bit_kmers(df: DataFrame, k: int, canonical: bool = False, seq: str = "seq", keep_seq: bool = False) -> DataFrame:
    """Windows of good bases, packed: pos, code, k, was_rc; case is folded, a palindrome is not was_rc."""
    kind = bits.code_type(k)
    found, rest, w, r = _good_windows(df, k, seq, keep_seq, "01230123", "0123", "3210" if canonical else None, ("pos", "code", "k", "was_rc"))
    # digits of equal number are ordered as their codes are
    less = F.least(w, r) if canonical else F.col(w)
    was_rc = F.col(w) > F.col(r) if canonical else F.lit(False)
    return found.select(*rest, "pos", F.conv(less.cast("string"), 4, 10).cast(kind).alias("code"), was_rc.alias("was_rc"), F.lit(k).alias("k"))


def kmer_counts(kmer_rows: DataFrame, kmer: str = "kmer") -> DataFrame:
    """How often each k-mer occurs; Spark sums up before the shuffle, so a frequent one is no hot key."""
    return kmer_rows.groupBy(kmer).agg(F.count("*").alias("n"))


def kmer_totals(kmer_rows: DataFrame) -> DataFrame:
    """n_kmers, and n_forward: those whose own strand was the lesser."""
    return kmer_rows.agg(F.count("*").alias("n_kmers"), F.count_if(~F.col("was_rc")).alias("n_forward"))
