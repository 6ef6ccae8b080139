"""SQL names of the column functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandframe.schema import COMPLEMENT_FROM, COMPLEMENT_TO

_RC = f"translate(reverse(s), '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')"
_STRICT = r"regexp_replace(translate(s, 'acgtuU.~ \t\r\n', 'ACGTTT--'), '[^ACGTN\\-]', 'N')"
_IUPAC = r"regexp_replace(translate(s, 'acgtuU.~bdhvryswkm \t\r\n', 'ACGTTT--BDHVRYSWKM'), '[^ACGTN\\-BDHVRYSWKM]', 'N')"
_RC_WINDOW = f"translate(reverse(substring(s, p, m)), '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')"
_SCORES = "transform(filter(split(q, ''), c -> c <> ''), c -> ascii(c) - offset)"
_CUT = "filter(split(substring({}, 1, least(length(s), length(q))), ''), c -> c <> '')"
_POSITIONS = "case when length(s) >= k then sequence(0, length(s) - k) else array() end"


def _windows(clean: str, letters: str, other: str) -> str:
    """Place, window and window of the other strand of the windows of bases; what is none is blanked, and strands are turned, once a sequence."""
    strands = f"transform(array(translate(regexp_replace(s, '[^ACGTacgt]', ' '), 'ACGTacgt', '{clean}')), b -> struct(cast(b as binary) as f, cast(translate(reverse(b), '{letters}', '{other}') as binary) as t))"
    return f"filter(flatten(transform({strands}, x -> transform({_POSITIONS}, p -> struct(p as p, substring(x.f, p + 1, k) as w, substring(x.t, length(s) - p - k + 1, k) as r)))), x -> not contains(x.w, X'20'))"


def _turned(x: str) -> str:
    """The 32 groups of two bits of a BIGINT in the other order."""
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = f"(shiftleft({x} & {mask}L, {shift}) | (shiftrightunsigned({x}, {shift}) & {mask}L))"
    return x


# Functions that return tables hold one generator, and the outer row is read within it only: else Spark joins their rows to the outer ones by sequence.
FUNCTIONS = {
    "seq_normalize": f"(s string, iupac boolean) returns string return if(iupac, {_IUPAC}, {_STRICT})",
    "seq_complement": f"(s string) returns string return translate(s, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}')",
    "seq_reverse_complement": f"(s string) returns string return {_RC}",
    "seq_canonical": f"(s string) returns string return least(s, {_RC})",
    "seq_strip_returns": r"(s string) returns string return translate(s, '\r\n', '')",
    "kmer_encode": "(s string) returns bigint return cast(conv(translate(upper(s), 'ACGT', '0123'), 4, 10) as bigint)",
    "kmer_decode": "(code bigint, k int) returns string return translate(lpad(conv(cast(code as string), 10, 4), k, '0'), '0123', 'ACGT')",
    "seq_minimizer": f"(s string, m int) returns string return case when length(s) >= m then array_min(transform(sequence(1, length(s) - m + 1), p -> least(substring(s, p, m), {_RC_WINDOW}))) end",
    "seq_num_bases": r"(s string) returns bigint return cast(length(translate(s, '\r\n', '')) as bigint)",
    "record_name": r"(id string) returns string return regexp_extract(id, '(?U)^(\\S*)', 1)",
    "record_description": r"(id string) returns string return case when id rlike '(?U)\\s' then regexp_replace(id, '(?U)^\\S*\\s+', '') end",
    "mask_header_tabs": r"(id string) returns string return case when contains(id, '\t') then translate(id, '\t', '|') end",
    "phred_decode": f"(q string, offset int) returns array<int> return if(exists({_SCORES}, x -> x < 0), raise_error(concat('a Phred score is below the offset ', offset)), {_SCORES})",
    "seq_quality_mask": f"(s string, q string, score int) returns string return array_join(zip_with({_CUT.format('s')}, {_CUT.format('q')}, (b, x) -> if(ascii(x) < score, 'N', b)), '')",
    "seq_kmers": f"(s string, k int) returns table (pos int, kmer string) return select pos, kmer from inline(transform({_POSITIONS}, p -> struct(p as pos, substring(s, p + 1, k) as kmer)))",
    "seq_canonical_kmers": f"(s string, k int) returns table (pos int, kmer string, was_rc boolean) return select p, cast(least(w, r) as string), not (w < r) from inline({_windows('ACGTacgt', 'ACGTacgt', 'TGCAtgca')})",
    "bit_reverse_complement": f"(code bigint, k int) returns bigint return case when k between 1 and 31 then shiftrightunsigned({_turned('~code')}, 64 - 2 * k) end",
    "seq_bit_kmers": f"(s string, k int) returns table (pos int, code bigint, was_rc boolean) return select p, cast(conv(cast(least(w, r) as string), 4, 10) as bigint), w > r from inline({_windows('01230123', '0123', '3210')})",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``; those that return tables are for LATERAL."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
