"""Record schema and the constants that sequence functions share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Complements of nucleotide codes, by place.  Fixed values.
COMPLEMENT_FROM = "ACGTacgtRYKMBVDHrykmbvdh"
COMPLEMENT_TO = "TGCAtgcaYRMKVBHDyrmkvbhd"

ERROR = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("msg", T.StringType()), T.StructField("line", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("format", T.StringType()),
])

#: One row for each record; sequences are byte strings: one character for each byte (ISO-8859-1).
RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("format", T.StringType()), T.StructField("record_idx", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("raw_seq", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()),
    T.StructField("line_ending", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("start_byte", T.LongType()), T.StructField("error", ERROR),
])


class FastxError(Exception):
    """A parsing error in FAILFAST mode."""
