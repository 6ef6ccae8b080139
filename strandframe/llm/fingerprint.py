"""Quartile bucket digests of documents and their likeness.

Method: triplets of bytes within a window of five are hashed into 256 buckets.
The digest holds, in hex, a byte for the length on a logarithmic scale, a byte
for the ratios of the quartiles of the bucket counts, and two bits a bucket for
the quartile that its count lies in.  Texts under five bytes are filled up with
zeros, so that what they have is counted too.  The difference of two digests adds
up the differences of these parts, those of the buckets as a share of what buckets
dealt at random would differ by, and is bounded; likeness is its complement to 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm._shared import prepare_python, staged

BUCKETS = 256
WORST = 640  #: differences from here on count as no likeness at all
BLOCK = 1 << 20
_LAGS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_MADE = np.random.RandomState(20240229)
_FIRST, _SECOND, _THIRD = (_MADE.permutation(256).astype(np.uint8) for _ in range(3))
_SALTS = _MADE.permutation(256)[: len(_LAGS)].astype(np.uint8)
_SPREAD = _MADE.permutation(256).astype(np.uint8)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket, over all of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(raw) - 4), BLOCK):
        part = raw[at : at + BLOCK + 4]
        n = len(part) - 4
        a, b, c = _FIRST[part[:n]], _SECOND[part], _THIRD[part]
        for (i, j), salt in zip(_LAGS, _SALTS):
            out += np.bincount(_SPREAD[a ^ b[i : i + n] ^ salt] ^ c[j : j + n], minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    """The fingerprint of some bytes: 2 + 2 + 128 hex digits."""
    counts = bucket_counts(data.ljust(5, b"\0") if data else data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = (int(100 * q1 / q3) % 16) << 4 | int(100 * q2 / q3) % 16 if q3 else 0
    return bytes([length, ratios, *packed.tolist()]).hex()


_GAPS = np.abs(np.arange(4)[:, None] - np.arange(4))
_GAPS = _GAPS + 3 * (_GAPS == 3)  #: what two quartiles differ by


def difference(left: str, right: str) -> int:
    """0 for equal fingerprints, at most ``WORST``, which unrelated ones reach or come near to."""
    a, b = np.frombuffer(bytes.fromhex(left), np.uint8), np.frombuffer(bytes.fromhex(right), np.uint8)
    length = abs(int(a[0]) - int(b[0]))
    score = length if length <= 1 else 6 * length
    for shift in (4, 0):
        gap = abs((int(a[1]) >> shift & 15) - (int(b[1]) >> shift & 15))
        score += min(gap, 16 - gap)
    shifts = np.array([6, 4, 2, 0], np.uint8)
    mine, other = (a[2:, None] >> shifts & 3).ravel(), (b[2:, None] >> shifts & 3).ravel()
    apart = int(_GAPS[mine, other].sum())
    if apart:
        score += round(WORST * apart * BUCKETS / int(np.bincount(mine, minlength=4) @ _GAPS @ np.bincount(other, minlength=4)))
    return min(score, WORST)


def likeness(left: str, right: str) -> float:
    return 1 - difference(left, right) / WORST


def fingerprints(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column; null counts as empty."""
    prepare_python(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != to] + [T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n != to]
            made = pa.array([digest((t or "").encode()) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], names=[*names, to])

    return df.mapInArrow(run, schema)


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_EDGE = f"part int, {_ROW}, head_text string, head_fingerprint string, tail_text string"


def _judged(doc_id, text: str, own: str, after: str, after_own: str) -> tuple:
    n = len(text)
    k = n // 3
    edited = (text[: n - k] + after[:k]).encode()
    changed = digest(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, after_own)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is the one that follows in descending doc_id, the first
    after the last; the edit replaces the last third of a text by as much of the
    next text's beginning.  Ties in doc_id follow the text, so repeated rows stand
    next to each other; null ids come last, null texts count as empty, and an
    empty table gives an empty result.  A lone document is its own next.

    Texts are dealt out once, by ranges of doc_id, and each task goes through its
    range in order.  Only the last row of a range needs a row of another one: the
    ranges' ends go to a table in the shared folder beside the finished rows, two
    texts for each range, and are joined by the number of the range.
    """
    prepare_python(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    dealt = texts.repartitionByRange(order[0]).sortWithinPartitions(*order)  # a sample of the ids alone goes to the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, last = TaskContext.get().partitionId(), None, None
        names = ["part", *_NAMES, "head_text", "head_fingerprint", "tail_text"]

        def table(rows, edge=(None, None, None)):
            out = [(part if edge[0] is not None else None, *r, *edge) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.string()] * 3]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = doc_id, text, digest(text.encode()) if not last or text != last[1] else last[2]
                if last:
                    rows.append(_judged(*last, text, now[2]))
                head, last = head or now, now
            if rows:
                yield table(rows)
        if last:
            yield table([(last[0], None, None, last[2], None, None, None)], (head[1], head[2], last[1]))

    found = staged(dealt.mapInArrow(run, _EDGE), "fingerprints")
    inner = found.where("part is null").select(*_NAMES)
    edges = found.where("part is not null")
    # one row for each range of doc_id: its number and that of the next range
    turn = edges.select("part").withColumn("after", F.lead("part").over(Window.orderBy("part"))).withColumn("least", F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    turn = turn.select("part", F.coalesce("after", "least").alias("after"))
    heads = edges.select(F.col("part").alias("after"), F.col("head_text").alias("next_text"), F.col("head_fingerprint").alias("next_fingerprint"))
    ends = edges.select("part", "doc_id", "tail_text", "fingerprint").join(turn, "part").join(heads, "after").select("doc_id", "tail_text", "fingerprint", "next_text", "next_fingerprint")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        for batch in batches:
            rows = [_judged(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    return inner.unionByName(ends.mapInArrow(close, _ROW))
