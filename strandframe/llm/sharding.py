"""Sharding along a Hilbert curve.

Method: several metadata dimensions (source, language, length) are quantised to
``BITS`` bits each, source and language by the rank of their value, so that near
cells hold near values; rows are sorted by the index of their cell on the Hilbert
curve through these dimensions, and runs of equally many rows are cut into
shards.  Neighbours on the curve are neighbours in every dimension, so a shard's
ranges are narrow in all of them and readers can skip files by any.

Everything is DataFrame functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm._shared import staged

SHARDS = 40
BITS = 6
HEADER = 16  #: bytes that a row has beside its text


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state and cell of a level: the digit on the curve, and the next state.

    A state is an entry corner and a direction (corner * dims + direction); a cell
    is the bits of the point at that level, dimension 0 the lowest bit.
    """
    n = 1 << dims
    gray = [w ^ w >> 1 for w in range(n)]
    place = {g: w for w, g in enumerate(gray)}
    turn = lambda x, k: (x << k % dims | x >> dims - k % dims) & n - 1
    ones = lambda w: (~w & w + 1).bit_length() - 1  # noqa: E731  trailing ones
    enter = lambda w: 0 if w == 0 else gray[2 * ((w - 1) // 2)]
    along = lambda w: 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
    digits, after = [], []
    for corner in range(n):
        for direction in range(dims):
            for cell in range(n):
                w = place[turn(cell ^ corner, dims - (direction + 1) % dims)]
                digits.append(w)
                after.append((corner ^ turn(enter(w), direction + 1)) * dims + (direction + along(w) + 1) % dims)
    return digits, after


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """The index on the Hilbert curve of a point with integer coordinates below ``2 ** bits``."""
    digits, after = curve_tables(len(dims))
    n = 1 << len(dims)
    digit, state = F.array(*map(F.lit, digits)), F.array(*map(F.lit, after))
    point = F.array(*(d.cast("int") for d in dims))

    def step(acc: Column, level: Column) -> Column:
        cell = F.lit(0)
        for k in range(len(dims)):
            cell = cell + F.call_function("shiftright", point[k], level).bitwiseAND(F.lit(1)) * (1 << k)
        at = acc["state"] * n + cell
        return F.struct(F.get(state, at).alias("state"), (acc["index"] * n + F.get(digit, at)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["index"])


def dimensions(source: Column, lang: Column, size: Column, bits: int = BITS) -> list[Column]:
    """Source and language by the place of their value (0 to 1; null as -1), and the length on a logarithmic scale."""
    top = (1 << bits) - 1
    by_place = lambda c: F.when(c < 0, 0).otherwise(F.least(F.lit(top), 1 + F.floor(c * top))).cast("int")
    return [by_place(source), by_place(lang), F.least(F.lit(top), F.floor(3 * F.log2(size))).cast("int")]


def _places(rows: DataFrame, column: str) -> DataFrame:
    """(value, place) of the distinct values of a column: their rank in order over their number.

    They are dealt out and ranked as rows are, however many there are.
    """
    values = ordered(rows.select(F.col(column).alias("value")).where("value is not null").distinct(), ["value"])
    return values.select("value", (F.col("rank") / F.col("total")).alias("place"))


def ordered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Add ``rank`` (0 to n - 1 along ``key``) and ``total`` (n).

    Rows are dealt out by ranges of the key, which Spark balances by sampling, and
    written with the number of their range to the shared folder, so that the
    number does not change when a task is run again.  A range's rows are then
    ranked by themselves, after the counts of all ranges before it.
    """
    dealt = staged(rows.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).withColumn("total", F.sum("__n").over(Window.partitionBy()))
    inner = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*key)))
    return inner.join(counts.drop("__n"), "__part").withColumn("rank", F.col("__before") + F.col("__row") - 1).drop("__part", "__row", "__before")


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of each row.

    size is the text's UTF-8 bytes plus ``HEADER``; a null text has none, and the
    crc of nothing, 0.  The law is ``rows``: shards differ by one row at most, and
    slots count a shard's rows without gaps.  Ties on the curve follow a hash of
    doc_id, doc_id (null first) and the crc; repeated rows take neighbouring slots.
    Groups of equal texts may lie in several shards.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    made = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(t) + HEADER).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    for c in ("source", "lang"):
        known = _places(docs.select(F.col(c).cast("string").alias(c)), c)
        made = made.join(known.withColumnRenamed("value", c), c, "left").withColumn(c, F.coalesce("place", F.lit(-1.0))).drop("place")
    made = made.select("doc_id", "size", "text_crc32", curve_index(dimensions(F.col("source"), F.col("lang"), F.col("size"))).alias("curve"), F.xxhash64("doc_id").alias("__h"))
    ranked = ordered(made, ["curve", "__h", "doc_id", "text_crc32"])
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    slot = F.expr(f"rank - (shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
