"""Mixing sources to target weights.

Method: a low-discrepancy schedule.  Points of the golden-ratio sequence are
mapped through the cumulative weights of the sources, which gives each slot of
the schedule a source; slots are ranked by source, and the slot of rank r takes
block r of its source.  Blocks hold equally many words of the source's documents
in a shuffled order, and start over after the last one, up to ``MOST_PASSES``.

Slots beyond what a source's target needs are void, and what the finite sequence
still owes a source is appended, so each source gives its target to the word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm._shared import fresh, staged

WEIGHTS = (5, 2, 1)  #: of the sources by name, repeating
SHARE = 1.5  #: words of the mix, as a multiple of all words
MOST_PASSES = 2
LARGEST_BLOCK = 65536  #: words
SLOTS = 16384  #: of a mix whose blocks are smaller than that
GOLDEN = 0.6180339887498949
_IN_BUCKET, _MOST_BITS, _FULL_BUCKET = 64, 17, 1 << 20  #: documents of the shuffled order that are summed up together: few, until there are many buckets
_CHUNK, _CHUNKS = 256, 100_000  #: slots ranked together at least, and chunks at most
_SPACES = r"[^\x20\x09-\x0D]+"


def _key(c: str) -> Column:
    return F.struct(F.col(c).isNull(), F.coalesce(c, F.lit("")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, number, source_size, target, block, need, n_blocks) of ``sizes(source, size)``.

    Sources are numbered by code point, null last.  The target is share of all
    words by weight, at most ``MOST_PASSES`` times the source's words; the excess
    goes to the others by weight.  So there is one level: target = the lesser of
    the cap and level times weight.  One row for each source is all this handles.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("full", "number")
    every = Window.partitionBy()
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
    one = one.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long"))
    one = one.withColumn("cap", MOST_PASSES * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("words", F.sum("source_size").over(every))
    rest = F.lit(share) * F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    one = one.withColumn("level", rest / open_weight)
    one = one.withColumn("level", F.max(F.when(F.col("full") > F.col("level"), F.col("level"))).over(every))
    one = one.withColumn("target", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))))
    one = one.withColumn("quota", F.floor(F.col("target") + 0.5))
    one = one.withColumn("block", F.least(F.lit(LARGEST_BLOCK), F.greatest(F.lit(1), F.floor(F.sum("quota").over(every) / SLOTS))).cast("long"))
    n_blocks = F.ceil(F.col("source_size") / F.col("block"))
    need = F.expr("case when source_size = 0 then 0 else quota div source_size * ceil(source_size / block) + ceil(quota % source_size / block) end")
    return one.select("source", "number", "source_size", "target", "quota", "block", n_blocks.cast("long").alias("n_blocks"), need.cast("long").alias("need"))


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, number, rank, pass, block_no, words): which block each slot takes, and how much of it.

    ``sources`` is what ``targets`` returns.  The mix reads the slots in order.
    """
    spark = sources.sparkSession
    placed = sources.where("need > 0").withColumn("high", F.sum("need").over(Window.orderBy("number"))).withColumn("low", F.col("high") - F.col("need"))
    total = placed.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n"), F.count("*").alias("m")).first()
    n, cells = int(total["n"]), max(1, 4 * int(total["m"]))
    # a point meets the sources of its cell only
    width = n / cells
    spans = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.least(F.floor(F.col("high") / width), F.lit(cells - 1))))) if n else placed.withColumn("cell", F.lit(0).cast("long"))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.lit(float(n)) * ((F.col("id") * F.lit(GOLDEN)) % 1.0)).alias("at"))
    points = points.withColumn("cell", F.least(F.floor(F.col("at") / (width or 1)), F.lit(cells - 1)))
    chunk = max(_CHUNK, -(-n // _CHUNKS))
    met = points.join(spans.select("cell", "low", "high", "number"), "cell").where("at >= low and at < high").select("slot", "number", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = met.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("number").orderBy("chunk")) - F.col("n"))
    ranked = met.withColumn("in_chunk", F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot"))).join(counts.select("number", "chunk", "base"), ["number", "chunk"])
    ranked = ranked.select("slot", "number", (F.col("base") + F.col("in_chunk") - 1).alias("rank"))
    got = counts.groupBy("number").agg(F.sum("n").alias("got"))
    owed = placed.join(got, "number", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    owed = owed.select((F.lit(n) + F.col("low")).alias("first"), "number", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")).select((F.col("first") + F.col("rank")).alias("slot"), "number", "rank")
    every = ranked.unionByName(owed).join(sources.select("number", "source_size", "quota", "block", "n_blocks", "need"), "number").where("rank < need")
    every = every.withColumn("pass", F.expr("rank div n_blocks")).withColumn("block_no", F.col("rank") % F.col("n_blocks"))
    whole = F.least(F.col("block"), F.col("source_size") - F.col("block_no") * F.col("block"))
    left = F.col("quota") - F.col("pass") * F.col("source_size") - F.col("block_no") * F.col("block")
    return every.select("slot", "number", "rank", "pass", "block_no", F.least(whole, left).alias("words"))


def blocks(placed: DataFrame) -> DataFrame:
    """The pieces (block_no, low, high) of each document; low and high count words within the block.

    ``placed`` has number, start (words of its source before the document), size
    and block (words of a block).
    """
    cut = placed.where("size > 0").withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    base = F.col("block_no") * F.col("block")
    return cut.withColumn("low", F.greatest(F.col("start") - base, F.lit(0))).withColumn("high", F.least(F.col("start") + F.col("size") - base, F.col("block")))


def mixed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken and the words of each pass.

    One row for each row of ``docs``.  A null text has no words and nothing is taken
    of it; null sources are one source, the last.  Repeated rows stand next to each
    other in the shuffled order and each gives its own words.  An empty table gives
    an empty result.  Reruns agree: the order within a source is that of a hash of
    doc_id, ties by doc_id and a hash of the text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    sizes = docs.select(
        "doc_id", F.col(source).cast("string").alias("source"), F.regexp_count(t, F.lit(_SPACES)).cast("long").alias("size"),
        F.xxhash64(t).alias("text_hash"), F.xxhash64(F.lit("mix"), "doc_id").alias("order"),
    )
    sizes = staged(sizes, "sizes")
    power = lambda x: math.ceil(math.log2(max(x, 2)))
    rows = sizes.count()
    bits = max(min(power(rows / _IN_BUCKET), _MOST_BITS), power(rows / _FULL_BUCKET))
    sources = staged(targets(sizes.select("source", "size")), "sources")
    known = sources.select(_key("source").alias("k"), "number", "source_size", "target", "block")
    own = sizes.withColumn("k", _key("source")).join(known, "k").drop("k").withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
    # the words before a document: those of earlier buckets, then those before it in its own
    sums = own.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("number").orderBy("bucket")) - F.col("n")).drop("n")
    here = Window.partitionBy("number", "bucket").orderBy("order", "doc_id", "text_hash")
    inner = own.withColumn("turn", F.row_number().over(here)).withColumn("in_bucket", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = inner.join(sums, ["number", "bucket"]).withColumn("start", F.col("base") + F.col("in_bucket")).drop("base", "in_bucket")
    placed = staged(placed, "placed")
    slots = schedule(sources).groupBy("number", "block_no").agg(*(F.coalesce(F.sum(F.when(F.col("pass") == p, F.col("words"))), F.lit(0)).alias(f"w{p}") for p in range(MOST_PASSES)))
    pieces = blocks(placed.select("number", "bucket", "turn", "start", "size", "block")).join(slots, ["number", "block_no"])
    part = lambda p: F.sum(F.greatest(F.lit(0), F.least(F.col("high"), F.col(f"w{p}")) - F.col("low"))).alias(f"taken_{p + 1}")
    taken = pieces.groupBy("number", "bucket", "turn").agg(*map(part, range(MOST_PASSES)))
    out = placed.join(taken, ["number", "bucket", "turn"], "left")
    each = [F.coalesce(f"taken_{p + 1}", F.lit(0)) for p in range(MOST_PASSES)]
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", sum(each[1:], each[0]).cast("long").alias("taken"), *(c.cast("long").alias(f"taken_{p + 1}") for p, c in enumerate(each)))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # a piece ends where a word ends
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame) -> DataFrame:
    """The rows of the mix, columns as they are: a row once for each pass that takes words of it.

    A pass takes a source's documents whole but for its last one, of which it takes
    the first words: there the text ends after them, and ``n_chars``, if there is such
    a column, says its new length.  So the words of the rows are those of the mix.
    Rows without words are left out.  Rows that agree in doc_id, source and text
    take words one after another.
    """
    words = [f"taken_{p + 1}" for p in range(MOST_PASSES)]
    plan = mixed(docs).groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("rows"), F.max("size").alias("size"), *(F.sum(w).alias(w) for w in words))
    plan = staged(plan.where("taken_1 > 0"), "mix")
    names = fresh(docs, "mix_id", "mix_source", "mix_hash", "mix_rows", "mix_size", "mix_words", "mix_turn")
    key, of = names[:3], dict(zip(("rows", "size", "words", "turn"), names[3:]))
    known = plan.select(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("text_hash").alias(key[2]), F.col("rows").alias(of["rows"]), F.col("size").alias(of["size"]), F.array(*words).alias(of["words"]))
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = docs["doc_id"].eqNullSafe(F.col(key[0])) & docs["source"].cast("string").eqNullSafe(F.col(key[1])) & (F.xxhash64(t) == F.col(key[2]))
    # words of a row: all rows give all, or the one row there is gives some; else rows take turns
    even = F.forall(F.col(of["words"]), lambda w: (w == 0) | (w == F.col(of["rows"]) * F.col(of["size"])))
    simple = (F.col(of["rows"]) == 1) | even

    def taken(rows: DataFrame, turn: Column) -> DataFrame:
        share = F.transform(F.col(of["words"]), lambda w: F.greatest(F.lit(0), F.least(F.col(of["size"]), w - turn * F.col(of["size"]))))
        each = rows.withColumn(of["words"], F.explode(F.filter(share, lambda w: w > 0)))
        part = F.col(of["words"]) < F.col(of["size"])
        cut = F.when(part, first_words(F.col("text").cast("string"), F.col(of["words"]))).otherwise(F.col("text"))
        out = {c: cut if c == "text" else F.when(part, F.length(cut)).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in docs.columns}
        return each.select(*(x.cast(docs.schema[c].dataType).alias(c) for c, x in out.items()))

    whole = F.when(even & (F.col(of["rows"]) > 1), F.transform(F.col(of["words"]), lambda w: F.when(w > 0, F.col(of["size"])).otherwise(F.lit(0).cast("long")))).otherwise(F.col(of["words"]))
    result = taken(docs.join(known.where(simple).withColumn(of["words"], whole), same), F.lit(0))
    odd = known.where(~simple)
    if odd.isEmpty():
        return result
    turns = Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    met = docs.join(odd, same).withColumn(of["turn"], F.row_number().over(turns) - 1)
    return result.unionByName(taken(met, F.col(of["turn"])))
