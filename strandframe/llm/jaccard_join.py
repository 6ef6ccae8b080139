"""Exact near-duplicate join on word n-grams.

Method: multiple-global-order filtering.  Under any total order of the n-grams
that holds for all documents, two sets with a Jaccard similarity of at least t
share an n-gram within their first n - ceil(t n) + 1.  Candidates come from one
order and must share such prefixes under two further orders before they are
verified on their texts.

All orders put rare n-grams first: their first key is the logarithm of a count
in a table of counters over all documents, their second a hash of their own.
Passages that many documents share so stay out of the prefixes of documents that
have more than them.  Counters are as many as keep about ``LOAD`` n-grams in each,
up to ``2 ** MOST_BITS``, and one byte of each is broadcast.

Large groups are not expanded into pairs.  Documents with equal sets are one
node.  In each n-gram's posting list the most central node is the pivot, and only
(pivot, member) pairs are verified first.  What then lies in one component needs
no more; only members outside their pivot's component meet the rest of the list,
as far as the places of the n-gram in both allow a link.

A node is named by the least key (doc_id, or a hash of one that is no integer) of
its documents.  Keys that have several different texts are found first; their
nodes are named by the digests of the sets.

Prefixes move as packed bytes, dealt into as many buckets as their number asks
for, and only n-grams that at least two sets have leave a bucket as rows.  Maps of
bits of bounded size say which documents stand for a node and which texts are
needed; an error there moves a row too many and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandframe.llm import _tokens as W
from strandframe.llm._graph import components
from strandframe.llm._shared import discard, fresh, prepare_python, staged

LEAST_BITS, MOST_BITS = 20, 25  #: counters, as powers of two
LOAD = 32  #: n-grams in a counter that the number of counters aims at
SLICE = 1 << 12  #: counters in a row of the count table's shuffle
BUCKET = 500_000  #: prefix n-grams that meet in one Python group, on average
HELD = 1 << 18  #: prefix n-grams that a task deals out together
HOT_LEAST = 50_000  #: n-grams counted more often than this are dealt apart
MAP_BITS = 23, 27  #: least and most bits of a map of documents, as powers of two
TOGETHER = 256  #: pairs of one node that are verified by one task
ORDERS = (1, 2, 3)


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    for a, b in W.slices(texts):
        data, offsets = W.buffers(texts[a:b])
        words, first = W.word_hashes(data, offsets, fold=True)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield W.shingles(words[i:j], size)


def _digests(found: np.ndarray) -> tuple[int, int]:
    """Two numbers of a set, whatever the order of its members."""
    return int(W.mix(found, 1).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(W.mix(found, 2)).view(np.int64))


def _bits(ranks: np.ndarray) -> int:
    return len(ranks).bit_length() - 1


def _prefix(found: np.ndarray, ranks: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 n-grams under an order."""
    n = len(found)
    k = n - -(-num * n // den) + 1
    cls = ranks[found >> np.uint64(64 - _bits(ranks))]
    key = cls.astype(np.uint64) << np.uint64(58) | W.mix(found, 100 + order) >> np.uint64(6)
    at = np.argpartition(key, k - 1)[:k] if k < n else np.arange(n)
    return found[at[np.argsort(key[at])]]


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _dealt(ids: np.ndarray, counts: np.ndarray, grams: list[np.ndarray], ranks: np.ndarray, hot: int, buckets: int) -> pa.RecordBatch:
    """Rows (bucket, entries): packed prefix n-grams of the nodes ``ids``, dealt by n-gram.

    Frequent n-grams lie in buckets under 0, dealt by document: nothing has to meet
    there, so none of them fills a bucket.
    """
    turn = np.argsort(ids, kind="stable")
    ids, counts, grams = ids[turn], counts[turn], [grams[i] >> np.uint64(8) for i in turn]
    sizes = np.array([len(x) for x in grams])
    gram = np.concatenate(grams)
    doc = np.repeat(ids, sizes)
    n = np.repeat(counts, sizes)
    pos = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bucket = (gram % np.uint64(buckets)).astype(np.int64)
    key = gram // np.uint64(buckets) & np.uint64((1 << 40) - 1)  # collisions cost a candidate, no more
    frequent = ranks[gram >> np.uint64(56 - _bits(ranks))] >= hot
    token = key.astype(np.int64) * buckets + bucket
    bucket[frequent] = -1 - (W.mix(doc[frequent].view(np.uint64), 4) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    keys, rows = [], []
    for at in np.split(order, edges) if len(order) else []:
        step, new = np.diff(doc[at], prepend=0), np.diff(doc[at], prepend=doc[at[0]] - 1) != 0
        small = np.concatenate([step.astype("<i8").view(np.uint8), np.where(new, n[at], 0).astype("<i4").view(np.uint8), pos[at].astype("<i4").view(np.uint8)])
        keys.append(int(bucket[at[0]]))
        width = 8 if keys[-1] < 0 else 5
        value = token[at].view(np.uint64) if width == 8 else key[at]
        rows.append(np.array([len(at), keys[-1], buckets], "<i8").tobytes() + _pack(value, width) + pa.compress(small.tobytes(), "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "entries"])


def _undealt(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, document, set size and position of each entry of a row of ``_dealt``."""
    count, bucket, buckets = np.frombuffer(data[:24], "<i8").tolist()
    width = 8 if bucket < 0 else 5
    token = _unpack(data[24 : 24 + count * width], width).astype(np.int64)
    token = token if bucket < 0 else token * buckets + bucket
    small = pa.decompress(data[24 + count * width :], 16 * count, "zstd", asbytes=True)
    n = np.frombuffer(small, "<i4", count, 8 * count)
    n = n[np.maximum.accumulate(np.where(n > 0, np.arange(count), 0))]
    return token, np.cumsum(np.frombuffer(small, "<i8", count)), n, np.frombuffer(small, "<i4", count, 12 * count)


def _squeezed(texts: pa.Array) -> pa.Array:
    """Compressed texts, each after its length; null is empty."""
    raw = (x.as_buffer() or b"" for x in texts)
    return pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())


def _whole(texts: pa.Array) -> pa.Array:
    return pa.array([pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in texts.to_pylist()], pa.binary())


class _Map:
    """A map of bits over 64-bit keys; it may say yes to a key that was not put in, never no to one that was."""

    def __init__(self, power: int, packed: np.ndarray):
        self.power, self.packed = power, packed

    def __contains__(self, key) -> bool:
        return bool(self.has(np.array([key], np.int64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, self.power)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _slots(keys: np.ndarray, power: int) -> np.ndarray:
    return (W.mix(keys.astype(np.int64).view(np.uint64), 3) >> np.uint64(64 - power)).astype(np.int64)


def _map(keys: DataFrame, rows: int, of: Callable[..., np.ndarray] | None = None) -> _Map:
    """The map of what ``of`` makes of the columns of ``keys``, or of the only one.

    It is put together on the executors, with eight bits for each of ``rows``.  Two
    steps of Python in a row would take two workers a task, which stay when idle.
    """
    power = int(np.clip(int(np.ceil(np.log2(max(rows, 1)))) + 3, *MAP_BITS))
    slices = 256

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << power - 3, np.uint8)
        for batch in batches:
            columns = [np.asarray(c).astype(np.int64) for c in batch.columns]
            at = _slots(of(*columns) if of else columns[0], power)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = [(k, pa.compress(x.tobytes(), "zstd", asbytes=True)) for k, x in enumerate(bits.reshape(slices, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "bits"])

    size = (1 << power - 3) // slices

    def either(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(pa.decompress(x.as_buffer(), size, "zstd"), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "bits"])

    there = np.zeros((slices, size), np.uint8)
    for row in keys.mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInArrow(either, "slice int, bits binary").collect():
        there[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return _Map(power, there.ravel())


def _named(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """The node of a set that no key names alone: a negative number of its digests."""
    mixed = W.mix(d1.view(np.uint64), 5) ^ W.mix(d2.view(np.uint64), 6)
    return (mixed | np.uint64(1 << 63)).view(np.int64)


def _stands_for(key: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """What the map of representatives holds of a document."""
    return (W.mix(key.view(np.uint64), 9) ^ W.mix(d1.view(np.uint64), 10)).view(np.int64)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    A-Z is lower-cased, words are runs of anything but ASCII white space, and the
    set of a document holds its distinct windows of ``size`` words, or all its
    words as one where they are fewer.  Two rows link when their Jaccard
    similarity is at least ``num / den``; component_id is the least doc_id that
    links reach.  Null, empty and blank texts have the empty set and link with
    nothing: component_id is their own doc_id.  A row with a null doc_id takes the
    component of its equals that have one, else null, and links nobody.  Repeated
    rows are repeated in the result; rows of one doc_id with different texts are
    documents of their own.  doc_id may be of any type that has an order.  Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    kind = docs.schema["doc_id"].dataType
    whole = kind.typeName() in ("byte", "short", "integer", "long")
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    texts = docs.select(F.col("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = int(np.clip(int(np.ceil(np.log2(max(n_bytes / 6 / LOAD, 1)))), LEAST_BITS, MOST_BITS))

    # 1. each document's set size and digests, and how often each n-gram hash occurs, in counters
    arrow = to_arrow_type(kind)
    names = ["doc_id", "key", "n", "d1", "d2", "slice", "counts"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)

        def count(held: list[np.ndarray]) -> None:
            at, n = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            total[at] += n.astype(np.int32)

        for batch in batches:
            held, waiting = [], 0
            n, d1, d2 = [], [], []
            for found in _sets(batch.column(2), size):
                n.append(len(found))
                one, two = _digests(found) if len(found) else (None, None)
                d1.append(one)
                d2.append(two)
                held.append(found)
                waiting += len(found)
                if waiting >= 1 << 20:
                    count(held)
                    held, waiting = [], 0
            if held:
                count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        for at in range(0, 1 << bits, 256 * SLICE):
            rows = [(at // SLICE + k, pa.compress(part.tobytes(), "zstd", asbytes=True)) for k, part in enumerate(total[at : at + 256 * SLICE].reshape(-1, SLICE)) if part.any()]
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), arrow), none, none, none, none, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLICE, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(pa.decompress(x.as_buffer(), 4 * SLICE, "zstd"), np.int32)
        cls = np.log2(np.maximum(total, 1)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([cls.tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], names=["slice", "classes", "total"])

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in names[1:5]), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    measured = staged(texts.mapInArrow(measure, schema), "measured")
    made = measured.where("slice is null").select("doc_id", "key", "n", "d1", "d2")
    parts = measured.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, classes binary, total long")
    ranks, seen = np.zeros((1 << bits) // SLICE * SLICE, np.uint8).reshape(-1, SLICE), 0
    for row in parts.toLocalIterator():  # 2 ** bits bytes at most
        ranks[row["slice"]] = np.frombuffer(row["classes"], np.uint8)
        seen += row["total"]
    hot = int(np.ceil(np.log2(HOT_LEAST)))
    held = spark.sparkContext.broadcast(ranks.ravel())
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), seen * (den - num) // den // BUCKET)

    # keys of several texts, and the key that stands for each set
    sets = made.where("d1 is not null and key is not null")
    unclear = sets.groupBy("key").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d")).where("a <> b or c <> d").select("key")
    nodes = staged(sets.groupBy("d1", "d2").agg(F.min("key").alias("key")), "nodes")
    n_nodes, n_unclear = nodes.count(), unclear.count()
    twice = spark.sparkContext.broadcast(_map(unclear, n_unclear) if n_unclear else None)

    def as_arrays(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column(at)).astype(np.int64), np.asarray(batch.column(at + 1)).astype(np.int64)

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = as_arrays(batch, 0)
            key = np.asarray(batch.column(2)).astype(np.int64)
            ids = np.where(twice.value.has(key), _named(d1, d2), key) if twice.value else key
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array(ids)], names=["d1", "d2", "node"])

    named = nodes.mapInArrow(stand, "d1 long, d2 long, node long")
    first_ones = spark.sparkContext.broadcast(_map(nodes.select("key", "d1"), n_nodes, _stands_for))

    # 2. prefixes under the first order, packed, of a document of each set
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, ids, sizes, grams, waiting = held.value, [], [], [], 0
        for batch in batches:
            keys = np.asarray(batch.column(0)).astype(np.int64)
            for k, found in zip(keys, _sets(batch.column(1), size)):
                if not len(found):
                    continue
                one, two = (np.array([x], np.int64) for x in _digests(found))
                k = np.array([k], np.int64)
                if not first_ones.value.has(_stands_for(k, one))[0]:
                    continue
                ids.append(int(_named(one, two)[0]) if twice.value and twice.value.has(k)[0] else int(k[0]))
                sizes.append(len(found))
                grams.append(_prefix(found, ranks, ORDERS[0], num, den))
                waiting += len(grams[-1])
                if waiting >= HELD:
                    yield _dealt(np.array(ids), np.array(sizes), grams, ranks, hot, buckets)
                    ids, sizes, grams, waiting = [], [], [], 0
        if ids:
            yield _dealt(np.array(ids), np.array(sizes), grams, ranks, hot, buckets)

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = key[0].as_py() < 0
        found = (_undealt(x.as_py()) for batch in batches for x in batch.column("entries"))
        for entries in found if frequent else [tuple(map(np.concatenate, zip(*found)))]:
            keep = np.arange(len(entries[0]))
            if not frequent:
                keep = np.lexsort((entries[1], entries[0]))
                new = np.append(True, (np.diff(entries[0][keep]) != 0) | (np.diff(entries[1][keep]) != 0))
                keep = keep[new]  # repeated rows are one
                equal = np.diff(entries[0][keep]) == 0
                keep = keep[np.append(equal, False) | np.append(False, equal)]
            for at in range(0, len(keep), 1 << 16):
                rows = keep[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in entries), pa.array(np.full(len(rows), frequent))], names=["token", "id", "n", "pos", "frequent"])

    known = texts.where("key is not null").select("key", "text")
    posted = staged(known.mapInArrow(deal, "bucket int, entries binary").groupBy("bucket").applyInArrow(meet, "token long, id long, n int, pos int, frequent boolean"), "posted")

    # 3. posting lists of the first order's prefixes, each with its pivot
    me = F.struct("pos", "id", "n")
    run = Window.partitionBy("token").orderBy("pos", "id")
    usual = posted.where("not frequent").select(
        "token", "id", "n", "pos",
        F.first(me).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("pivot"),
        F.lead("id").over(run).alias("after"),
    )
    usual = usual.where("id <> pivot.id or after is not null").select("token", "id", "n", "pos", "pivot")
    frequent = posted.where("frequent").select("token", "id", "n", "pos")
    pivots = frequent.groupBy("token").agg(F.min(me).alias("pivot"), F.count("*").alias("members")).where("members > 1").select("token", "pivot")
    lists = staged(usual.unionByName(frequent.join(pivots, "token")), "postings")
    discard(posted)

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(id, text) of the nodes of some pairs, each once."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        wanted = spark.sparkContext.broadcast(_map(ids, n_nodes))

        def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = np.asarray(batch.column(0)).astype(np.int64)
                if twice.value:
                    for i in np.flatnonzero(twice.value.has(ids)):
                        found = next(_sets(batch.column(1)[i : i + 1], size))
                        one, two = (np.array([x], np.int64) for x in (_digests(found) if len(found) else (0, 0)))
                        ids[i] = _named(one, two)[0]
                use = wanted.value.has(ids)
                batch = batch.filter(pa.array(use))
                yield pa.RecordBatch.from_arrays([pa.array(ids[use]), _squeezed(batch.column(1))], names=["id", "text"])

        return known.mapInArrow(involved, "id long, text binary").dropDuplicates(["id"])

    def may(a: str, b: str) -> str:
        # from a shared n-gram on, sets can share no more than the shorter rest holds
        return f"{num + den} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {num} * ({a}.n + {b}.n)"

    first = lists.alias("m").where("m.id <> m.pivot.id").where(may("m", "m.pivot")).select(F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b")).distinct()
    first = staged(first, "pairs")
    links = _verified(texts_of(first), first, held, size, num, den)
    joined = components(links, "joined")

    # 4. members outside their pivot's component against the rest of the list
    def of(df: DataFrame, key: str, name: str) -> DataFrame:
        parts = joined.select(F.col("id").alias(key), F.col("component").alias(name))
        return df.join(parts, key, "left").withColumn(name, F.coalesce(name, key))

    placed = of(of(lists.withColumn("pivot_id", F.col("pivot.id")).drop("pivot"), "id", "part"), "pivot_id", "main")
    odd = staged(placed.where("part <> main"), "odd")
    if not odd.isEmpty():
        others = placed.join(odd.select("token").distinct(), "token", "left_semi")
        second = (
            odd.alias("x").join(others.alias("y"), F.expr(f"x.token = y.token and x.part <> y.part and x.id <> y.id and {may('x', 'y')}"))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
            .join(first, ["a", "b"], "left_anti")
        )
        second = staged(second, "pairs")
        more = _verified(texts_of(second), second, held, size, num, den)
        if not more.isEmpty():
            joined = components(links.unionByName(more), "joined")
        discard(second, more)
    discard(lists, odd, first, links)

    # the least doc_id of each component, whatever its nodes are called
    own = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    roots = named.select("d1", "d2", "node").join(joined.withColumnRenamed("id", "node"), "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("root"))
    if whole and not n_unclear:  # the least node of a component is its least doc_id
        roots = roots.select("d1", "d2", F.col("root").cast(kind).alias("component_id"))
    else:
        roots = roots.join(own, ["d1", "d2"])
        least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
        roots = roots.select("d1", "d2", "root").join(least, "root").select("d1", "d2", "component_id")
    return made.select("doc_id", "n", "d1", "d2").join(roots, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _verified(needed: DataFrame, pairs: DataFrame, held, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that pass the other orders' filters and then link, as a table; ``needed`` has the texts."""

    def with_text(pairs: DataFrame, key: str) -> DataFrame:
        texts = needed.select(F.col("id").alias(key), F.col("text").alias(f"{key}_text"))
        # pairs of a node that has many, as the pivot of a large group has, are dealt to several tasks
        many = pairs.groupBy(key).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")).where("parts > 1")
        usual = pairs.join(many, key, "left_anti").join(texts, key)
        split = pairs.join(many, key).withColumn("part", F.pmod(F.xxhash64("b" if key == "a" else "a"), "parts").cast("int")).drop("parts")
        shown = texts.join(many, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return usual.unionByName(split.join(shown, [key, "part"]).drop("part"))

    whole = with_text(with_text(pairs, "b"), "a").select("a", "a_text", "b", "b_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, last, left, mine = held.value, None, None, []
        for batch in batches:
            keep = []
            for a, text, right in zip(batch.column(0).to_pylist(), batch.column(1), _sets(_whole(batch.column(3)), size)):
                if a != last:
                    last, left = a, next(_sets(_whole(pa.array([text.as_py()], pa.binary())), size))
                    mine = [_prefix(left, ranks, order, num, den) for order in ORDERS[1:]]
                few, many = sorted((len(left), len(right)))
                links = den * few >= num * many
                for order, prefix in zip(ORDERS[1:], mine):
                    links = links and np.isin(_prefix(right, ranks, order, num, den), prefix).any()
                if links:
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    links = den * both >= num * (len(left) + len(right) - both)
                keep.append(bool(links))
            found = batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=["a", "b"])

    return staged(whole.mapInArrow(verify, "a long, b long"), "links")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without those that link to a smaller doc_id, columns as they are.

    Documents without words stay, as do rows with a null doc_id.  Of repeated rows
    with one doc_id all stay: they are one document.  A doc_id with different texts
    goes as a whole if one of them links to a smaller doc_id.
    """
    gone = near_duplicates(docs, **how).where("doc_id <> component_id").select("doc_id").distinct()
    (name,) = fresh(docs, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", name), docs["doc_id"] == F.col(name), "left_anti")
