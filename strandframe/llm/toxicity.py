"""Toxicity scores by weak supervision.

Method: marks, which are words and word beginnings, are mined from labelled rows
and dealt into lexicon voters; pattern voters look at the shape of a text.  A
generative label model (two latent classes, fitted by expectation maximisation)
estimates how often each voter fires in either class, and how voters are
correlated within a class, so that voters which repeat each other count less.
Its posterior labels train a linear classifier on the marks and patterns.

The fit uses at most ``TRAIN_ROWS`` labelled documents, those with the least hash of
doc_id.  Their marks are counted by Spark; the driver gets the ``MOST_MARKS`` that
tell most, and which of them each document has.  Scoring goes through every whole
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm import _tokens as W
from strandframe.llm._shared import prepare_python, staged

TRAIN_ROWS = 5000
FOLDS, HELD_OUT = 5, 0
VOTERS = 16  #: lexicon voters
MOST_MARKS = 640
STARTS = (4, 5, 6)  #: bytes of the word beginnings beside whole words
_BITS = 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has none."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def _marks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words and word beginnings, a block of text at a time."""
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]  # no word crosses a row
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + W.BLOCK, "right")))
        size = int(ends[to - 1]) - base
        power, inverse = W._powers(max(W.BLOCK, 1 << (size - 1).bit_length()))
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(W._FOLDED[data[base : base + size]] * power[:size], out=total[1:])
        s, e, r = starts[at:to] - base, ends[at:to] - base, rows[at:to]
        yield r, W.mix((total[e] - total[s]) * inverse[s], 0)
        for k in STARTS:
            has = e - s >= k
            yield r[has], W.mix((total[s[has] + k] - total[s[has]]) * inverse[s[has]], k)
        at = to


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of exclamation marks, capitals and digits of each row's bytes."""
    n = np.maximum(np.diff(offsets), 1)
    out = []
    for which in (data == 0x21, (data >= 0x41) & (data <= 0x5A), (data >= 0x30) & (data <= 0x39)):
        total = np.concatenate([[0], np.cumsum(which)])
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / n)
    return np.stack(out, 1)


@dataclass
class Model:
    """A fitted classifier; ``voters`` holds what the label model estimated."""

    marks: np.ndarray  # sorted hashes
    weights: np.ndarray
    pattern_weights: np.ndarray
    bias: float
    voters: dict

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        near = np.zeros(1 << _BITS, bool)
        near[(self.marks >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        for a, b in W.slices(texts):
            data, offsets = W.buffers(texts[a:b])
            logit = np.full(b - a, self.bias)
            hit: list[np.ndarray] = []
            if len(data) and len(self.marks):
                for rows, hashes in _marks(data, offsets):
                    may = near[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
                    rows, hashes = rows[may], hashes[may]
                    at = np.minimum(np.searchsorted(self.marks, hashes), len(self.marks) - 1)
                    true = self.marks[at] == hashes
                    hit.append(rows[true] * len(self.marks) + at[true])
                pairs = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
                np.add.at(logit, pairs // len(self.marks), self.weights[pairs % len(self.marks)])
            logit += _patterns(data, offsets) @ self.pattern_weights
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior of class 1 for each row of 0/1 votes, and the estimates."""
    votes = votes.astype(float)
    post = np.clip(votes.mean(1) / max(votes.mean(1).max(), 1e-9), 0.02, 0.98)
    estimates: dict = {}
    for _ in range(rounds):
        on = (post[:, None] * votes).sum(0), ((1 - post)[:, None] * votes).sum(0)
        fires = np.stack([(on[0] + 1) / (post.sum() + 2), (on[1] + 0.1) / ((1 - post).sum() + 2)])
        if (wrong := fires[0].mean() < fires[1].mean()):
            fires = fires[::-1]
        # correlation of voters within the classes
        rest = votes - (post[:, None] * fires[0] + (1 - post)[:, None] * fires[1]) if not wrong else votes - votes.mean(0)
        cov = rest.T @ rest / len(votes)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        share = 1 / np.maximum(1, np.clip(corr, 0, 1).sum(1))
        gain = (np.log(fires[0]) - np.log(fires[1])), (np.log1p(-fires[0]) - np.log1p(-fires[1]))
        logit = np.log(prior / (1 - prior)) + votes @ (share * gain[0]) + (1 - votes) @ (share * gain[1])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        estimates = {"fires_if_toxic": fires[0], "fires_if_clean": fires[1], "correlation": corr, "share": share}
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, estimates


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "toxic", most_marks: int = MOST_MARKS) -> Model | None:
    """A model of ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, without the held-out fold.

    Null labels are left out; a doc_id with several labels is toxic if one says so,
    and one with several rows is taken once, with the text of the least hash.
    Without documents of both classes there is no model.
    """
    prepare_python(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it is broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    # one text for each document, whatever it is repeated
    one = found.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    picked = staged(one.select(F.xxhash64("id").alias("turn"), F.col("id").cast("string").alias("id"), "y", F.col("t.text").alias("text")), "toxicity")
    of = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return None
    n1 = sum(n for y, n in of.items() if y)
    n0 = sum(of.values()) - n1

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, y in enumerate(batch.column(0).to_pylist()):
                data, offsets = W.buffers(batch.column(1)[k : k + 1])
                own = [np.unique(h) for _, h in _marks(data, offsets)] if len(data) else []
                own = np.unique(np.concatenate(own)).view(np.int64) if own else np.zeros(0, np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), y, np.int32))], names=["mark", "y"])

    counted = picked.select("y", "text").mapInArrow(marks, "mark long, y int").groupBy("mark").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (n0 + 1))
    least = max(3, round(0.01 * n1))
    gains = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 2").select("mark", (F.col("toxic") * F.col("odds")).alias("gain"))
    best = np.array([r["mark"] for r in gains.orderBy(F.desc("gain"), "mark").limit(most_marks).collect()], np.int64).view(np.uint64)
    vocabulary = np.sort(best)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has, shapes = [], []
            for k in range(len(batch)):
                data, offsets = W.buffers(batch.column(3)[k : k + 1])
                bits = np.zeros(len(vocabulary), bool)
                for _, hashes in _marks(data, offsets) if len(data) and len(vocabulary) else ():
                    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                    bits[at[vocabulary[at] == hashes]] = True
                has.append(np.packbits(bits).tobytes())
                shapes.append(_patterns(data, offsets)[0].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(has, pa.binary()), pa.array(shapes, pa.list_(pa.float64()))], names=["turn", "id", "y", "has", "shape"])

    got = picked.select("turn", "id", "y", "text").mapInArrow(features, "turn long, id string, y int, has binary, shape array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["turn"], r["id"] or ""))  # whatever order the tasks came in
    x = np.array([np.unpackbits(np.frombuffer(r["has"], np.uint8), count=len(vocabulary)) for r in got], np.float32).reshape(len(got), len(vocabulary))
    return fit(x, np.array([r["shape"] for r in got]), np.array([r["y"] for r in got]), vocabulary, np.searchsorted(vocabulary, best))


def fit(x: np.ndarray, shape: np.ndarray, y: np.ndarray, marks: np.ndarray, best: np.ndarray) -> Model:
    """x: which marks each row has; shape: its patterns; y: its label; best: the places of the marks, those that tell most first."""
    n, prior = len(y), float(np.clip(y.mean(), 0.01, 0.99))
    # voters: marks dealt out from the strongest on, so that each has some of every language
    turn = np.empty(len(marks), int)
    turn[best] = np.arange(len(best)) % VOTERS
    lexicon = np.stack([x[:, turn == v].any(1) for v in range(VOTERS)], 1) if len(marks) else np.zeros((n, 1), bool)
    pattern = shape > np.maximum(np.quantile(shape, 0.9, axis=0), 1e-9)
    post, estimates = label_model(np.concatenate([lexicon, pattern], 1), prior)

    # a linear classifier on the posterior labels
    z = np.concatenate([x, shape.astype(np.float32)], 1)
    w, b = np.zeros(z.shape[1]), float(np.log(prior / (1 - prior)))
    step, m, v, mb, vb = 0.05, np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0
    for k in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        g, gb = z.T @ (p - post) / n + 1e-4 * w, float((p - post).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w -= step * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= step * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(marks, w[: len(marks)], w[len(marks) :], b, estimates)


def scored(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (score >= 0.5) to each row.

    Null texts score as empty ones do.  Without a model every score is 0.  Columns
    called score or predicted are replaced, others pass through.
    """
    prepare_python(df.sparkSession)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    held = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_MARKS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.scores(batch.column(text).cast(pa.string())) if held.value else np.zeros(len(batch))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*(f.name for f in kept), "score", "predicted"])

    return df.mapInArrow(run, T.StructType([*kept, *new]))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, columns as they are."""
    inner = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))  # whatever the columns are called
    found = scored(inner, train(docs, labels), f"__c{docs.columns.index('text')}").where("predicted = 0")
    return found.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
