"""Language identification.

Method: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy.  Subwords are the byte n-grams of a text,
A-Z lower-cased, hashed into ``2 ** BITS`` embeddings.  A text's vector is their
average.  Probabilities are calibrated by a temperature, and the level under
which a prediction counts as rejected is fitted, both on rows that training
leaves out.

Embeddings and softmax are linear, so for prediction they are multiplied once
into a table of a few weights for each subword; every whole text goes through it.
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
from strandframe.llm._shared import fresh, prepare_python
from strandframe.llm.toxicity import fold

TRAIN_ROWS = 2000  #: labelled rows of the fit: those with the least hash of doc_id
FOLDS, HELD_OUT = 4, 2
BITS, SIZE = 14, 16
GRAMS = (2, 3, 4)
UNKNOWN = "und"
_STEPS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def _subwords(data: np.ndarray, n: int) -> np.ndarray:
    """The embedding of the n-gram at each byte."""
    folded = W.LOWER[data].astype(np.uint32)
    size = len(data) - n + 1
    h = np.full(size, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h += (folded[j : j + size] + np.uint32(1)) * np.uint32(_STEPS[j])
        h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (2 ** BITS, languages): embeddings times softmax weights, over the temperature
    bias: np.ndarray
    reject_below: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a, b in W.slices(texts, max(1 << 16, (1 << 22) // len(self.languages))):
            data, offsets = W.buffers(texts[a:b])
            total, count = np.zeros((b - a, len(self.languages))), np.zeros(b - a)
            step = max(1 << 12, (1 << 20) // len(self.languages))  # a single long row comes in parts
            for n in GRAMS:
                for at in range(0, max(0, len(data) - n + 1), step):
                    to = min(len(data) - n + 1, at + step)
                    rows = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.table[_subwords(data[at : to + n - 1], n)], axis=0, dtype=np.float64)])
                    first, last = np.clip(offsets[:-1], at, to) - at, np.clip(np.maximum(offsets[1:] - n + 1, offsets[:-1]), at, to) - at
                    total += rows[last] - rows[first]
                    count += last - first
            logit = total / np.maximum(count, 1)[:, None] + self.bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, text: str = "text", lang: str = "lang") -> Model | None:
    """A model of the documents with a language, without the held-out fold; None if there is none.

    A doc_id with several rows is taken once.  What comes to the driver of a document
    is at most a share for each of the ``2 ** BITS`` subwords, however long its text is.
    """
    prepare_python(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = known.select(F.col("doc_id").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it is broadcast
    found = known.select(F.col("doc_id").alias("id"), F.col(lang).cast("string").alias("y"), F.col(text).cast("string").alias("x")).join(F.broadcast(chosen), "id")
    # one row for each document, whatever it is repeated: the one of the least hash
    picked = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("x", "y").alias("h"), "y", "x")).alias("t")).select("t.y", "t.x")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for k in range(len(batch)):
                data, _ = W.buffers(batch.column(1)[k : k + 1])
                total = np.zeros(1 << BITS, np.float32)
                for n in GRAMS:
                    if len(data) >= n:
                        total += np.bincount(_subwords(data, n), minlength=len(total))
                held.append((total / max(total.sum(), 1)).astype(np.float32))
            sparse = [(np.flatnonzero(h).astype(np.int32), h[h > 0]) for h in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i, _ in sparse], pa.binary()), pa.array([v.tobytes() for _, v in sparse], pa.binary())], names=["y", "at", "share"])

    got = picked.mapInArrow(features, "y string, at binary, share binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["share"], r["y"]))  # whatever order the tasks came in
    if not got:
        return None
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32)) for r in got], [r["y"] for r in got])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, batch: int = 32, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    made = np.random.RandomState(seed)
    order = made.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    used = order[len(y) // 5 :] if len(y) >= 50 else order
    e = made.normal(0, 0.3, (1 << BITS, SIZE)).astype(np.float32)
    w = np.zeros((SIZE, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), 1 << BITS), np.float32)
        for k, i in enumerate(which):
            x[k, rows[i][0]] = rows[i][1]
        return x

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for epoch in range(epochs):
        rate = 20.0 * (1 - epoch / epochs)
        made.shuffle(used)
        for at in range(0, len(used), batch):
            part = used[at : at + batch]
            x = dense(part)
            h = x @ e
            g = softmax(h @ w + bias)
            g[np.arange(len(part)), y[part]] -= 1
            g /= len(part)
            back = g @ w.T
            w -= rate * 0.5 * (h.T @ g)
            bias -= rate * 0.005 * g.sum(0)
            touched = np.unique(np.concatenate([rows[i][0] for i in part]))
            e[touched] -= rate * 10 * (x[:, touched].T @ back)
    z = np.concatenate([dense(held[a : a + 256]) @ e @ w + bias for a in range(0, len(held), 256)])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min((2.0**k for k in np.arange(-4, 4.01, 0.25)), key=loss)
    p = softmax(z / temperature)
    right, best = p.argmax(1) == y[held], p.max(1)
    # the least level above which at least 99 of 100 held rows are right
    levels = [t for t in np.linspace(0, 0.99, 100) if (best >= t).any() and right[best >= t].mean() >= 0.99]
    return Model(languages, e @ w / np.float32(temperature), bias / np.float32(temperature), float(levels[0]) if levels else 1.0)


def identified(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred, score (its calibrated probability) and rejected (too unsure) to each row.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as
    is everything without a model.  Columns of these names are replaced.
    """
    prepare_python(df.sparkSession)
    names = ("lang_pred", "score", "rejected")
    kept = [f for f in df.schema.fields if f.name not in names]
    (letter,) = fresh(df, "letters")
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            letters = np.asarray(batch.column(letter))
            if model:
                p = model.probabilities(batch.column(text).cast(pa.string()))
                best, score = p.argmax(1), p.max(1) if len(p) else np.zeros(0)
                lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters)]
                score = np.where(letters, score, 0.0)
                rejected = ~letters | (score < model.reject_below)
            else:
                lang, score, rejected = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return df.withColumn(letter, has_letter(F.col(text))).mapInArrow(run, schema)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))
