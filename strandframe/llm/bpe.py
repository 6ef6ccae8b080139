"""Byte-level BPE encoding and decoding with a given vocabulary file.

Method: a contiguous rank array.  A word's parts are held beside the ranks of
adjacent pairs; the least rank is looked for, the boundary inside that pair
deleted and the two neighbouring ranks refreshed.  Words that are not known yet
take these steps together, each a row of two numpy arrays.  The scan is
quadratic, so it serves words up to ``SHORT`` bytes; longer ones take the same
merges from a heap.  Encoded words are kept in a bounded table.

The driver reads the vocabulary and broadcasts the codec, as arrays.  A Python
worker has it as long as its tasks use that broadcast, and no longer.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandframe.llm._shared import prepare_python
from strandframe.llm._tokens import slices

SHORT = 128  #: bytes of a word that the rank array serves
KEPT, KEPT_CHARS = 200_000, 8 << 20  #: words in the table, and their characters
_ADDED = "\udfff"  #: before an added token; no text holds it
_NONE = 1 << 62
_ID = (1 << 32) - 1


@lru_cache(1)
def _splitter():
    """The byte-level pattern for ``re``, which is faster than ``regex`` but knows
    no properties: their ranges of code points are spelled out."""

    def ranges(prop: str) -> str:
        runs = regex.finditer(rf"\p{{{prop}}}+" if prop != "s" else r"\s+", everything)
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in runs)

    everything = "".join(map(chr, range(sys.maxunicode + 1)))
    pattern = ByteBpe.PATTERN
    letter, number, space = ranges("L"), ranges("N"), ranges("s")
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"), (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern).findall


#: Texts of ASCII alone need no ranges.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+").findall


@lru_cache(1)
def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pairs:
    """Rank and id of adjacent parts, by open addressing."""

    def __init__(self, found: dict[int, int]):
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        for key, value in found.items():
            at = int(self._at(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, value

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges of pairs; ``_NONE`` where there is none or an id is negative."""
        keys = left.astype(np.int64) << 32 | right
        at = self._at(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], _NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class ByteBpe:
    """Encoder and decoder of a ``tokenizers`` JSON file of kind byte-level BPE.

    Text between added tokens is split by the byte-level pattern, each piece
    merged on its own.  Added tokens in a text become their ids.
    """

    #: The byte-level pre-tokenizer's pattern, a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, definition: str):
        spec = json.loads(definition)
        split, model = spec["pre_tokenizer"], spec["model"]
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("a byte-level BPE definition without prefix space and normalizer is needed")
        if not split.get("use_regex", True):
            raise ValueError("a byte-level definition that splits by its pattern is needed")
        vocab = model["vocab"]
        back = {c: b for b, c in _byte_chars().items()}
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        as_bytes = lambda s: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        of_id = {i: as_bytes(s) for s, i in [*vocab.items(), *self._added.items()]}
        size = max(of_id) + 1
        self._length = np.array([len(of_id.get(i, b"")) for i in range(size)])
        self._start = np.cumsum(self._length) - self._length
        self._all = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(size)), np.uint8)
        self._byte_ids = np.array([vocab[_byte_chars()[b]] for b in range(256)])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # left id and right id in one integer -> rank and id of both together in one integer
        self._pair = _Pairs({vocab[a] << 32 | vocab[b]: i << 32 | vocab[a + b] for i, (a, b) in reversed(list(enumerate(pairs)))})
        self._known: dict[str, bytes] = {}
        self._chars = 0

    @cached_property
    def _merges(self) -> dict[int, int]:
        """The merges for words beyond ``SHORT``, which few texts have."""
        there = self._pair.keys >= 0
        return dict(zip(self._pair.keys[there].tolist(), self._pair.values[there].tolist()))

    @cached_property
    def _any(self):
        return _splitter()

    @cached_property
    def _special(self):
        longest = sorted(self._added, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def _split(self, text: str) -> list[str]:
        return (_ASCII if text.isascii() else self._any)(text)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = array("i", self._merge_long([int(self._byte_ids[b]) for b in w])).tobytes()
            else:
                by_width.setdefault(max(8, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            for at in range(0, len(rows), step := max(64, (1 << 19) // width)):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_short([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        length = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self._byte_ids[raw], -1)
        ranks = np.full(ids.shape, _NONE, np.int64)
        ranks[:, :-1] = self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        done, rows = np.full(ids.shape, -1, np.int32), np.arange(len(ids))
        while len(rows):
            i = ranks.argmin(1)
            every = np.arange(len(rows))
            least = ranks[every, i]
            more = least < _NONE
            if not more.all():
                done[rows[~more]] = ids[~more]
                rows, ids, ranks, i, least = rows[more], ids[more], ranks[more], i[more], least[more]
                every = np.arange(len(rows))
            if not len(rows):
                break
            ids[every, i] = least & _ID
            # the boundary between parts i and i + 1 goes, and with it the rank of their pair
            ids[:, :-1] = np.where(column[:-1] > i[:, None], ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(column[:-1] > i[:, None], ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, _NONE
            ranks[every, i] = self._pair(ids[every, i], ids[every, np.minimum(i + 1, width - 1)])
            ranks[i == width - 1, -1] = _NONE
            left = np.flatnonzero(i)
            ranks[left, i[left] - 1] = self._pair(ids[left, i[left] - 1], ids[left, i[left]])
        ends = np.cumsum((done >= 0).sum(1)) * 4
        packed = done[done >= 0].astype(np.int32).tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, n = self._merges.get, len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue  # a merge has changed this pair since
            ids[i], alive[j], after[i] = r & _ID, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := get(ids[left] << 32 | ids[right], _NONE)) < _NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for x, keep in zip(ids, alive) if keep]

    def _pieces(self, text: str) -> list[str]:
        """The words and added tokens of a text."""
        if not self._special or not self._special.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(_ADDED + m[0])
            at = m.end()
        return out + self._split(text[at:])

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """For each text the ids as little-endian 32-bit integers."""
        pieces = [self._pieces(t) for t in texts]
        known, here = self._known, set().union(*pieces)
        new = [w for w in here if w not in known]
        self._chars += sum(map(len, new))
        if len(known) + len(new) > KEPT or self._chars > KEPT_CHARS:  # those of the texts at hand stay
            known = self._known = {w: known[w] for w in here if w in known}
            self._chars = sum(map(len, here))
        plain = [w for w in new if w[:1] != _ADDED]
        known.update(zip(plain, self.merge([w.encode("utf-8", "surrogatepass") for w in plain])))
        known.update((w, array("i", [self._added[w[1:]]]).tobytes()) for w in new if w[:1] == _ADDED)
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ``ids``; unknown ids are left out, broken UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        return self._joined(ids[(ids >= 0) & (ids < len(self._length))])[0].tobytes().decode("utf-8", "replace")

    def _joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of known ids one after another, and where each id's end."""
        length = self._length[ids]
        after = np.cumsum(length)
        return self._all[np.repeat(self._start[ids] - after + length, length) + np.arange(after[-1] if len(after) else 0)], after

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of rows of ids; row i ends before ``ends[i + 1]``."""
        out, row = [], 0
        while row < len(ends) - 1:  # some rows at a time, to bound the index arrays
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + (1 << 19), "right")) - 1)
            part = ids[ends[row] : ends[to]]
            part = part[(part >= 0) & (part < len(self._length))] if len(part) and (part.min() < 0 or part.max() >= len(self._length)) else part
            data, after = self._joined(part)
            cut = np.concatenate([[0], after])[ends[row : to + 1] - ends[row]] if len(part) == ends[to] - ends[row] else None
            if cut is not None and self._whole(data, cut):
                out.append(pa.StringArray.from_buffers(to - row, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)))
            else:
                out.append(pa.array([self.decode(ids[ends[i] : ends[i + 1]].tolist()) for i in range(row, to)], pa.string()))
            row = to
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    @staticmethod
    def _whole(data: np.ndarray, cut: np.ndarray) -> bool:
        """Whether every row is UTF-8 by itself."""
        inner = cut[cut < len(data)]
        if ((data[inner] & 0xC0) == 0x80).any():
            return False
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            return False
        return True


def _shared(spark: SparkSession, path: str) -> Broadcast[ByteBpe]:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(ByteBpe(f.read()))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Add ``to``, the token ids of column ``text``.

    A null text has the ids of the empty text, none.  Rows are independent, so
    repeated rows give repeated results; other columns pass through, but one
    that is called ``to`` already is replaced.  The vocabulary file is read by
    the driver and broadcast: its size does not depend on the data.
    """
    prepare_python(df.sparkSession)
    held = _shared(df.sparkSession, vocabulary)
    schema = _with(df, to, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            ids, ends = _ids(codec, batch.column(text).cast(pa.string()))
            yield _put(batch, to, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add ``to``, the text of the token ids; null ids decode to the empty text."""
    prepare_python(df.sparkSession)
    held = _shared(df.sparkSession, vocabulary)
    schema = _with(df, to, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            lists = batch.column(ids)
            lists = lists if not lists.null_count else pa.array([x or [] for x in lists.to_pylist()], pa.list_(pa.int32()))
            ends = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values.fill_null(-1))
            yield _put(batch, to, codec.decode_rows(flat[ends[0] : ends[-1]], ends - ends[0]))

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the token ids of ``text`` and their text again, in place of ``text``.

    The same as ``encode`` and then ``decode``, but with one codec in one Python
    worker of a task where the two in a row take two of each.
    """
    prepare_python(df.sparkSession)
    held = _shared(df.sparkSession, vocabulary)
    rest = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        for batch in batches:
            column = batch.column(text).cast(pa.string())
            for a, b in slices(column, 1 << 21):
                flat, ends = _ids(codec, column[a:b])
                own = batch.slice(a, b - a).select([f.name for f in rest]).columns
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*own, lists, codec.decode_rows(np.asarray(flat), ends)], names=schema.names)

    return df.mapInArrow(run, schema)


def _ids(codec: ByteBpe, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The ids of all texts, and where each text's ids end, from 0 on."""
    packed = [x for a, b in slices(texts, 1 << 21) for x in codec.encode_packed([t or "" for t in texts[a:b].to_pylist()])]
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))]), ends


def _put(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])
