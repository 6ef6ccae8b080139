"""What a task does with a file: looks at it, unpacks it and cuts it into parts.

A part holds the bytes of one record, or why a file ends where it does.  Text is
read in blocks and cut by the places of its line ends, so no line is touched on its
own; a block grows only while one record is longer than it.

A split of a plain file owns the records whose first byte lies in it, and reads on
behind its end to finish the last one.  A FASTA record begins at any line that
starts with ``>``.  A FASTQ record begins at every fourth line, which takes the
number of lines before the split: ``survey`` counts them, and finds for each
of the four places at which the split's first record may begin the first record
that is wrong.
"""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import quote

import numpy as np
import pyarrow as pa

#: First two bytes of compressed files.  Fixed values.
MAGIC = {b"\x1f\x8b": "gzip", b"BZ": "bzip2", b"\xfd7": "xz", b"\x28\xb5": "zstd"}
#: Error texts.  Fixed values.
EMPTY = "Failed to read the first two bytes. Is the file empty?"
UNKNOWN = "Expected '@' or '>' at the start of the file but found '{}'."
PREFIX = 1 << 16  #: packed bytes unpacked at a time
BLOCK = 1 << 22  #: bytes of text cut at a time
NL, CR, AT, PLUS, GT = 10, 13, 64, 43, 62

PARTS = "path string, fmt string, windows boolean, record_idx long, l0 binary, l1 binary, l2 binary, l3 binary, n_lines int, nl boolean, last boolean, start_line long, start_byte long, fault string, message string"
EXTENT = "path string, n_bytes long, n_lines long, n_records long, fasta boolean"
SURVEY = "path string, start long, stop long, whole boolean, fmt string, windows boolean, n_lines long, n_records long, b0 long, b1 long, b2 long, b3 long"
_NAMES = [f.split()[0] for f in PARTS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]


class Damaged(Exception):
    """A compressed stream that is broken or ends early."""


def uri(path: str) -> str:
    scheme, _, rest = path.partition(":")
    return f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{quote(rest)}"


def opened(path: str):
    """A file by the path that Spark lists it under."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(uri(path))
    return system.open_input_file(inner)


def escaped(byte: int) -> str:
    c = chr(byte)
    if c in "\t\r\n":
        return {"\t": "\\t", "\r": "\\r", "\n": "\\n"}[c]
    return "\\" + c if c in "'\"\\" else c if " " <= c <= "~" else f"\\u{{{byte:x}}}"


# -- bytes of a file -----------------------------------------------------------


def _decoder(codec: str):
    if codec == "gzip":
        return zlib.decompressobj(31)
    if codec == "bzip2":
        return bz2.BZ2Decompressor()
    if codec == "xz":
        return lzma.LZMADecompressor()
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


class Unpacked:
    """Reads the text of a compressed file, of all its streams one after another.

    What can be unpacked comes first; then ``Damaged`` is raised if a stream is
    broken or the file ends within one.
    """

    def __init__(self, file, codec: str):
        self.file, self.codec, self.one, self.within, self.fed, self.failed, self.done = file, codec, _decoder(codec), False, b"", None, False

    def _some(self) -> bytes:
        """The next piece of text; empty only at the end."""
        while True:
            more = self.codec in ("bzip2", "xz") and self.within and not self.one.needs_input
            if not self.fed and not more:
                self.fed = self.file.read(PREFIX)
                if not self.fed:
                    if self.within:
                        raise Damaged("unexpected end of file")
                    return b""
            if not self.within and self.codec == "xz":
                self.fed = self.fed.lstrip(b"\0") or b""  # padding between streams
                if not self.fed:
                    continue
            try:
                if self.codec == "zstd":
                    text, self.fed = self.one.decompress(self.fed), b""
                elif self.codec == "gzip":
                    text = self.one.decompress(self.fed, BLOCK)
                    self.fed = self.one.unconsumed_tail
                else:
                    text, self.fed = self.one.decompress(self.fed, BLOCK), b""
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError) as e:
                raise Damaged(str(e)) from None
            except Exception as e:
                if type(e).__name__ != "ZstdError":
                    raise
                raise Damaged(str(e)) from None
            self.within = True
            if self.one.eof:
                self.fed, self.one, self.within = self.one.unused_data, _decoder(self.codec), False
            if text:
                return text

    def read(self, n: int) -> bytes:
        out, size = [], 0
        while size < n and not self.done:
            try:
                text = b"" if self.failed else self._some()
            except Damaged as e:
                self.failed, text = e, b""
            if not text:
                if self.failed and not size:
                    raise self.failed
                self.done = not self.failed
                break
            out.append(text)
            size += len(text)
        return b"".join(out)


class Range:
    """Reads a file from a place on."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at

    def read(self, n: int) -> bytes:
        data = self.file.read_at(n, self.at)
        self.at += len(data)
        return data


class Piped:
    """Pieces of bytes, one after another, as a file that goes forward only."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.base, self.at = pieces, b"", 0, 0

    def read_at(self, n: int, at: int) -> bytes:
        parts, size, self.base = [self.held[at - self.base :]], len(self.held) - (at - self.base), at
        while size < n and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            size += len(piece)
        self.held = b"".join(parts)
        return self.held[:n]

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        data = self.read_at(n, self.at)
        self.at += len(data)
        return data


class Held:
    """Bytes that were read before, then the rest of a reader."""

    def __init__(self, data: bytes, rest=None):
        self.data, self.rest = data, rest

    def read(self, n: int) -> bytes:
        if self.data:
            out, self.data = self.data, b""
            return out
        return self.rest.read(n) if self.rest else b""


def looked_at(file, compression: str):
    """(codec, format, fault, message, reader of the text) of a file from its first bytes."""
    first = file.read_at(2, 0)
    if len(first) < 2:
        return None, None, "EmptyFile", EMPTY, None
    codec = MAGIC.get(first) if compression == "auto" else None
    reader = Range(file, 0)
    if codec:
        file.seek(0)
        reader = Unpacked(file, codec)
        try:
            first = reader.read(1)
        except Damaged as e:
            # a stream that ends before its first byte of text is empty
            return (codec, None, "EmptyFile", EMPTY, None) if "unexpected end" in str(e) else (codec, None, "Io", str(e), None)
        if not first:
            return codec, None, "EmptyFile", EMPTY, None
        reader = Held(first, reader)
    fmt = {b">": "fasta", b"@": "fastq"}.get(first[:1])
    if fmt is None:
        return codec, "fastq", "UnknownFormat", UNKNOWN.format(escaped(first[0])), None
    return codec, fmt, None, None, reader


# -- cutting -------------------------------------------------------------------


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    whole = lambda v, t: v if isinstance(v, pa.Array) else pa.nulls(n, t) if v is None else pa.array(v, t) if isinstance(v, np.ndarray) else pa.repeat(pa.scalar(v, t), n)
    return pa.RecordBatch.from_arrays([whole(columns.get(c), t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def fault(path: str, kind: str, message: str | None, fmt: str | None, idx: int = 0, windows: bool = False) -> pa.RecordBatch:
    return _batch(1, {"path": path, "fmt": fmt, "windows": windows, "record_idx": idx, "n_lines": 0, "nl": True, "last": False, "fault": kind, "message": message})


def _ranges(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between each start and end, as rows; starts and ends rise in turn."""
    edges = np.empty(2 * len(starts) + 1, np.int32)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    every = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf)])
    return every.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def _windows(raw: np.ndarray, end: int) -> bool:
    """Whether the line that ends at a place ends in CR LF."""
    return bool(end > 0 and raw[end - 1] == CR)


def _lines(raw: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line; one without a line end counts only if nothing follows."""
    ends = np.flatnonzero(raw == NL)
    if final and len(raw) and raw[-1] != NL:
        ends = np.append(ends, len(raw))
    starts = np.empty_like(ends)
    starts[:1], starts[1:] = 0, ends[:-1] + 1
    return starts, ends


def _shape(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line whether it begins with @, with +, and its length without CR."""
    n = ends - starts
    first = np.where(n > 0, raw[np.minimum(starts, len(raw) - 1)], 0) if len(raw) else np.zeros(0, np.uint8)
    return first == AT, first == PLUS, n - ((n > 0) & (raw[ends - 1] == CR))


def cut_fastq(path: str, reader, windows: bool | None, at: int = 0, line: int = 0, stop: int | None = None, limit: int | None = None, check: bool = False) -> Iterator[pa.RecordBatch]:
    """Parts of the text of ``reader``, which begins at byte ``at`` with line number ``line`` of the file.

    Records from ``stop`` on, or above number ``limit``, are another's; with
    ``check`` the first wrong one is the last.
    """
    skip, held = -line % 4, b""
    while True:
        try:
            data = reader.read(max(BLOCK, len(held)))
        except Damaged as e:
            yield fault(path, "Io", str(e), "fastq", (line + 3) // 4, bool(windows))
            return
        buf = held + data if held else data
        raw = np.frombuffer(buf, np.uint8)
        starts, ends = _lines(raw, not data)
        if windows is None and (len(ends) and ends[0] < len(raw)):
            windows = _windows(raw, ends[0])
        if skip and len(starts):
            gone = min(skip, len(starts))
            used = int(starts[gone]) if gone < len(starts) else min(int(ends[-1]) + 1, len(buf))
            skip, line, at, buf, raw = skip - gone, line + gone, at + used, buf[used:], raw[used:]
            starts, ends = starts[gone:] - used, ends[gone:] - used
        k, over = len(starts) // 4, False
        first = starts[: 4 * k : 4]
        if stop is not None and k and at + first[-1] >= stop:
            k, over = int(np.searchsorted(at + first, stop)), True
        if limit is not None and line // 4 + k > limit:
            k, over = max(0, limit + 1 - line // 4), True
        if check and k:
            a, p, n = _shape(raw, starts[: 4 * k], ends[: 4 * k])
            wrong = np.flatnonzero(~(a[0::4] & p[2::4] & (n[1::4] == n[3::4])))
            if len(wrong):
                k, over = int(wrong[0]) + 1, True
        if k:
            every = _ranges(buf, starts[: 4 * k], ends[: 4 * k])
            texts = {f"l{j}": every.take(pa.array(np.arange(j, 4 * k, 4))) for j in range(4)}
            place = np.arange(k) + line // 4
            yield _batch(k, {"path": path, "fmt": "fastq", "windows": bool(windows), "record_idx": place, **texts, "n_lines": 4, "nl": True, "last": False, "start_line": 4 * place + 1, "start_byte": at + starts[: 4 * k : 4]})
        if over:
            return
        line += 4 * k
        if not data:
            rest = len(starts) - 4 * k
            if rest and (stop is None or at + starts[4 * k] < stop):
                texts = [bytes(buf[s:e]) for s, e in zip(starts[4 * k :], ends[4 * k :])]
                yield _batch(1, {"path": path, "fmt": "fastq", "windows": bool(windows), "record_idx": line // 4, **{f"l{j}": pa.array([t], pa.binary()) for j, t in enumerate(texts)}, "n_lines": rest, "nl": buf[-1:] == b"\n", "last": True, "start_line": line + 1, "start_byte": at + int(starts[4 * k])})
            return
        used = int(starts[4 * k]) if 4 * k < len(starts) else int(ends[-1]) + 1 if len(ends) else 0
        if stop is not None and at + used >= stop:
            return
        held, at = bytes(buf[used:]), at + used


def cut_fasta(path: str, reader, windows: bool | None, at: int = 0, line: int = 0, idx: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts (l0: header and sequence, without the first ``>``) of the text of ``reader``, which begins a line."""
    held, begun, fresh = b"", False, True
    while True:
        try:
            data = reader.read(max(BLOCK, len(held)))
        except Damaged as e:
            yield fault(path, "Io", str(e), "fasta", idx, bool(windows))
            return
        buf = held + data if held else data
        raw = np.frombuffer(buf, np.uint8)
        nls = np.flatnonzero(raw == NL)
        if windows is None and len(nls):
            windows = _windows(raw, nls[0])
        inner = nls[nls < len(raw) - 1]
        starts = inner[raw[inner + 1] == GT] + 1
        if begun or fresh and len(raw) and raw[0] == GT:
            starts, begun = np.concatenate([[0], starts]), True
        if not begun:
            begun = len(starts) > 0
        n = len(starts) if not data else len(starts) - 1
        if begun and n > 0:
            s = starts[:n] + 1
            e = np.append(starts[1 : n + 1] - 1, len(raw))[:n]
            over = False
            if stop is not None and at + starts[n - 1] >= stop:
                n, over = int(np.searchsorted(at + starts[:n], stop)), True
            if n:
                last = np.zeros(n, bool)
                last[-1] = not data and n == len(starts)
                yield _batch(n, {"path": path, "fmt": "fasta", "windows": bool(windows), "record_idx": np.arange(n) + idx, "l0": _ranges(buf, s[:n], e[:n]), "n_lines": 1, "nl": True, "last": pa.array(last), "start_line": line + np.searchsorted(nls, starts[:n]) + 1, "start_byte": at + starts[:n]})
            if over:
                return
            idx += n
        if not data:
            return
        used = int(starts[-1]) if begun else len(raw)
        line += int(np.searchsorted(nls, used))
        if stop is not None and at + used >= stop:
            return
        held, at, fresh = bytes(buf[used:]), at + used, len(raw) > 0 and raw[-1] == NL


def _to_line(reader: Range, at: int, stop: int) -> tuple[int, bytes]:
    """The first place from ``at`` on that begins a line, and what was read from there on; ``stop`` if none is before it."""
    if at == 0:
        return 0, b""
    reader.at = at - 1
    while reader.at < stop:
        data = reader.read(PREFIX)
        if not data:
            break
        cut = data.find(b"\n")
        if cut >= 0:
            return reader.at - len(data) + cut + 1, data[cut + 1 :]
    return stop, b""


def survey(path: str, start: int, stop: int, length: int, compression: str) -> dict:
    """What a split of a file must know of the splits before it; ``whole`` files are read by one task in order."""
    out = {"path": path, "start": start, "stop": stop, "whole": True, "fmt": None, "windows": False, "n_lines": 0, "n_records": 0, "b0": None, "b1": None, "b2": None, "b3": None}
    if start == 0 and stop == length:
        return out
    with opened(path) as file:
        codec, fmt, wrong, _, _ = looked_at(file, compression)
        if codec or wrong:
            return out
        out |= {"whole": False, "fmt": fmt}
        if start == 0:
            out["windows"] = _first_windows(Range(file, 0))
        if fmt == "fasta":
            n, records = _count_lines(file, start, stop)
            return out | {"n_lines": n, "n_records": records}
        n, bad = _wrong_lines(Range(file, 0), start, stop)
        return out | {"n_lines": n, **{f"b{k}": b for k, b in enumerate(bad)}}


def _first_windows(reader) -> bool:
    last = b""
    while data := reader.read(PREFIX):
        cut = data.find(b"\n")
        if cut >= 0:
            return (last + data[:cut])[-1:] == b"\r"
        last = data[-1:]
    return False


def _count_lines(file, start: int, stop: int) -> tuple[int, int]:
    """How many lines begin in a range, and how many of them with ``>``."""
    at, last = max(start - 1, 0), b"\n" if start == 0 else b""
    n = records = 0
    while at < stop:
        data = file.read_at(min(BLOCK, stop - at), at)
        if not data:
            break
        raw = np.frombuffer(last + data, np.uint8)
        before = np.flatnonzero(raw[:-1] == NL)
        n, records = n + len(before), records + int((raw[before + 1] == GT).sum())
        at, last = at + len(data), data[-1:]
    return n, records


def _wrong_lines(reader: Range, start: int, stop: int) -> tuple[int, list[int | None]]:
    """How many lines begin in a range, and, by its number modulo 4, the first that begins no right FASTQ record."""
    at, held = _to_line(reader, start, stop)
    n, bad = 0, [None] * 4
    while at < stop:
        data = reader.read(max(BLOCK, len(held)))
        buf = held + data if held else data
        raw = np.frombuffer(buf, np.uint8)
        starts, ends = _lines(raw, not data)
        full = max(0, len(starts) - 3)  # three more lines tell about a line
        own = int(np.searchsorted(at + starts, stop))
        a, p, size = _shape(raw, starts, ends)
        wrong = np.flatnonzero(~(a[:full] & p[2 : full + 2] & (size[1 : full + 1] == size[3 : full + 3])))
        wrong = wrong[wrong < own] + n
        for phase in range(4):
            if bad[phase] is None and len(hit := wrong[wrong % 4 == phase]):
                bad[phase] = int(hit[0])
        if not data or own < full:
            return n + own, bad
        n += full
        used = int(starts[full]) if full else 0
        held, at = bytes(buf[used:]), at + used
    return n, bad


def cut_whole(path: str, file, compression: str) -> Iterator[pa.RecordBatch]:
    """Parts of a file from its first byte to its end or its first error."""
    _, fmt, wrong, message, reader = looked_at(file, compression)
    if wrong:
        yield fault(path, wrong, message, None if wrong == "Io" else fmt)
    elif fmt == "fasta":
        yield from cut_fasta(path, reader, None)
    else:
        yield from cut_fastq(path, reader, None, check=True)


def cut_split(path: str, fmt: str, start: int, stop: int, windows: bool, line: int, idx: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Parts of the records that begin in a split, after ``line`` lines and ``idx`` records."""
    with opened(path) as file:
        reader = Range(file, 0)
        at, held = _to_line(reader, start, stop)
        if at >= stop:
            return
        reader = Held(held, reader)
        if fmt == "fasta":
            yield from cut_fasta(path, reader, windows, at, line, idx, stop)
        else:
            yield from cut_fastq(path, reader, windows, at, line, stop, limit)


def cut_text(path: str, text: bytes) -> Iterator[pa.RecordBatch]:
    """Parts of a text at hand, which is never taken for a compressed one."""
    yield from cut_whole(path, pa.BufferReader(text), "none")


def _small_parts(path: str, text: bytes) -> Iterator[tuple]:
    """Rows of ``PARTS`` of a text at hand, as ``cut_text`` gives them, without an array for each."""
    if len(text) < 2:
        yield path, None, False, 0, None, None, None, None, 0, True, False, None, None, "EmptyFile", EMPTY
        return
    cut = text.find(b"\n")
    windows = cut > 0 and text[cut - 1] == CR
    if text[0] == GT:
        pieces, line, at = text[1:].split(b"\n>"), 1, 0
        for i, piece in enumerate(pieces):
            yield path, "fasta", windows, i, piece, None, None, None, 1, True, i == len(pieces) - 1, line, at, None, None
            line, at = line + piece.count(b"\n") + 1, at + len(piece) + 2
        return
    if text[0] != AT:
        yield path, "fastq", False, 0, None, None, None, None, 0, True, False, None, None, "UnknownFormat", UNKNOWN.format(escaped(text[0]))
        return
    lines, nl, at = text.split(b"\n"), text[-1] == NL, 0
    if nl:
        lines.pop()
    full = len(lines) // 4
    for i in range(full):
        l0, l1, l2, l3 = lines[4 * i : 4 * i + 4]
        yield path, "fastq", windows, i, l0, l1, l2, l3, 4, True, False, 4 * i + 1, at, None, None
        if l0[:1] != b"@" or l2[:1] != b"+" or len(l1) - l1.endswith(b"\r") != len(l3) - l3.endswith(b"\r"):
            return
        at += len(l0) + len(l1) + len(l2) + len(l3) + 4
    if rest := lines[4 * full :]:
        yield path, "fastq", windows, full, *rest, *[None] * (4 - len(rest)), len(rest), nl, True, 4 * full + 1, at, None, None


def texts(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of the texts of rows (path, text), for mapInArrow; parts of small texts share a batch."""
    held, size = [], 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], names=_NAMES)

    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(text) <= most:
                held.extend(_small_parts(path, text))
                size += len(text)
            if held and (size >= most or len(held) >= 10_000 or len(text) > most):
                yield made()
                held, size = [], 0
            if len(text) > most:
                yield from cut_text(path, text)
    if held:
        yield made()


def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the text that the rows of a task make, read forward once; for mapInArrow of a binary column."""
    pieces = (c.as_buffer().to_pybytes() for batch in batches for c in batch.column(0) if c.is_valid)
    first = next(pieces, None)
    if first is not None:  # a task without rows has no stream
        from pyspark import TaskContext

        yield from cut_whole(f"stream-{TaskContext.get().partitionId()}", Piped(chain([first], pieces)), "auto")


def extent(path: str, start: int, stop: int) -> dict:
    """Bytes, lines and records of FASTA that begin in a split of a plain file, and whether it is FASTA."""
    with opened(path) as file:
        codec, fmt, _, _, _ = looked_at(file, "auto")
        if codec:
            raise ValueError(f"files that are read as one text are plain ones, not {codec}: {path}")
        n, records = _count_lines(file, start, stop)
    return {"path": path, "n_bytes": stop - start, "n_lines": n, "n_records": records, "fasta": fmt == "fasta"}


def tasks(of: Callable[[dict], Iterator[pa.RecordBatch]], most: int = BLOCK):
    """A function for mapInArrow of rows that are each cut by ``of``; small results leave together."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for made in of(row):
                    held.append(made)
                    size += made.nbytes
                    if size >= most or len(held) >= 2000:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run
