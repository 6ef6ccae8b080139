"""FASTA and FASTQ sources.

Files are listed by Spark and cut into splits of ``SPLIT`` bytes.  Tasks open the
files themselves, so compression and format are found out where the splits are
read, by the first bytes of each file.  Splits of plain files are looked at first:
how many lines and records begin in each, and where the first wrong record is.  A
sum over these few numbers by file gives each split the place of its records, and
the splits are cut, each by itself.  No sequence is shuffled.

Compressed files cannot be split.  One task unpacks each in a stream, in one pass,
whatever its size; what can be unpacked is delivered before the error that a broken
or truncated stream ends with.

File systems that Arrow does not open are read by Spark's ``binaryFile``, a file a
row, which Spark limits to 2 GB a file.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions.sequence import public_text
from strandframe.schema import RECORD, FastxError
from strandframe.sources import _cut
from strandframe.sources._cut import PREFIX  # noqa: F401

SPLIT = 32 << 20  #: bytes of a split
MOST_TASKS = 100_000
MODES = ("PERMISSIVE", "FAILFAST", "DROPMALFORMED")


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if re.match(r"[\w+.-]+:", path) else path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _escaped_column(c: Column) -> Column:
    special = F.create_map(*[x for k, v in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n"), ("'", "\\'"), ('"', '\\"'), ("\\", "\\\\")) for x in (F.lit(k), F.lit(v))])
    hexed = F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))
    return F.coalesce(F.element_at(special, c), F.when(c.rlike("^[ -~]\\z"), c).otherwise(hexed))


# -- cutting files into parts ------------------------------------------------


def _opens(path: str) -> bool:
    """Whether Arrow knows the file system of a path."""
    try:
        _cut.opened(path).close()
    except Exception:  # noqa: BLE001  whatever a file system without its library raises
        return False
    return True


def _without_bytes(binary: DataFrame) -> DataFrame | None:
    """The paths of empty files, which Spark lists but makes no rows of."""
    every = {re.sub("^file:/+", "file:/", unquote(f)) for f in binary.inputFiles()}
    if binary.count() == len(every):
        return None
    rest = sorted(every - {r["path"] for r in binary.select("path").toLocalIterator()})
    return binary.sparkSession.createDataFrame([(f,) for f in rest], "path string") if rest else None


def _parts_of_files(spark: SparkSession, paths: list[str], compression: str, split: int) -> tuple[DataFrame, DataFrame | None]:
    """The parts of files, and (path, fault, message) of those that give none from their first bytes on."""
    _find_package(spark)
    binary = spark.read.format("binaryFile").load(paths)
    if len(paths) > 1:
        binary = binary.dropDuplicates(["path"])
    empty = _without_bytes(binary)
    listed = binary.select("path", "length")
    listed = listed.unionByName(empty.withColumn("length", F.lit(0).cast("long"))) if empty is not None else listed
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / split))
    seen = listed.agg(F.count("*").alias("files"), F.sum(pieces).alias("splits"), F.max("length").alias("longest"), F.min_by("path", "length").alias("some")).first()
    if seen["files"] and not _opens(seen["some"]):
        content = binary.select("path", "content")
        content = content.unionByName(empty.withColumn("content", F.lit(b"").cast("binary"))) if empty is not None else content
        return content.mapInArrow(_cut.tasks(_whole_content(compression)), _cut.PARTS), content.mapInArrow(_faults(compression), "path string, fault string, message string")
    heads = listed.select("path").repartition(max(1, min(seen["files"], MOST_TASKS))).mapInArrow(_faults(compression), "path string, fault string, message string")
    if (seen["longest"] or 0) <= split:
        whole = listed.select("path").repartition(max(1, min(seen["files"], MOST_TASKS)))
        return whole.mapInArrow(_cut.tasks(_whole_file(compression)), _cut.PARTS), heads
    n = min(seen["splits"], MOST_TASKS)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long")))
    splits = listed.select("path", "length", start.alias("start")).select("path", "start", F.least(F.col("start") + split, "length").alias("stop"), "length")
    looked = splits.repartition(n).mapInArrow(_surveys(compression), _cut.SURVEY)
    order, every = Window.partitionBy("path").orderBy("start"), Window.partitionBy("path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = looked.withColumn("line", F.coalesce(F.sum("n_lines").over(before), F.lit(0))).withColumn("idx", F.coalesce(F.sum("n_records").over(before), F.lit(0))).withColumn("windows", F.max("windows").over(every))
    bad = F.element_at(F.array("b0", "b1", "b2", "b3"), (F.pmod(-F.col("line"), F.lit(4)) + 1).cast("int"))
    placed = placed.withColumn("limit", F.min(F.floor((F.col("line") + bad) / 4)).over(every))
    wanted = placed.where("whole and start = 0 or not whole and (limit is null or line <= 4 * limit + 3)")
    return wanted.select("path", "whole", "fmt", "start", "stop", "windows", "line", "idx", "limit").repartition(n).mapInArrow(_cut.tasks(_split_or_whole(compression)), _cut.PARTS), heads


def _whole_file(compression: str):
    def cut(row):
        with _cut.opened(row["path"]) as file:
            yield from _cut.cut_whole(row["path"], file, compression)

    return cut


def _whole_content(compression: str):
    def cut(row):
        import pyarrow as pa

        yield from _cut.cut_whole(row["path"], pa.BufferReader(row["content"]), compression)

    return cut


def _split_or_whole(compression: str):
    whole = _whole_file(compression)

    def cut(row):
        if row["whole"]:
            yield from whole(row)
        else:
            yield from _cut.cut_split(row["path"], row["fmt"], row["start"], row["stop"], row["windows"], row["line"], row["idx"], row["limit"])

    return cut


def _extents(batches):
    import pyarrow as pa

    for batch in batches:
        found = [_cut.extent(r["path"], r["start"], r["stop"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(found, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("n_bytes", "n_lines", "n_records")), ("fasta", pa.bool_())]))


def _run_on(spark: SparkSession, records: DataFrame, paths: list[str], split: int) -> DataFrame:
    """Records whose numbers and places run on from file to file, in the order of names."""
    listed = spark.read.format("binaryFile").load(paths).dropDuplicates(["path"]).select("path", "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long")))
    splits = listed.select("path", "length", start.alias("start")).select("path", "start", F.least(F.col("start") + split, "length").alias("stop"))
    n = max(1, min(listed.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 0, MOST_TASKS))
    sizes = splits.repartition(n).mapInArrow(_extents, _cut.EXTENT).groupBy("path").agg(F.sum("n_bytes").alias("__b"), F.sum("n_lines").alias("__l"), F.when(F.first("fasta"), F.sum("n_records")).otherwise(F.ceil(F.sum("n_lines") / 4)).alias("__r"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    places = sizes.select("path", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__b", "__l", "__r")))
    moved = {"record_idx": F.col("record_idx") + F.col("__r"), "start_line": F.col("start_line") + F.col("__l"), "start_byte": F.col("start_byte") + F.col("__b")}
    return records.join(F.broadcast(places), "path").select(*(moved[c].alias(c) if c in moved else c for c in records.columns))


def _surveys(compression: str):
    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in _cut.SURVEY.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), *[pa.int64()] * 6]
        for batch in batches:
            found = [_cut.survey(r["path"], r["start"], r["stop"], r["length"], compression) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in zip(names, types)], names=names)

    return run


def _faults(compression: str):
    """Rows (path, fault, message) of files whose first bytes are no FASTA or FASTQ, for mapInArrow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with pa.BufferReader(row["content"]) if "content" in row else _cut.opened(row["path"]) as file:
                    _, _, fault, message, _ = _cut.looked_at(file, compression)
                if fault:
                    out.append((row["path"], fault, message))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["path", "fault", "message"])

    return run


# -- the grammar -------------------------------------------------------------


def _trim_cr(c: Column) -> Column:
    return F.when(c.endswith("\r"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def _error(kind: str, msg: Column | str, line: Column, id: Column | None, fmt: str | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"), line.cast("bigint").alias("line"),
        (none if id is None else id).alias("id"), (F.lit(fmt) if fmt else none).alias("format"),
    )


def _fasta(v: Column) -> dict[str, Column]:
    """Columns of a FASTA part; a last one whose header has no line after it is an error."""
    closed = F.when(F.col("last") & v.endswith("\n"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)  # the file's last line end
    cut = F.instr(closed, "\n")
    head = F.when(cut > 0, F.substring(closed, F.lit(1), cut - 1)).otherwise(closed)
    body = _trim_cr(F.when(cut > 0, F.substring(closed, cut + 1, F.length(closed))).otherwise(""))
    error = F.when(F.col("last") & (cut == 0), _error("UnexpectedEnd", "", F.col("start_line"), None, "fasta"))
    return {"id": _trim_cr(head), "raw_seq": body, "seq": F.translate(body, "\r\n", ""), "qual": F.lit(None).cast("string"), "raw": F.concat(F.lit(">"), closed), "error": error}


def _fastq(l0: Column, l1: Column, l2: Column, l3: Column) -> tuple[dict[str, Column], Column]:
    """Columns of a FASTQ part, errors as the order of checks gives them, and whether it is a blank end."""
    nl, n, line = F.col("nl"), F.col("n_lines"), F.col("start_line")
    l3 = F.when((n == 3) & nl, "").otherwise(l3)
    whole = (n == 4) | ((n == 3) & nl)
    short = F.col("last") & ~whole
    blank = lambda c: F.coalesce(_trim_cr(c) == "", F.lit(True))
    head = _trim_cr(F.substring(l0, F.lit(2), F.length(l0)))
    seq, qual = _trim_cr(l1), _trim_cr(l3)
    byte = lambda c: _escaped_column(F.coalesce(F.nullif(F.substring(c, 1, 1), F.lit("")), F.lit("\n")))
    given = F.when(F.length(l0) > 0, public_text(F.substring_index(head, " ", 1)))
    seen = n - F.when(nl, 0).otherwise(1)
    error = (
        F.when(short, _error("UnexpectedEnd", "", line + seen, F.when(seen > 0, given), "fastq"))
        .when(~l0.startswith("@"), _error("InvalidStart", F.concat(F.lit("Expected '@' but found '"), byte(l0)), line, None, "fastq"))
        .when(~l2.startswith("+"), _error("InvalidSeparator", F.concat(F.lit("Expected '+' separator but found '"), byte(l2)), line + 2, given, "fastq"))
        .when(F.length(seq) != F.length(qual), _error("UnequalLengths", F.concat(F.lit("Sequence length is "), F.length(seq).cast("string"), F.lit(" but quality length is "), F.length(qual).cast("string")), line, given, "fastq"))
    )
    return {"id": head, "raw_seq": seq, "seq": seq, "qual": qual, "raw": F.concat_ws("\n", l0, l1, l2, l3), "error": error}, short & blank(l0) & blank(l1) & blank(l2)


def _records(parts: DataFrame, mode: str, positions: bool = True, keep_raw: bool = False) -> DataFrame:
    """Parts as the records of their formats; what a task cut ends at a file's first error."""
    text = parts.select("*", *(F.decode(f"l{k}", "ISO-8859-1").alias(f"__{k}") for k in range(4)))
    fasta = _fasta(F.col("__0"))
    fastq, blank = _fastq(*(F.col(f"__{k}") for k in range(4)))
    text = text.where(F.col("fault").isNotNull() | (F.col("fmt") == "fasta") | ~blank)
    none = F.lit(None).cast("string")
    fault = F.struct(F.col("fault").alias("kind"), F.coalesce("message", F.lit("")).alias("msg"), F.lit(0).cast("bigint").alias("line"), none.alias("id"), F.when(F.col("fault") == "UnknownFormat", "fastq").alias("format"))
    error = F.when(F.col("fault").isNotNull(), fault).when(F.col("fmt") == "fasta", fasta["error"]).otherwise(fastq["error"])
    named = text.withColumn("error", error)
    ok = F.col("error").isNull()
    either = lambda c: F.when(ok, F.when(F.col("fmt") == "fasta", fasta[c]).otherwise(fastq[c])).alias(c)
    line = F.col("start_line") if positions else F.when(F.col("fmt") == "fastq", F.col("start_line"))
    byte = F.col("start_byte") if positions else F.lit(None).cast("long")
    found = named.select(
        "path", F.when(F.coalesce(F.col("fault") == "Io", F.lit(True)), F.col("fmt")).alias("format"), "record_idx", *map(either, ("id", "raw_seq", "seq", "qual")),
        F.when(F.col("windows"), "windows").otherwise("unix").alias("line_ending"), line.alias("start_line"), byte.alias("start_byte"), "error", *([either("raw")] if keep_raw else []),
    )
    return _in_mode(found, mode)


def _in_mode(records: DataFrame, mode: str) -> DataFrame:
    if mode == "DROPMALFORMED":
        return records.where("error is null")
    if mode == "FAILFAST":
        message = F.concat(F.lit("FastxError: "), error_text(F.col("error")))
        return records.withColumn("id", F.when(F.col("error").isNull(), F.col("id")).otherwise(F.raise_error(message).cast("string")))
    return records


def error_text(error: Column) -> Column:
    """The display form of an error column."""
    place = F.concat(F.when(error["id"].isNotNull(), F.concat(F.lit("record '"), error["id"], F.lit("' at "))).otherwise(""), F.lit("line "), error["line"].cast("string"))
    return (
        F.when(error["kind"] == "Io", F.concat(F.lit("I/O error: "), error["msg"]))
        .when(error["kind"] == "UnexpectedEnd", F.concat(F.lit("Unexpected end of input ("), place, F.lit(").")))
        .otherwise(F.concat(error["msg"], F.lit(" ("), place, F.lit(")")))
    )


# -- entry points ------------------------------------------------------------


def _mode(mode: str) -> str:
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    return mode


def read_fastx(spark: SparkSession, path: str | list[str], mode: str = "PERMISSIVE", compression: str = "auto", positions: bool = True, keep_raw: bool = False, split: int | None = None, joined: bool = False) -> DataFrame:
    """Records of FASTA and FASTQ files, plain or compressed, with the columns of ``RECORD``.

    ``mode`` is as for CSV: PERMISSIVE gives the records before a file's first error
    and one row with the error, DROPMALFORMED leaves that row out, FAILFAST raises,
    for files that are neither format at once.  ``compression="none"`` takes
    compressed files for plain ones.  Without ``positions`` start_byte, and start_line
    of FASTA, are null.  ``keep_raw`` adds ``raw``, a record's bytes with all line ends
    but the last.  ``split`` is the number of bytes that a task reads of a plain file.
    With ``joined`` the files are one text in the order of their names, as Spark writes a
    large one in parts: places and record numbers run on.  It is for FAILFAST and plain
    files of which each begins with a record.
    A path that does not exist raises, as with any Spark reader.
    """
    mode = _mode(mode)
    if joined and (mode != "FAILFAST" or compression != "auto"):
        raise ValueError("files are read as one text in mode FAILFAST only, and as they are")
    paths = [str(path)] if isinstance(path, str | os.PathLike) else [str(p) for p in path]
    parts, heads = _parts_of_files(spark, paths, compression, split or SPLIT)
    if mode == "FAILFAST" and (bad := heads.first()):
        raise FastxError(f"{bad['message']} (line 0): {bad['path']}")
    found = _records(parts, mode, positions, keep_raw)
    return _run_on(spark, found, paths, split or SPLIT) if joined else found


def read_stdin(spark: SparkSession, spool: str, stream=None, **how) -> DataFrame:
    """Records of what comes in on standard input, or on another binary ``stream``.

    The driver copies it to the new file ``spool`` a MB at a time, in a folder that
    the executors see; ``how`` is as for ``read_fastx``.
    """
    fs, jpath = _open(spark, spool)
    out = fs.create(jpath, False)
    try:
        while data := (stream or sys.stdin.buffer).read(1 << 20):
            out.write(bytearray(data))
    finally:
        out.close()
    return read_fastx(spark, spool, **how)


def read_streams(df: DataFrame, text: str = "text", mode: str = "PERMISSIVE", positions: bool = True) -> DataFrame:
    """Records of the streams that the tasks of ``df`` are: the rows of a text or binary column, one after another.

    Each is read as ``read_stdin`` reads its stream, forward and once, but by its task:
    nothing goes through the driver.  A record may go over rows, not over tasks.
    """
    _find_package(df.sparkSession)
    return _records(df.select(F.col(text).cast("binary")).mapInArrow(_cut.stream, _cut.PARTS), _mode(mode), positions)


def _find_package(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver does."""
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [held.get("PYTHONPATH", ""), root]))


def parse_strings(df: DataFrame, text: str = "text", mode: str = "PERMISSIVE", key: str = "path", keep_raw: bool = False) -> DataFrame:
    """Records of the FASTA or FASTQ texts of a column, one reader for each row.

    ``key`` names a column that tells the texts apart; it comes back as ``path``.  A
    null text is an empty one.
    """
    mode = _mode(mode)
    _find_package(df.sparkSession)
    texts = df.select(F.col(key).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return _records(texts.mapInArrow(_cut.texts, _cut.PARTS), mode, keep_raw=keep_raw).select(*RECORD.names, *(["raw"] if keep_raw else []))


def records(df: DataFrame) -> Iterator:
    """Rows one after another on the driver, in the order of each file; a FAILFAST frame raises at a bad record."""
    return df.orderBy("path", "record_idx").toLocalIterator()


def fold(df: DataFrame, step: Callable, start: tuple, schema: str) -> DataFrame:
    """What ``step(held, row)`` makes of the rows of a task, from ``start`` on, taken one after another: a row for each task that has any."""
    _find_package(df.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql import Row

        held, n = start, 0
        for batch in batches:
            row = Row(*batch.schema.names)
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                held = step(held, row(*values))
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in held], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.mapInArrow(run, schema)
