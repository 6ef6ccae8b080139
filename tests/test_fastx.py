"""Sources and sinks: grammar, errors, positions, codecs, splits and streams."""

import bz2
import gzip
import io
import lzma
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from strandframe.plans.queries import _packed_reads
from strandframe.schema import FastxError
from strandframe.sinks import fastx as sink
from strandframe.sources import fastx as source
from strandframe.streaming.fasta import stream_fasta, stream_fastx

#: text -> (id, raw_seq, qual) of its records, and the kind and line of its error
CASES = {
    ">test\nAGCT\n>test2\nGATC": ([("test", "AGCT", None), ("test2", "GATC", None)], None),
    ">test\nAG\nCT\n>test2\nGA\nTC\n": ([("test", "AG\nCT", None), ("test2", "GA\nTC", None)], None),
    ">test\r\nAG\r\nCT\r\n>test2\r\nGATC\r\n": ([("test", "AG\r\nCT", None), ("test2", "GATC", None)], None),
    ">read1\nACGT\nread2\nGGGG": ([("read1", "ACGT\nread2\nGGGG", None)], None),
    ">a\n>b\nAC": ([("a", "", None), ("b", "AC", None)], None),
    ">\n\n>shine\nAGGAGGU": ([("", "", None), ("shine", "AGGAGGU", None)], None),
    ">a\n\n": ([("a", "", None)], None),
    ">a>b\nA>C": ([("a>b", "A>C", None)], None),
    ">a\nAC\n>": ([("a", "AC", None)], ("UnexpectedEnd", 3)),
    ">a\nAC\n>b": ([("a", "AC", None)], ("UnexpectedEnd", 3)),
    ">b\n": ([], ("UnexpectedEnd", 1)),
    "@t\nAGCT\n+t\n~~a!\n@t2\nTGC\n+\nWUI": ([("t", "AGCT", "~~a!"), ("t2", "TGC", "WUI")], None),
    "@t\r\nAGCT\r\n+\r\n~~a!\r\n": ([("t", "AGCT", "~~a!")], None),
    "@t\nA\n+\n@\n@u\nC\n+\n+\n": ([("t", "A", "@"), ("u", "C", "+")], None),
    "@a\n\n+\n": ([("a", "", "")], None),
    "@a\n\n+\n\n": ([("a", "", "")], None),
    "@t\nAGCT\n+\nIIII\n\n": ([("t", "AGCT", "IIII")], None),
    "@t\nAGCT\n+\nIIII\n\n\n": ([("t", "AGCT", "IIII")], None),
    "@t\nAGCT\n+\nIIII\n\n\n\n": ([("t", "AGCT", "IIII")], ("InvalidStart", 5)),
    "@t\nAGCT\n+\nIII": ([], ("UnequalLengths", 1)),
    "@t\nAGCT\n+\nIIII\n@u\nAC": ([("t", "AGCT", "IIII")], ("UnexpectedEnd", 6)),
    "@t\nAGCT\n+\nIIII\n@u": ([("t", "AGCT", "IIII")], ("UnexpectedEnd", 5)),
    "@t\nAGCT\nx\nIIII\n@u\nA\n+\nI\n": ([], ("InvalidSeparator", 3)),
    "@t\nAGCT\n+\nIIII\nu\nA\n+\nI\n@v\nA\n+\nI\n": ([("t", "AGCT", "IIII")], ("InvalidStart", 5)),
    "": ([], ("EmptyFile", 0)),
    ">": ([], ("EmptyFile", 0)),
    "read\n": ([], ("UnknownFormat", 0)),
    "#c\n>a\nA": ([], ("UnknownFormat", 0)),
}


def delivered(rows):
    good = [(r.id, r.raw_seq, r.qual) for r in rows if r.error is None]
    bad = [(r.error.kind, r.error.line) for r in rows if r.error is not None]
    assert len(bad) <= 1
    return good, bad[0] if bad else None


def by_path(df):
    out = {}
    for r in df.orderBy("path", "record_idx").collect():
        out.setdefault(r.path, []).append(r)
    return out


@pytest.mark.parametrize("split", ["128m", "7b"])
@pytest.mark.parametrize("positions", [True, False])
def test_grammar_of_files(spark, tmp_path, split, positions):
    for i, text in enumerate(CASES):
        (tmp_path / f"{i:03}.txt").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b" if split == "7b" else "4m")
    try:
        found = by_path(source.read_fastx(spark, str(tmp_path), positions=positions))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for i, (text, (good, bad)) in enumerate(CASES.items()):
        rows = next((v for k, v in found.items() if k.endswith(f"/{i:03}.txt")), [])
        got, error = delivered(rows)
        assert got == good, text
        assert (error and error[0]) == (bad and bad[0]), text
        if positions and bad:
            assert error == bad, text


def test_grammar_of_texts(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "path long, text string")
    found = by_path(source.parse_strings(df))
    for i, (text, (good, bad)) in enumerate(CASES.items()):
        assert delivered(found.get(str(i), [])) == (good, bad), text


def test_modes(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@t\nA\n+\nI\n@u x\nAC\n+\nI\n")
    path = str(tmp_path / "a.fq")
    assert source.read_fastx(spark, path, mode="DROPMALFORMED").count() == 1
    row = source.read_fastx(spark, path).where("error is not null").first()
    assert row.error.id == "u" and row.error.format == "fastq"
    text = source.read_fastx(spark, path).where("error is not null").select(source.error_text(F.col("error"))).first()[0]
    assert text == "Sequence length is 2 but quality length is 1 (record 'u' at line 5)"
    with pytest.raises(Exception, match="FastxError"):
        list(source.records(source.read_fastx(spark, path, mode="FAILFAST")))
    (tmp_path / "b.fq").write_text("x")
    with pytest.raises(FastxError):
        source.read_fastx(spark, str(tmp_path / "b.fq"), mode="FAILFAST")
    with pytest.raises(ValueError):
        source.read_fastx(spark, path, mode="LOUD")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        source.read_fastx(spark, str(tmp_path / "none"))


def test_positions(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@test\nAGCT\n+test\n~~a!\n@test2\nTGCA\n+test\nWUI9\n@x\nA\n+\nI\n")
    rows = by_path(source.read_fastx(spark, str(tmp_path)))
    assert [(r.start_line, r.start_byte) for r in next(iter(rows.values()))] == [(1, 0), (5, 22), (9, 45)]
    (tmp_path / "a.fq").unlink()
    (tmp_path / "b.fa").write_bytes(b">t\r\nAG\r\nCT\r\n>t2\r\nGA\r\n")
    rows = next(iter(by_path(source.read_fastx(spark, str(tmp_path))).values()))
    assert [(r.start_line, r.start_byte, r.line_ending) for r in rows] == [(1, 0, "windows"), (4, 12, "windows")]


def test_random_splits(spark, tmp_path):
    made = random.Random(3)
    want = {}
    for i in range(12):
        text = ""
        for k in range(made.randrange(1, 12)):
            n = made.randrange(0, 30)
            seq, qual = "".join(made.choices("ACGT", k=n)), "".join(made.choices("@+>I!", k=n))
            text += f"@r{k}\r x\n{seq}\n+\n{qual}\n" if i % 2 else f">r{k}\n{seq}\n" + ">x\n"[: 3 * (n % 2)]
        (tmp_path / f"{i}.txt").write_text(text, newline="")
        want[f"{i}.txt"] = text.count("\n") // 4 if i % 2 else text.count(">")
    results = []
    for split in ("9b", "31b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        df = source.read_fastx(spark, str(tmp_path)).where("error is null")
        results.append({k.rsplit("/")[-1]: [tuple(r) for r in v] for k, v in by_path(df).items()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("pack, suffix", [(gzip.compress, ".gz"), (bz2.compress, ".bz2"), (lzma.compress, ".xz"), (zstandard.compress, ".zst"), (gzip.compress, ".xz"), (bz2.compress, "")])
def test_codecs(spark, tmp_path, pack, suffix):
    (tmp_path / f"a.fa{suffix}").write_bytes(pack(b">id1\nAGTC\nGTCA\n") + pack(b">id2\nAC"))
    (tmp_path / f"b.fq{suffix}").write_bytes(pack(b"@id1\nAGTC\n+\nIIII\n@id2\nAC\n+\nI"))
    (tmp_path / f"c{suffix}").write_bytes(pack(b""))
    found = {k.rsplit("/")[-1][0]: v for k, v in by_path(source.read_fastx(spark, str(tmp_path))).items()}
    assert delivered(found["a"]) == ([("id1", "AGTC\nGTCA", None), ("id2", "AC", None)], None)
    assert delivered(found["b"]) == ([("id1", "AGTC", "IIII")], ("UnequalLengths", 5))
    assert delivered(found["c"]) == ([], ("EmptyFile", 0))
    plain = source.read_fastx(spark, str(tmp_path / f"a.fa{suffix}"), compression="none").first()
    assert plain.error.kind == "UnknownFormat"


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_standard_input(spark, tmp_path, pack):
    found = source.read_stdin(spark, str(tmp_path / "spool"), io.BytesIO(pack(b">id1\nAGTC\xff\n>id2\nAC")))
    assert delivered(found.orderBy("record_idx").collect()) == ([("id1", "AGTC\xff", None), ("id2", "AC", None)], None)
    assert delivered(source.read_stdin(spark, str(tmp_path / "none"), io.BytesIO(pack(b""))).collect()) == ([], ("EmptyFile", 0))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        source.read_stdin(spark, str(tmp_path / "none"), io.BytesIO(b">a\nA"))


def test_bytes_survive(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">caf\xc3\xa9 \xff\nAC\xe9T\n")
    row = source.read_fastx(spark, str(tmp_path)).first()
    assert row.id.encode("latin-1") == b"caf\xc3\xa9 \xff" and len(row.seq) == 4
    sink.write_fasta(source.read_fastx(spark, str(tmp_path)), str(tmp_path / "out"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*")) == b">caf\xc3\xa9 \xff\nAC\xe9T\n"


def test_write(spark, tmp_path):
    df = spark.createDataFrame([("a", "AC", "II"), ("b", "G", None)], "id string, seq string, qual string").coalesce(1)
    sink.write_fastq(df, str(tmp_path / "q"), line_ending="windows")
    assert next((tmp_path / "q").glob("part-*")).read_bytes() == b"@a\r\nAC\r\n+\r\nII\r\n@b\r\nG\r\n+\r\nI\r\n"
    (tmp_path / "w.fa").write_bytes(b">a\r\nAC\r\nGT\r\n>b\r\nA\r\n")
    records = source.read_fastx(spark, str(tmp_path / "w.fa")).orderBy("record_idx")
    sink.write_records(records.coalesce(1), str(tmp_path / "same"))
    assert next((tmp_path / "same").glob("part-*")).read_bytes() == b">a\r\nAC\r\nGT\r\n>b\r\nA\r\n"
    sink.write_records(records.coalesce(1), str(tmp_path / "unix"), line_ending="unix")
    assert next((tmp_path / "unix").glob("part-*")).read_bytes() == b">a\nAC\r\nGT\n>b\nA\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.fa").write_text(f">r{i}\nAC\nGT\n>s{i}\r\nA\r\n")
    query = stream_fasta(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fasta_rows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("select id, seq from fasta_rows order by id").collect()
    assert [tuple(r) for r in rows] == [("r0", "ACGT"), ("r1", "ACGT"), ("r2", "ACGT"), ("s0", "A"), ("s1", "A"), ("s2", "A")]


@pytest.mark.parametrize("level", [1, 3])
def test_zstd_first_block_over_prefix(spark, tmp_path, level):
    made = random.Random(7)
    protein = "".join(f">p{i}\n{''.join(made.choices('ACDEFGHIKLMNPQRSTVWY', k=500))}\n" for i in range(3000))
    scores = "".join(map(chr, range(33, 74)))
    fastq = "".join(f"@q{i}\n{''.join(made.choices('ACGT', k=150))}\n+\n{''.join(made.choices(scores, k=150))}\n" for i in range(5500))
    for name, text in (("a.fa", protein), ("b.fq", fastq)):
        packed = zstandard.ZstdCompressor(level=level).compress(text.encode())
        assert len(text) > 1 << 20 and not zstandard.ZstdDecompressor().decompressobj().decompress(packed[: source.PREFIX])
        (tmp_path / f"{name}.zst").write_bytes(packed)
    found = source.read_fastx(spark, str(tmp_path), mode="FAILFAST").groupBy("format").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases")).collect()
    assert {(r.format, r.n, r.bases) for r in found} == {("fasta", 3000, 1500000), ("fastq", 5500, 825000)}


def test_packed_file_without_text_is_empty(spark, tmp_path):
    (tmp_path / "a.zst").write_bytes(zstandard.compress(b"") * 9000)
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"") * 4000 + gzip.compress(b">a\nAC\n"))
    found = {k.rsplit("/")[-1]: delivered(v) for k, v in by_path(source.read_fastx(spark, str(tmp_path))).items()}
    assert found == {"a.zst": ([], ("EmptyFile", 0)), "b.gz": ([("a", "AC", None)], None)}


@pytest.mark.parametrize("suffix", [".xz", ".zst"])
def test_packed_reads_of_several_files(spark, suffix):
    base = F.md5(F.col("id").cast("string"))
    r = spark.range(30000).select("id", F.concat(F.lit("read"), "id").alias("name"), F.translate(base, "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"), base.alias("qual"))
    found = _packed_reads(spark, r.repartition(3), suffix)  # over 0.8 MB of text a file
    assert found.inputFiles() and len({f for f in found.inputFiles()}) == 3
    want = r.select("id", "name", "seq", "qual")
    got = found.select("id", "name", "seq", "qual")
    assert got.count() == 30000 and not got.exceptAll(want).count()


def test_streams_follow_the_batch_reader(spark, tmp_path):
    """Both formats, packed and plain, with their errors."""
    (tmp_path / "in").mkdir()
    for i, text in enumerate(CASES):
        (tmp_path / "in" / f"{i:03}.txt").write_bytes((gzip.compress if i % 3 == 0 else bytes)(text.encode()))
    (tmp_path / "in" / "odd.fa").write_bytes(b">>b\nAC\n\n>c\n\n\nG\n")
    query = stream_fastx(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("fastx_rows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = source.read_fastx(spark, str(tmp_path / "in"))
    got = spark.table("fastx_rows")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert [r.id for r in got.where("path like '%odd.fa'").orderBy("record_idx").collect()] == [">b", "c"]


def test_many_texts_and_repeated_keys(spark):
    """One text of many records takes time in proportion; rows of one key are texts of their own."""
    n = 20000
    df = spark.createDataFrame([("a", "".join(f"@r{k}\nAC\n+\nII\n" for k in range(n))), ("b", ">x\nA\n"), ("b", ">y\nC\n>z\nG"), (None, None)], "path string, text string")
    found = source.parse_strings(df)
    assert found.where("path = 'a' and error is null").agg(F.count("*"), F.max("start_line"), F.max("record_idx")).first() == (n, 4 * n - 3, n - 1)
    assert sorted((r.path, r.record_idx, r.id) for r in found.where("path = 'b'").collect()) == [("b", 0, "x"), ("b", 0, "y"), ("b", 1, "z")]
    assert found.where("path is null").first().error.kind == "EmptyFile"


def test_files_in_order_are_one_text(spark, tmp_path):
    want, line, byte = [], 1, 0
    for n in range(3):
        text = "".join(f"@r{n}-{i}\nACGT\n+\nIIII\n" for i in range(n + 2))
        (tmp_path / f"part-{n}.fastq").write_text(text)
        for i in range(n + 2):
            want.append((f"r{n}-{i}", len(want), line, byte))
            line, byte = line + 4, byte + len(f"@r{n}-{i}\nACGT\n+\nIIII\n")
    for split in (7, 1 << 20):
        found = source.read_fastx(spark, tmp_path, mode="FAILFAST", joined=True, split=split).orderBy("record_idx")
        assert [tuple(r) for r in found.select("id", "record_idx", "start_line", "start_byte").collect()] == want
    seen = source.fold(found, lambda held, r: (held[0] + 1, held[1] + len(r.seq)), (0, 0), "n long, bases long").groupBy().sum().first()
    assert tuple(seen) == (9, 36)
    with pytest.raises(ValueError, match="FAILFAST"):
        source.read_fastx(spark, tmp_path, joined=True)


def test_fasta_files_in_order_are_one_text(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a\nAC\nGT\n>b\nA\n")
    (tmp_path / "b.fasta").write_text(">c\nACG\n>d\nT\nT\n")
    found = source.read_fastx(spark, tmp_path, mode="FAILFAST", joined=True, split=5).orderBy("record_idx")
    assert [tuple(r) for r in found.select("id", "record_idx", "start_line", "start_byte").collect()] == [("a", 0, 1, 0), ("b", 1, 4, 9), ("c", 2, 6, 14), ("d", 3, 8, 21)]


def test_streams_of_tasks(spark):
    rows = [(0, b"@a\nAC"), (0, b"GT\n+\nII"), (0, b"II\n@b\nA\n+\nI\n"), (1, b"@c\nT\n+\nII\n"), (2, gzip.compress(b">d\nAC\nG\n"))]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "task int, text binary").repartitionByRange(3, "task").sortWithinPartitions("task")
    found = source.read_streams(texts).collect()
    assert sorted((r.id, r.seq) for r in found if r.error is None) == [("a", "ACGT"), ("b", "A"), ("d", "ACG")]
    assert [r.error.kind for r in found if r.error] == ["UnequalLengths"]
