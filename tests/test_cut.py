"""Cutting files in splits, against reading them in order; truncated and damaged streams."""

import bz2
import gzip
import lzma
import random

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strandframe.sources import _cut
from strandframe.sources import fastx as source

PACKS = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.compress}


def rows(batches):
    return [r for b in batches for r in b.to_pylist()]


def in_splits(path, size, split):
    """The parts of a plain file as the plan of ``read_fastx`` puts them together."""
    places = [(at, min(at + split, size)) for at in range(0, size, split)]
    looked = [_cut.survey(path, a, b, size, "auto") for a, b in places]
    if looked[0]["whole"]:
        with _cut.opened(path) as f:
            return rows(_cut.cut_whole(path, f, "auto"))
    lines = [sum(x["n_lines"] for x in looked[:i]) for i in range(len(looked))]
    idx = [sum(x["n_records"] for x in looked[:i]) for i in range(len(looked))]
    bad = [(lines[i] + x[f"b{-lines[i] % 4}"]) // 4 for i, x in enumerate(looked) if x[f"b{-lines[i] % 4}"] is not None]
    limit = min(bad, default=None)
    out = []
    for (a, b), x, line, i in zip(places, looked, lines, idx):
        if limit is None or line <= 4 * limit + 3:
            out += rows(_cut.cut_split(path, x["fmt"], a, b, looked[0]["windows"], line, i, limit))
    return out


def fastq(made, n, wrong):
    text = ""
    for k in range(n):
        size = made.choice([0, 1, 3, made.randrange(40)])
        eol = made.choice(["\n", "\n", "\r\n"])
        seq, qual = "".join(made.choices("ACGTN", k=size)), "".join(made.choices("@+>I!", k=size))
        if made.random() < wrong:
            qual += made.choice(["@", "\n", ""])
        text += eol.join([made.choice(["@", "@", "@", "" if wrong > 0.02 else "@"]) + f"r{k}", seq, "+" + made.choice(["", "x"]), qual, ""])
    return text[: len(text) - made.choice([0, 0, 1, 2, 5])] + made.choice(["", "", "\n", "\n\n"])


def fasta(made, n):
    text = ""
    for k in range(n):
        text += ">" + made.choice(["", ">", f"r{k}", "a>b"]) + made.choice(["\n", "\r\n"])
        text += "".join("".join(made.choices("ACGT>", k=made.randrange(12))).lstrip(">") + made.choice(["\n", "\r\n", "\n\n"]) for _ in range(made.randrange(4)))
    return text[: len(text) - made.choice([0, 0, 1, 2, 3])] + made.choice(["", "\n>", "\n>x\n"])


@pytest.mark.parametrize("block", [5, 64, 1 << 22])
def test_splits_agree_with_one_pass(tmp_path, monkeypatch, block):
    made = random.Random(block)
    monkeypatch.setattr(_cut, "BLOCK", block)
    monkeypatch.setattr(_cut, "PREFIX", min(block, 1 << 16))
    path = tmp_path / "a.txt"
    for round in range(120 if block > 5 else 50):
        text = fastq(made, made.randrange(1, 14), made.choice([0, 0.01, 0.1])) if round % 2 else fasta(made, made.randrange(1, 9))
        text = text or "@"
        path.write_bytes(text.encode())
        with _cut.opened(f"file:{path}") as f:
            want = rows(_cut.cut_whole(f"file:{path}", f, "auto"))
        for split in (1, 2, 3, 7, 16, 50, 200):
            assert in_splits(f"file:{path}", len(text.encode()), split) == want, (text, split)


def by_records(text):
    with pa.BufferReader(text) as f:
        return rows(_cut.cut_whole("p", f, "auto"))


def test_line_ends_are_those_of_the_first_line(monkeypatch):
    monkeypatch.setattr(_cut, "BLOCK", 8)
    for head in (b">" + b"x" * 50, b"@" + b"x" * 50):
        body = (b"\nAC\n" if head[:1] == b">" else b"\nAC\n+\nII\n") * 1
        assert not any(r["windows"] for r in by_records(head + body)) and all(r["windows"] for r in by_records(head + b"\r" + body))


@pytest.mark.parametrize("codec", sorted(PACKS))
@pytest.mark.parametrize("fmt", ["fasta", "fastq"])
def test_truncated_and_damaged_streams(codec, fmt):
    made = random.Random(5)
    seq = lambda: "".join(made.choices("ACGT", k=300))
    text = "".join(f">r{k}\n{seq()}\n" if fmt == "fasta" else f"@r{k}\n{seq()}\n+\n{'I' * 300}\n" for k in range(6000)).encode()
    packed = PACKS[codec](text)
    whole = by_records(packed)
    assert len(whole) == 6000 and not any(r["fault"] for r in whole)
    cut = by_records(packed[: 2 * len(packed) // 3])
    assert [r["fault"] for r in cut[-1:]] == ["Io"] and 0 < len(cut) < 6000
    assert [(r["l0"], r["l1"]) for r in cut[:-1]] == [(r["l0"], r["l1"]) for r in whole[: len(cut) - 1]]
    assert cut[-1]["record_idx"] == len(cut) - 1
    at = 3 * len(packed) // 4
    hurt = by_records(packed[:at] + bytes(b ^ 0x5A for b in packed[at : at + 2000]) + packed[at + 2000 :])
    # a byte that is wrong may unpack to text that is wrong, which then is the first error
    wrong = fmt == "fastq" and (hurt[-1]["l0"][:1] != b"@" or hurt[-1]["l2"][:1] != b"+" or len(hurt[-1]["l1"]) != len(hurt[-1]["l3"])) if not hurt[-1]["fault"] else hurt[-1]["fault"] == "Io"
    assert wrong and all(r["l0"] == w["l0"] for r, w in zip(hurt[: len(hurt) // 2], whole))
    assert by_records(packed[:3])[0]["fault"] in ("EmptyFile", "Io")
    twice = by_records(packed + packed)
    assert len(twice) == 12000 and not any(r["fault"] for r in twice)
    if codec == "xz":
        assert len(by_records(packed + bytes(8) + packed + bytes(4))) == 12000


@pytest.mark.parametrize("codec", sorted(PACKS))
def test_modes_of_truncated_files(spark, tmp_path, codec):
    made = random.Random(6)
    text = "".join(f"@r{k}\n{''.join(made.choices('ACGT', k=200))}\n+\n{''.join(made.choices('ABCDEFGHIJ', k=200))}\n" for k in range(8000)).encode()
    (tmp_path / "a.fq").write_bytes(PACKS[codec](text)[:-40000])
    found = source.read_fastx(spark, str(tmp_path))
    kinds = {r.kind: r.n for r in found.groupBy(F.col("error.kind").alias("kind")).agg(F.count("*").alias("n")).collect()}
    assert kinds["Io"] == 1 and 1000 < kinds[None] < 8000
    row = found.where("error is not null").select("error", source.error_text(F.col("error")).alias("text"), "format").first()
    assert row.text.startswith("I/O error: ") and row.error.format is None and row.format == "fastq"
    assert source.read_fastx(spark, str(tmp_path), mode="DROPMALFORMED").count() == kinds[None]
    with pytest.raises(Exception, match="I/O error"):
        source.read_fastx(spark, str(tmp_path), mode="FAILFAST").collect()


def test_plan_reads_files_without_moving_sequences(spark, tmp_path):
    text = "".join(f"@r{k}\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for k in range(3000))
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fa").write_text("".join(f">r{k}\n{'ACGT' * 20}\nAC\n" for k in range(3000)))
    (tmp_path / "c.fq").write_text(text + "@bad\nA\n+\n\n" + text)
    found = source.read_fastx(spark, str(tmp_path), split=50_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert plan.count("MapInArrow") == 2 and not any(f" l{k}#" in line for line in moved for k in range(4))
    assert "Sort" not in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[0]
    per = {r.path[-4:]: r for r in found.groupBy("path").agg(F.count("*").alias("n"), F.max("record_idx").alias("last"), F.max("error.kind").alias("kind"), F.max("error.line").alias("line"), F.countDistinct("start_byte").alias("bytes")).collect()}
    assert [(per[p].n, per[p].last, per[p].kind, per[p].line, per[p].bytes) for p in ("a.fq", "b.fa", "c.fq")] == [(3000, 2999, None, None, 3000), (3000, 2999, None, None, 3000), (3001, 3000, "UnequalLengths", 12001, 3001)]
    whole = source.read_fastx(spark, str(tmp_path))
    assert whole.exceptAll(found).count() == 0 == found.exceptAll(whole).count()


def test_raw_records(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">a x\r\nAC\r\nGT\r\n>b\r\nA\r\n")
    (tmp_path / "b.fq").write_bytes(b"@a\nAC\n+same\nII\n@b\nA\n+\nI")
    raw = {(r.path[-4:], r.record_idx): r.raw for r in source.read_fastx(spark, str(tmp_path), keep_raw=True).collect()}
    assert raw == {("a.fa", 0): ">a x\r\nAC\r\nGT\r", ("a.fa", 1): ">b\r\nA\r", ("b.fq", 0): "@a\nAC\n+same\nII", ("b.fq", 1): "@b\nA\n+\nI"}


def test_file_systems_that_arrow_does_not_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fa").write_bytes(b">a\nAC\n>b\nG\n")
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n"))
    (tmp_path / "c.fq").write_bytes(b"")
    want = source.read_fastx(spark, str(tmp_path)).orderBy("path", "record_idx").collect()
    monkeypatch.setattr(source, "_opens", lambda path: False)
    assert source.read_fastx(spark, str(tmp_path)).orderBy("path", "record_idx").collect() == want and len(want) == 4


def test_small_texts_share_batches_and_agree_with_those_cut_alone():
    import random

    import pyarrow as pa

    from strandframe.sources import _cut

    r = random.Random(7)
    pieces = [b"@a\n", b"@a\r\n", b">b\n", b">", b"@", b"+\n", b"+", b"\n", b"\r\n", b"\r", b"ACGT\n", b"ACGT\r\n", b"IIII", b"IIII\n", b"@a\nAC\n+\nII\n", b"@a\r\nAC\r\n+\r\nII\r\n", b">c d\nAC\nGT\n"]
    texts = [b"", b">", b"@", b"x", b"xy", b"'y", b"\n\n"] + [b"".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(6000)]
    given = pa.record_batch([pa.array([str(i) for i in range(len(texts))]), pa.array(texts, pa.binary())], names=["path", "text"])
    alone = [row for i, t in enumerate(texts) for b in _cut.cut_text(str(i), t) for row in b.to_pylist()]
    together = list(_cut.texts(iter([given])))
    assert [row for b in together for row in b.to_pylist()] == alone
    assert len(together) < 10
    assert [row for b in _cut.texts(iter([given]), most=20) for row in b.to_pylist()] == alone
