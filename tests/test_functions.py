"""Column functions on literal vectors."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions import bits, quality, records, sequence


def column(spark, values, make, kind="string"):
    """The results of a column function over some values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_normalize(spark):
    strict = ["ACGTU", "acgtu", "N.N-N~N N", "BDHVRYSWKM", "bdhvryswkm", "", "n\v1é", "A C\tG\r\nT"]
    assert column(spark, strict, sequence.normalize) == ["ACGTT", "ACGTT", "N-N-N-NN", "N" * 10, "N" * 10, "", "NNNN", "ACGT"]
    assert column(spark, strict[3:5], lambda c: sequence.normalize(c, iupac=True)) == ["BDHVRYSWKM"] * 2
    assert column(spark, ["ACGT", "acgt", None], sequence.normalize_changed) == [False, True, None]


def test_strands(spark):
    assert column(spark, ["acgtn", "AACCn-R", "u", None], sequence.complement) == ["tgcan", "TTGGn-Y", "u", None]
    assert column(spark, ["AACCn-R"], sequence.reverse_complement) == ["Y-nGGTT"]
    assert column(spark, ["A", "T", "AAGT", "ACTT", "GC"], sequence.canonical) == ["A", "A", "AAGT", "AAGT", "GC"]
    assert column(spark, ["ATTTCG", "AT", ""], lambda c: sequence.minimizer(c, 3)) == ["AAA", None, None]
    assert column(spark, ["A\r\nC\nG"], sequence.strip_returns) == ["ACG"]
    with pytest.raises(ValueError):
        sequence.minimizer("x", 0)


def test_byte_strings(spark):
    raw = bytes.fromhex("41FFE9")
    assert column(spark, [bytearray(raw)], lambda c: F.length(sequence.byte_string(c)), "binary") == [3]
    assert column(spark, [bytearray(b"A\xe2\x82B")], lambda c: sequence.public_text(sequence.byte_string(c)), "binary") == ["A�B"]


def test_packed(spark):
    assert column(spark, ["AAA", "TTA", "ACG"], lambda c: bits.encode(c, 3)) == [0, 60, 6]
    assert column(spark, [0, 60, 6], lambda c: bits.decode(c, 3), "bigint") == ["AAA", "TTA", "ACG"]
    assert column(spark, [0, 63], lambda c: bits.bit_reverse_complement(c, 3), "bigint") == [63, 0]
    assert column(spark, [0b00011011], lambda c: bits.bit_reverse_complement(c, 4), "bigint") == [0b00011011]
    both = column(spark, [0b00011011, 63], lambda c: bits.bit_canonical(c, 4), "bigint")
    assert (both[0].code, both[0].was_rc) == (27, False)
    for code, k, m, least in ((0b001011, 3, 2, 2), (0b001011, 3, 1, 0), (0b11000011, 4, 2, 0), (0b110001, 3, 2, 1)):
        assert column(spark, [code], lambda c: bits.bit_minimizer(c, k, m), "bigint") == [least]
    assert column(spark, [63], lambda c: bits.bit_minimizer(c, 3, 2), "bigint") == [3]
    assert column(spark, [63], lambda c: bits.window_minimizer(c, 3, 2), "bigint") == [0]
    k32 = "T" * 32
    assert column(spark, [k32], lambda c: bits.decode(bits.encode(c, 32), 32)) == [k32]
    assert column(spark, [k32], lambda c: bits.bit_reverse_complement(bits.encode(c, 32), 32))[0] == 0


def test_quality(spark):
    want = [2, 27, 14, 27, 14, 33, 33, 37, 37, 37, 33, 37, 27]
    assert column(spark, ["#</</BBFFFBF<", "", None], quality.decode_phred) == [want, [], None]
    assert column(spark, ["B[N[Naaeeeae["], lambda c: quality.decode_phred(c, "phred64")) == [want]
    assert column(spark, ["#< ", "#<"], quality.try_decode_phred) == [None, [2, 27]]
    with pytest.raises(Exception, match="Phred score"):
        column(spark, ["B[?"], lambda c: quality.decode_phred(c, 64))
    with pytest.raises(ValueError):
        quality.decode_phred("x", 10)
    df = spark.createDataFrame([("AGCT", "AAA0"), ("AGCTG", "AAA0"), ("A", "")], "s string, q string")
    assert [r[0] for r in df.select(quality.quality_mask("s", "q", "5")).collect()] == ["AGCN", "AGCN", ""]


def test_headers(spark):
    ids = ["a b  c", "a", " lead", "tail ", "x y", "x\u0085y", "", "a\tb"]
    assert column(spark, ids, records.name) == ["a", "a", "", "tail", "x", "x", "", "a"]
    assert column(spark, ids, records.description) == ["b  c", None, "lead", "", "y", "y", None, "b"]
    assert column(spark, ["a\tb", "ab"], records.mask_header_tabs) == ["a|b", None]
    assert column(spark, ["a\xff", "ab", "Ã©"], records.mask_header_utf8) == ["a�", None, None]


def test_records(spark):
    df = spark.createDataFrame([("te st", "AGCTGA", None), ("id", "ACGT", "IIII"), ("id", "ACGT" * 6, "")], "id string, seq string, qual string")
    assert [r[0] for r in df.select(records.record_text()).collect()][:2] == [">te st\nAGCTGA\n", "@id\nACGT\n+\nIIII\n"]
    assert [r[0] for r in df.select(records.record_repr()).collect()] == ["Record(id=te…, seq=AGCTGA, qual=None)", "Record(id=id, seq=ACGT, qual=IIII)", "Record(id=id, seq=ACGTACGTACGTACGT…CGT, qual=)"]
    assert [tuple(r) for r in df.select(records.is_fasta(), records.is_fastq()).collect()] == [(True, False), (False, True), (False, True)]
    assert records.checked(df.limit(2)).count() == 2
    with pytest.raises(Exception, match="same length"):
        records.checked(df).collect()
    assert [r.n for r in df.select(records.byte_length("seq").alias("n")).collect()] == [6, 4, 24]
    twin = df.alias("a").join(df.alias("b"), records.equal("a", "b"))
    assert twin.count() == 3
    assert df.select(records.record_hash()).distinct().count() == 3


def test_sql_names(spark):
    from strandframe.plans.functions import register

    register(spark)
    df = spark.createDataFrame([("x y  z", "ATTTCG\r\n", "IIII5I"), ("a\tb", "AC", "!"), ("", "", "")], "id string, s string, q string")
    pairs = [
        ("seq_minimizer(s, 3)", sequence.minimizer("s", 3)), ("seq_num_bases(s)", records.num_bases("s")), ("record_name(id)", records.name("id")),
        ("record_description(id)", records.description("id")), ("mask_header_tabs(id)", records.mask_header_tabs("id")),
        ("phred_decode(q, 33)", quality.decode_phred("q")), ("seq_quality_mask(s, q, 60)", quality.quality_mask("s", "q", 60)),
    ]
    for text, column in pairs:
        assert df.where(~F.expr(text).eqNullSafe(column)).count() == 0, text
    with pytest.raises(Exception, match="below the offset 64"):
        df.selectExpr("phred_decode(q, 64)").collect()


def test_deduplicated_by_hash_and_equality(spark, monkeypatch):
    from strandframe.plans.queries import _deduplicated

    rows = [("a x", "ACGT", "IIII"), ("a x", "ACGT", "IIII"), ("a x", "ACGT", None), ("a y", "ACGT", "IIII"), ("a x", "ACGA", "IIII"), ("a x", "ACGT", "IIIH")]
    df = spark.createDataFrame(rows, "id string, seq string, qual string")
    want = {(*r, rows.count(r)) for r in rows}
    assert {tuple(r) for r in _deduplicated(df).collect()} == want
    monkeypatch.setattr(records, "record_hash", lambda: F.lit(1))
    assert {tuple(r) for r in _deduplicated(df).collect()} == want


def test_deduplicated_in_one_shuffle(spark):
    from strandframe.plans.queries import _deduplicated

    df = spark.createDataFrame([("a", "AC", None), ("a", "AC", None), ("a", "AC", "II")], "id string, seq string, qual string")
    found = _deduplicated(df)
    assert {tuple(r) for r in found.collect()} == {("a", "AC", None, 2), ("a", "AC", "II", 1)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


def test_good_bases_end_at_the_last_character(spark):
    df = spark.createDataFrame([("ACGT",), ("acgt",), ("ACG\n",), ("ACG\x85",), ("",), ("ACN",)], "s string")
    assert [r[0] for r in df.select(sequence.is_good("s")).collect()] == [True, True, False, False, False, False]


def test_minimizer_of_any_text(spark):
    df = spark.createDataFrame([("ATTTCG",), ("ééATé",), ("AC",), (None,)], "s string")
    assert [r[0] for r in df.select(sequence.minimizer("s", 3)).collect()] == ["AAA", "ATé", None, None]
