"""Row generators on literal vectors."""

import pytest
from pyspark.sql import functions as F

from strandframe.operators import kmers as K


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("pos").collect()]


def one(spark, seq):
    return spark.createDataFrame([(1, seq)], "id int, seq string")


def test_kmers(spark):
    assert rows(K.kmers(one(spark, "AGCT"), 1), "kmer") == [("A",), ("G",), ("C",), ("T",)]
    assert rows(K.kmers(one(spark, "AGNCT"), 2), "kmer") == [("AG",), ("GN",), ("NC",), ("CT",)]
    assert rows(K.kmers(one(spark, "AC"), 2), "pos", "kmer") == [(0, "AC")]
    assert rows(K.kmers(one(spark, "A"), 2), "kmer") == [] == rows(K.kmers(one(spark, None), 2), "kmer")
    with pytest.raises(ValueError):
        K.kmers(one(spark, "A"), 0)


def test_chunks_agree(spark):
    df = spark.range(3).select(F.col("id"), F.concat(*[F.translate(F.md5((F.col("id") * 100 + i).cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN") for i in range(40)]).alias("seq"))
    whole, cut = K.kmers(df, 31), K.kmers(df, 31, chunk=77)
    assert cut.exceptAll(whole).count() == 0 == whole.exceptAll(cut).count()
    assert "seq" not in cut.columns and "seq" in K.kmers(df, 31, keep_seq=True).columns


def test_canonical(spark):
    assert rows(K.canonical_kmers(one(spark, "AGCT"), 1), "kmer", "was_rc") == [("A", False), ("C", True), ("C", False), ("A", True)]
    assert rows(K.canonical_kmers(one(spark, "AGCTA"), 2), "pos", "kmer") == [(0, "AG"), (1, "GC"), (2, "AG"), (3, "TA")]
    assert rows(K.canonical_kmers(one(spark, "AGNTA"), 2), "pos", "kmer") == [(0, "AG"), (3, "TA")]
    assert rows(K.canonical_kmers(one(spark, "acgt"), 4), "kmer", "was_rc") == [("acgt", True)]  # a palindrome, case kept


def test_bits(spark):
    assert rows(K.bit_kmers(one(spark, "ACGTA"), 3), "code") == [(6,), (27,), (44,)]
    assert rows(K.bit_kmers(one(spark, "TA"), 3), "code") == []
    assert rows(K.bit_kmers(one(spark, "ACNGT"), 2), "pos", "code", "k", "was_rc") == [(0, 1, 2, False), (3, 11, 2, False)]
    assert rows(K.bit_kmers(one(spark, "acgt"), 4, canonical=True), "code", "was_rc") == [(27, False)]  # a palindrome, case folded
    with pytest.raises(ValueError):
        K.bit_kmers(one(spark, "A"), 33)


def test_totals_agree(spark):
    df = spark.range(50).select(F.concat(*[F.translate(F.md5((F.col("id") * 9 + i).cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGN") for i in range(3)]).alias("seq"))
    assert K.kmer_totals(K.canonical_kmers(df, 31)).first() == K.kmer_totals(K.bit_kmers(df, 31, canonical=True)).first()


def test_counts_sum_before_the_shuffle(spark):
    df = K.kmer_counts(K.canonical_kmers(one(spark, "ACGT" * 20), 4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan


def test_line_ends_are_no_bases(spark):
    for odd in ("AACG\nTTGA", "AACG\r\nTTGA", "AACG\x85TTGA", "AACGTT\n", "\nAACG", "ACÅGT日本ACGT"):
        want = [(i, odd[i : i + 4]) for i in range(len(odd) - 3) if set(odd[i : i + 4]) <= set("ACGTacgt")]
        turned = [w[::-1].translate(str.maketrans("ACGT", "TGCA")) for _, w in want]
        assert rows(K.canonical_kmers(one(spark, odd), 4), "pos", "kmer") == [(i, min(w, r)) for (i, w), r in zip(want, turned)]
        assert rows(K.bit_kmers(one(spark, odd), 4), "pos", "code") == [(i, sum("ACGT".index(c) * 4 ** (3 - j) for j, c in enumerate(w))) for i, w in want]
        assert rows(K.kmers(one(spark, odd), 3), "pos", "kmer") == [(i, odd[i : i + 3]) for i in range(len(odd) - 2)]
    for k in (31, 32):
        long = "ACGTTGCAAC" * 4
        codes = [(i, sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(long[i : i + k]))) for i in range(len(long) - k + 1)]
        assert [(p, int(c)) for p, c in rows(K.bit_kmers(one(spark, long), k), "pos", "code")] == codes


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("AGCTA", 1, 2, 3, 4, 5)], "seq string, __s int, __c int, __w int, __0 int, __5 int")
    for found in (K.kmers(df, 2), K.canonical_kmers(df, 2), K.bit_kmers(df, 2, canonical=True)):
        assert found.count() == 4 and found.select("__s", "__c", "__w", "__0", "__5").distinct().collect() == [(1, 2, 3, 4, 5)]


def test_windows_of_a_long_sequence(spark):
    """A sequence of several chunks, in time that grows with its length."""
    n = 3 * K.CHUNK + 17
    df = spark.range(1).select(F.expr(f"substring(repeat('ACGTTGCAAN', {n // 10 + 1}), 1, {n})").alias("seq"))
    assert K.kmers(df, 21).count() == n - 20
    assert K.canonical_kmers(df, 5).agg(F.max("pos"), F.count("*")).first() == K.bit_kmers(df, 5).agg(F.max("pos"), F.count("*")).first()
