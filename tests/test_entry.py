"""Every core query against its SQL on the smallest tables, if they are there."""

import os

import duckdb
import pytest

from strandframe.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    con = tables.execute(ORACLE_SQL[name])
    want = as_rows([c[0] for c in con.description], con.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in con.description)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sql_names_over_whole_reads(spark):
    import inspect

    from strandframe.plans.functions import FUNCTIONS

    query = QUERIES["sql_functions"]
    assert [f for f in FUNCTIONS if f"{f}(" not in inspect.getsource(query) + inspect.getsource(QUERIES["sql_bit_functions"])] == []
    rows = query(spark, DATA).select("kmers", "masked").collect()
    assert len(rows) == 1500 and all(r.kmers.count(":") == 61 and len(r.masked) == 64 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_packed_kmers_and_masks_of_whole_reads(spark):
    for name, windows in (("bit_revcomp", 24), ("bit_to_bytes", 2), ("bit_minimizer", 26)):
        assert {r["count"] for r in QUERIES[name](spark, DATA).groupBy("id").count().collect()} == {windows}
    assert {(len(r.seq), len(r.short_seq), len(r.short_qual)) for r in QUERIES["quality_mask"](spark, DATA).collect()} == {(64, 50, 40)}


def test_sql_names_join_nothing_to_their_rows(spark):
    """Spark used to broadcast every k-mer, keyed by sequence, to join it to its row again."""
    from strandframe.plans.functions import register

    register(spark)
    spark.createDataFrame([(1, "ACGTNacgt0AC"), (2, "AC"), (3, ""), (4, None), (5, "ACGTNacgt0AC")], "id long, seq string").createOrReplaceTempView("few_reads")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = {}
    for f in ("seq_kmers", "seq_canonical_kmers", "seq_bit_kmers"):
        df = spark.sql(f"select id, k.* from few_reads, lateral {f}(seq, 4) as k")
        assert "Join" not in plan(df), f
        found[f] = [tuple(r)[1:] for r in df.where("id = 5").orderBy("pos").collect()]
        assert {r.id: r["count"] for r in df.groupBy("id").count().collect()} == {1: len(found[f]), 5: len(found[f])}
    assert found["seq_kmers"] == [(p, "ACGTNacgt0AC"[p : p + 4]) for p in range(9)]
    assert found["seq_canonical_kmers"] == [(0, "ACGT", True), (5, "acgt", True)]
    assert found["seq_bit_kmers"] == [(0, 27, False), (5, 27, False)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_sql_functions_broadcast_no_reads(spark):
    assert "Broadcast" not in QUERIES["sql_functions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["codec_gz_truncated", "codec_bz2_truncated", "codec_xz_truncated"])
def test_truncated_files_are_of_bounded_size(spark, monkeypatch, name):
    from strandframe.plans import queries

    packed, read = [], queries.source.read_fastx
    monkeypatch.setattr(queries, "READS_A_FILE", 200, raising=False)
    monkeypatch.setattr(queries.source, "read_fastx", lambda s, path, **how: packed.append(path) or read(s, path, **how))
    rows = QUERIES[name](spark, DATA).collect()
    assert len(os.listdir(packed[0])) >= 8  # 1500 reads, 200 a file
    assert sum(r.kind == "Io" for r in rows) == 3 and len({r.id for r in rows if r.kind is None}) == 1500 and len(rows) == 1503
