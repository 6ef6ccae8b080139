"""The pipeline and the registered queries on small tables."""

import collections
import os

import duckdb
import pytest

import corpus_pipeline
from strandframe.llm import jaccard_join, mixing, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = queries.QUERIES[name](spark, DATA)
    out = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert collections.Counter(map(tuple, got.select(*columns).collect())) == collections.Counter(out.fetchall()) and len(columns) == len(got.columns)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "jaccard_join", "mixing", "bpe"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert one.columns == own and {r.doc_id for r in one.collect()} == kept
    two = corpus_pipeline.not_toxic(spark, one, DATA)
    clean = {r.doc_id for r in toxicity.scored(one, toxicity.train(one, labels)).where("predicted = 0").collect()}
    assert two.columns == own and {r.doc_id for r in two.collect()} == clean
    three = corpus_pipeline.one_of_each_group(spark, two, DATA)
    first = {r.doc_id for r in jaccard_join.near_duplicates(two).where("doc_id = component_id").collect()}
    assert three.columns == own and {r.doc_id for r in three.collect()} == first
    four = corpus_pipeline.source_mix(spark, three, DATA)
    assert four.columns == own and four.count() == mixing.mix(three).count()
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter(r.doc_id for r in rows.collect()) == collections.Counter(r.doc_id for r in four.collect())
