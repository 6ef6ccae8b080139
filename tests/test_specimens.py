"""Files of the specimen folder against the outcomes that FIXTURES.md lists; they are read as data only."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandframe.functions import records, sequence
from strandframe.operators import kmers as K
from strandframe.sources import fastx as source

TEXT = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
ROOT = Path(re.search(r"paths under `([^`]+)`", TEXT)[1])
pytestmark = pytest.mark.skipif(not ROOT.is_dir(), reason="no specimen files")


def table(title):
    part = TEXT[TEXT.index(title) :].split("\n## ")[0]
    return [[c.strip(" `") for c in line.strip("|").split("|")] for line in part.splitlines() if line.startswith("| `")]


@pytest.mark.parametrize("split", [None, 257])
def test_outcomes(spark, split):
    rows = table("## 4. Files")
    found = source.read_fastx(spark, [str(ROOT / r[0]) for r in rows], split=split)
    good = F.col("error").isNull()
    made = found.groupBy("path").agg(
        F.first("format", ignorenulls=True).alias("format"), F.count_if(good).alias("n"), F.coalesce(F.sum(F.when(good, records.num_bases("seq"))), F.lit(0)).alias("bases"),
        F.max("error.kind").alias("kind"), F.max("error.line").alias("line"),
    )
    got = {r.path.removeprefix(f"file:{ROOT}/"): r for r in made.collect()}
    assert len(rows) > 90
    for name, fmt, n, bases, _, outcome in rows:
        r = got[name]
        assert (r.n, r.bases) == (int(n), int(bases)), name
        assert (f"{r.kind} @ line {r.line}" if r.kind else "ok") == outcome, name
        assert fmt in ("-", r.format), name


def test_kmers_of_files(spark):
    rows = table("## 5. K-mer")
    found = source.read_fastx(spark, [str(ROOT / r[0]) for r in rows]).select("path", "seq").cache()
    four = K.canonical_kmers(found.select("path", sequence.normalize("seq").alias("seq")), 4).groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("kmer") == "AAAA").alias("a"))
    long = K.canonical_kmers(found.select("path", sequence.normalize("seq", True).alias("seq")), 31).groupBy("path").agg(F.count("*").alias("n"), F.count_if(~F.col("was_rc")).alias("f"))
    packed = K.bit_kmers(found, 31, canonical=True).groupBy("path").agg(F.count("*").alias("n"), F.count_if(~F.col("was_rc")).alias("f"))
    of = lambda df: {r[0].removeprefix(f"file:{ROOT}/"): tuple(r)[1:] for r in df.collect()}
    a, b, c = of(four), of(long), of(packed)
    for name, _, n4, aaaa, n31, forward in rows:
        assert a.get(name, (0, 0)) == (int(n4), int(aaaa)), name
        assert b.get(name, (0, 0)) == (int(n31), int(forward)), name
        assert c.get(name, (0, 0))[0] <= int(n31), name
