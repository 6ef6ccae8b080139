"""Reads derived from the driver's tables, the same way in Spark and in DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES, SCORES = "0123456789abcdef", "ACGTACGTACGTACGN", "!#%5:?ABCDEFGHIJ"
MESSY = "acgtuUNn.~RyKm -"  #: lower case, ambiguity codes, gaps and white space


def _md5(mark: str) -> Column:
    return F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{mark}")).cast("binary"))


def _sql_md5(mark: str) -> str:
    return f"md5(concat(o_orderkey, '-{mark}'))"


def _dealt(keys: DataFrame) -> DataFrame:
    """Rows of few splits are dealt out to all cores while they are still narrow."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    return keys.repartition(cores) if keys._jdf.queryExecution().toRdd().getNumPartitions() < cores else keys


def count_of(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def reads(spark: SparkSession, sf_dir: str, ordered: bool = False, parts: int | None = None) -> DataFrame:
    """id, name, seq (64 bases), qual, messy (32 characters), o_orderpriority of each order; ``ordered`` by id or dealt to ``parts`` while they are narrow."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    o = o.orderBy("o_orderkey") if ordered else o.repartition(parts) if parts else _dealt(o)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("read"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, " ").otherwise("\t"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))).alias("name"),
        F.translate(F.concat(_md5("a"), _md5("b")), HEX, BASES).alias("seq"),
        F.translate(F.concat(_md5("q"), _md5("r")), HEX, SCORES).alias("qual"),
        F.translate(_md5("m"), HEX, MESSY).alias("messy"),
        F.translate(_md5("s"), HEX, BASES.replace("N", "T")).alias("good"),
    )


READS = f"""
select o_orderkey as id,
  concat('read', o_orderkey, case o_orderkey % 3 when 0 then '' when 1 then concat(' ', o_orderpriority) else concat(chr(9), o_orderpriority) end) as name,
  translate(concat({_sql_md5('a')}, {_sql_md5('b')}), '{HEX}', '{BASES}') as seq,
  translate(concat({_sql_md5('q')}, {_sql_md5('r')}), '{HEX}', '{SCORES}') as qual,
  translate({_sql_md5('m')}, '{HEX}', '{MESSY}') as messy,
  translate({_sql_md5('s')}, '{HEX}', '{BASES.replace("N", "T")}') as good
from orders"""


def workspace(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads again."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_strandframe_files", None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = sc._strandframe_files = tempfile.mkdtemp(prefix="strandframe-files-")
    path = f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
