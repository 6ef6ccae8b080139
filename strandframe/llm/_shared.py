"""Tables in the shared folder, and readers of the input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset a local
    session gets a temporary folder; a cluster without one is an error, as a
    machine's own folder is not visible to the other machines.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_strandframe_shared", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc._strandframe_shared = tempfile.mkdtemp(prefix="strandframe-")
    return sc._strandframe_shared


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of executors and sees
    one evaluation of ``df`` only.  The folder is removed when the driver ends, or by
    ``discard`` when nothing that is still to run reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_staged", None):
            jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def prepare_python(spark: SparkSession) -> None:
    """Bound Arrow batches in this session, and let Python workers find this package.

    Batches hold at most 8 MB and 2,000 rows: with Spark's own bounds, 64 MB and
    10,000 rows, the Python workers of a task take more memory than the heap leaves.
    Smaller bounds set before stay; these two settings of the session stay lowered,
    as plans are run after their operator returns.  The package's folder is added to the workers'
    path, which serves local sessions and clusters that have it at the same place.
    """
    for key, most in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 2000)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(filter(None, [held.get("PYTHONPATH", ""), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
