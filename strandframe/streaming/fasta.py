"""FASTA and FASTQ as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.sources import _cut, fastx

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_fastx(spark: SparkSession, directory: str, max_files: int | None = None, mode: str = "PERMISSIVE", compression: str = "auto", keep_raw: bool = False) -> DataFrame:
    """Records of the FASTA and FASTQ files that arrive in a folder, as ``read_fastx`` gives them.

    A task reads each file to its end or first error, so no state is kept: all
    column functions and k-mer generators apply to the stream as they are.
    """
    fastx._find_package(spark)
    reader = spark.readStream.format("binaryFile").schema(_FILE)
    files = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(directory).select("path")
    return fastx._records(files.mapInArrow(_cut.tasks(fastx._whole_file(compression)), _cut.PARTS), fastx._mode(mode), keep_raw=keep_raw)


def stream_fasta(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """Records (path, id, raw_seq, seq) of the FASTA files that arrive in a folder, without those that are wrong."""
    found = stream_fastx(spark, directory, max_files, "DROPMALFORMED").where("format = 'fasta'")
    return found.select("path", "id", "raw_seq", "seq")
