"""Files as they arrive: the same extraction and observation over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions import detect
from veilmark.operators.summary import extension
from veilmark.sources import docx, html, pdf, png, reading  # noqa: F401  the imports register their formats


def observed(files: DataFrame) -> DataFrame:
    """source, status, o (the observation): a narrow plan, for tables and streams alike."""
    own = files.select(F.col("path").alias("source"), extension(F.col("path")).alias("extension"), "length", "content")
    read = reading.extract(own)
    return read.select("source", "status", detect.observe(F.col("segments"), F.col("status")).alias("o"))


def watch(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of observations of new files in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return observed(files)
