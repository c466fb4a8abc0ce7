"""Catalogues of containers that arrive one by one, and running totals of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pomona.sources import reader

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Files of a folder as they come, (path, content, arrived): each file once, at most `per_batch` in a step."""
    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    if per_batch is not None:
        source = source.option("maxFilesPerTrigger", per_batch)
    return source.load(path).select("path", "content", F.col("modificationTime").alias("arrived"))


def stream_entries(files: DataFrame, payload: bool = False, **options) -> DataFrame:
    """The entries of streamed containers, like reader.entries; every container's are there as soon as it is read."""
    return reader.entries(files.select("path", "content"), payload=payload, **options)


def stream_volumes(files: DataFrame, **options) -> DataFrame:
    return reader.volumes(files.select("path", "content"), **options)


def arrivals(files: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, files, bytes of containers by the time they were changed; a window is final once it is `late` behind.

    Files that come later still are dropped, as their windows are closed.
    """
    f = files.select("arrived", F.octet_length("content").cast("long").alias("n")).withWatermark("arrived", late)
    w = F.window("arrived", width, slide) if slide else F.window("arrived", width)
    return f.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes")).select(F.col("w.start").alias("start"), "files", "bytes")


def first_of_each(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files without copies of those that came before; what is known of a file is forgotten once it is `late` behind."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["digest"])
