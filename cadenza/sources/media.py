"""Listing media files without reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: audio and video file endings
AUDIO = (".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".wma", ".aiff")
VIDEO = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v")


def hidden_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files below ``path`` that Spark's readers pass over: names or folders that begin with a dot or an underscore."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = files.makeQualified(root).toString().rstrip("/")
    found, listed = [], files.listFiles(root, recursive)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().toString()
        if any(part[:1] in ("_", ".") for part in name[len(base) + 1 :].split("/")):
            found.append((name, status.getModificationTime(), status.getLen()))
    rows = spark.createDataFrame(found, "path string, millis bigint, length bigint")
    return rows.select("path", F.timestamp_millis("millis").alias("modificationTime"), "length")


def scan_media(
    spark: SparkSession,
    path: str,
    recursive: bool = True,
    extensions: Sequence[str] | None = None,
    pattern: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Path, size and time of media files, by path, hidden ones included.  ``pattern`` is ``*``, ``*.mp3``, ``.mp3`` or ``mp3``."""
    wanted = [e.lower() for e in (extensions or (*AUDIO, *VIDEO))]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "modificationTime", "length")
        .unionByName(hidden_files(spark, path, recursive))
        .dropDuplicates(["path"])
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
        .withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    )
    if pattern and pattern not in ("*", "*.*"):
        only = "." + pattern.lower().lstrip("*.")
        wanted = [e for e in wanted if e == only] if extensions else [only]
    listed = files.where(F.col("extension").isin(*wanted)).orderBy("path")
    return listed.limit(max_files) if max_files else listed
