"""Writing line tables and CSV rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.render import LINE_ORDER
from cadenza.timeline import KEY

# fixed values: formats a run may ask for
FORMATS = ("srt", "json", "txt", "csv")
#: Size of a row group of packed documents.
GROUP_BYTES = 8_000_000


def write_lines(lines: DataFrame, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """One directory per recording; its part files, in name order, make the document.

    Lines are range-partitioned by position, so a long recording is written by many tasks.
    """
    order = [KEY, *LINE_ORDER]
    placed = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).select(KEY, "line").write.mode(mode).partitionBy(KEY).text(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').partitionBy(KEY).csv(path)


def write_packed(rendered: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Line tables of all recordings in common files, as many as the data need, whatever the number of recordings.

    Below ``path`` lies one folder per format.  Rows are dealt into ranges of recording and line
    and sorted, so that each file, and each row group in it, covers a narrow range of recordings: the
    footers are the table of offsets by which ``read_document`` finds a document.
    """
    order = [KEY, *LINE_ORDER]
    for name, lines in rendered.items():
        columns = [*order, "line"]
        lines.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/{name}")


def read_packed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The line table of one format that ``write_packed`` has left."""
    return spark.read.schema(f"{KEY} bigint, section int, item bigint, sub int, line string").parquet(f"{path}/{name}")


def read_document(spark: SparkSession, path: str, name: str, recording: int) -> DataFrame:
    """The lines of one document in order; only row groups that may hold it are read."""
    return read_packed(spark, path, name).where(F.col(KEY) == recording).orderBy(*LINE_ORDER)


def check_formats(formats) -> list[str]:
    unknown = [f for f in formats if f not in FORMATS]
    if unknown:
        raise ValueError(f"unknown formats {unknown}; known are {list(FORMATS)}")
    return list(formats)


def write_outputs(rendered: Mapping[str, DataFrame], path: str, formats=FORMATS) -> dict[str, str]:
    """Write the requested formats; ``rendered`` holds line tables and, under ``csv``, rows."""
    written = {}
    for name in check_formats(formats):
        target = f"{path}/{name}"
        (write_csv if name == "csv" else write_lines)(rendered[name], target)
        written[name] = target
    return written


def document_text(lines: DataFrame) -> DataFrame:
    """Whole documents as single values, for documents known to be small (tests, short recordings)."""
    items = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, "line")))
    return lines.groupBy(KEY).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("document"))
