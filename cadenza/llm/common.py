"""What the operators of this package share: tables, stage tables, Arrow columns, label splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cadenza.timeline import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and go on from there.

    For a table that several later plans read: it is computed once, outlives executors, and is
    read back with pruning and with its size known, so that Spark broadcasts it only if small.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``table`` (on disk, a few numbers a row), marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def with_columns(
    df: DataFrame,
    make: Callable[..., Sequence],
    read: Sequence[str],
    out: str,
    keep: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Columns made from Arrow batches: ``make(*columns)`` returns one sequence for each of ``out``.

    ``keep`` names the columns that stay (all by default).  A kept column whose name clashes
    with one of ``out`` (upper and lower case alike) gives way to it.  A column that is kept and
    read travels once.  Batches are worked through in slices of at most ``SLICE_ROWS`` rows and
    about ``limit`` bytes (``SLICE_BYTES`` by default), so that long texts do not meet in one list.
    """
    fields = T.StructType.fromDDL(out)
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    more = [c for c in dict.fromkeys(read) if c not in kept]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__read{i}") for i, c in enumerate(more)])
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])
    types = [to_arrow_schema(T.StructType([f])).field(0).type for f in fields]
    at = [[*kept, *more].index(c) for c in read]
    many = len(kept)

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit or SLICE_BYTES):
                made = make(*(part.column(i) for i in at))
                arrays = [*part.columns[:many], *(pa.array(m, t) for m, t in zip(made, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


#: Bounds of what a task works on at once.
SLICE_ROWS = 2_000
SLICE_BYTES = 16_000_000


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch``; a part above ``limit`` bytes is halved down to single rows."""
    todo = [batch.slice(low, rows) for low in range(0, batch.num_rows, rows)] or [batch]
    todo.reverse()
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > limit:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def texts(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; a null key gives -1, which no rule names."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % by, F.lit(-1))


def label_sample(labels: DataFrame, label: str, train: Column, limit: int) -> DataFrame:
    """(doc_id, label): at most ``limit`` labelled rows, chosen by a hash of doc_id.

    Rows without id or label are left out; of repeated labels of a document the largest counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
