"""Ordered work on recordings of any length.

A window over ``recording_id`` alone puts a whole recording into one task, and one
recording may hold a large share of the corpus.  Everything ordered here therefore works
on *slices*: consecutive stretches of one recording, numbered by ``position div width``.
Rows shuffle on (recording_id, slice); what must cross a slice border (the last row, a
count, a maximum) is one small summary row per slice, carried over in two levels so that
no task ever sees more than one block of summaries plus one row per block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "recording_id"
SLICE = "slice"
SLICE_MS = 300_000
SLICES_PER_BLOCK = 256


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and go on from there.

    Used for stage tables that feed several branches of a plan: each is computed once,
    survives the loss of executors, and later plans read only the columns and rows they need.
    The folder is the one the session names in spark.checkpoint.dir; only a local session
    without one gets its own.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="cadenza-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def with_slice(df: DataFrame, position: str, width: int) -> DataFrame:
    """Number the slice of each row; monotone in ``position``, so order is preserved."""
    return df.withColumn(SLICE, F.expr(f"`{position}` div {int(width)}L"))


def block_number() -> Column:
    return F.coalesce(F.expr(f"{SLICE} div {SLICES_PER_BLOCK}L"), F.lit(0))


def carry(summaries: DataFrame, value: str, how: str, out: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """(keys, slice, out): what the slices before this one say about ``value``.

    ``how`` is ``last`` (nearest earlier slice), ``next`` (nearest later slice), ``sum`` or
    ``max`` over all earlier slices.  ``summaries`` has one row per (keys, slice).

    Summaries meet in blocks of consecutive slices; only one row per block is ordered over
    the whole recording.
    """
    keys = list(keys)
    empty = F.lit(None).cast(summaries.schema[value].dataType)
    down = how == "next"

    def fold(seen, x):
        if how == "sum":
            return F.coalesce(seen, F.lit(0)) + F.coalesce(x, F.lit(0))
        if how == "max":
            return F.greatest(seen, x)
        return F.coalesce(x, seen)

    parts = F.array_sort(F.collect_list(F.struct(F.col(SLICE), F.col(value).alias("v"))))
    blocks = (
        summaries.select(*keys, SLICE, value)
        .groupBy(*keys, block_number().alias("_block"))
        .agg((F.reverse(parts) if down else parts).alias("_parts"))
    )
    whole = F.aggregate("_parts", empty, lambda seen, p: fold(seen, p["v"]).cast(empty_type(summaries, value)))
    order = F.col("_block").desc() if down else F.col("_block")
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    combine = {"sum": F.sum, "max": F.max}.get(how, lambda c: F.last(c, ignorenulls=True))
    chained = blocks.withColumn("_whole", whole).withColumn("_outer", combine(F.col("_whole")).over(before))
    start = F.struct(F.col("_outer").alias("seen"), F.array().cast(_out_type(summaries, value)).alias("out"))
    folded = F.aggregate(
        "_parts",
        start,
        lambda acc, p: F.struct(
            fold(acc["seen"], p["v"]).cast(empty_type(summaries, value)).alias("seen"),
            F.array_append(acc["out"], F.struct(p[SLICE].alias(SLICE), acc["seen"].alias("v"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    carried = F.coalesce("c.v", F.lit(0)) if how == "sum" else F.col("c.v")
    return chained.select(*keys, F.explode(folded).alias("c")).select(*keys, f"c.{SLICE}", carried.alias(out))


def empty_type(df: DataFrame, value: str):
    return df.schema[value].dataType


def _out_type(df: DataFrame, value: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(SLICE, T.LongType()), T.StructField("v", empty_type(df, value))]))


def known(df: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Rows with a recording.  Said once up front, so that every branch of a plan carries the
    same filter and Spark can share their exchange."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def beside(slices: DataFrame, summaries: DataFrame, keys: Sequence[str] = (KEY,), how: str = "left") -> DataFrame:
    """Join one small row per slice onto the slices, which stay where they are."""
    return slices.join(summaries.hint("shuffle_hash"), [*keys, SLICE], how)


def packed(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (KEY,)) -> DataFrame:
    """(keys, slice, items): the rows of each slice as one sorted array of structs.

    The rows shuffle once; the branch that summarises slices and the branch that uses the
    summaries both read this one exchange.  ``order`` must be unique and no column a map.
    """
    rest = [c for c in df.columns if c not in (*order, *keys, SLICE)]
    item = F.struct(F.struct(*order).alias("_order"), F.struct(*rest).alias("_rest") if rest else F.lit(0).alias("_rest"))

    return known(df, keys).groupBy(*keys, SLICE).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _unpack(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str], item: str = "w") -> list:
    wide = [c for c in columns if c not in (*keys, SLICE)]
    return [
        *keys,
        SLICE,
        *[F.col(f"{item}._order.{c}" if c in order else f"{item}._rest.{c}").alias(c) for c in wide],
    ]


def neighbour(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    out: str,
    keys: Sequence[str] = (KEY,),
    following: bool = False,
) -> DataFrame:
    """Add struct ``out`` with ``columns`` of the previous (or following) row.

    The struct is null at the end of a recording.  ``df`` must carry ``slice``, numbered by
    the first column of ``order``.
    """
    keys = list(keys)
    slices = packed(df, order, keys)

    def pick(w):
        return F.struct(*[(w["_order"][c] if c in order else w["_rest"][c]).alias(c) for c in columns])

    edge = F.element_at("items", 1 if following else -1)
    edges = slices.select(*keys, SLICE, pick(edge).alias("_edge"))
    carried = carry(edges, "_edge", "next" if following else "last", "_carried", keys)
    at = (lambda i: i + 1) if following else (lambda i: i - 1)

    def step(w, i):
        edge_row = (i == F.size("items") - 1) if following else (i == 0)
        inner = pick(F.get("items", at(i)))
        return F.struct(w.alias("w"), F.when(edge_row, F.col("_carried")).otherwise(inner).alias("n"))

    return (
        beside(slices, carried, keys)
        .select(*keys, SLICE, F.explode(F.transform("items", step)).alias("x"))
        .select(*_unpack(df, df.columns, order, keys, "x.w"), F.col("x.n").alias(out))
    )


def running(
    df: DataFrame,
    value: Column,
    order: Sequence[str],
    out: str,
    how: str = "sum",
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Add ``out``: sum or max of ``value`` over the rows strictly before this one."""
    keys = list(keys)
    agg = F.sum if how == "sum" else F.max
    slices = packed(df.withColumn("_value", value), order, keys)
    values = F.transform("items", lambda w: w["_rest"]["_value"])
    if how == "sum":
        total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("bigint"))
    else:
        total = F.array_max(values)
    carried = carry(slices.select(*keys, SLICE, total.alias("_total")), "_total", how, "_carried", keys)
    w = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = agg("_value").over(w)
    merged = (
        F.coalesce(local, F.lit(0)) + F.coalesce("_carried", F.lit(0)) if how == "sum" else F.greatest(local, "_carried")
    )
    return (
        beside(slices, carried, keys)
        .select(*keys, SLICE, "_carried", F.explode("items").alias("w"))
        .select(*_unpack(df, df.columns, order, keys), "w._rest._value", "_carried")
        .withColumn(out, merged)
        .drop("_value", "_carried")
    )


def numbered(df: DataFrame, order: Sequence[str], out: str, keys: Sequence[str] = (KEY,), first: int = 0) -> DataFrame:
    """Dense row numbers per key in ``order``, starting at ``first``."""
    keys = list(keys)
    slices = packed(df, order, keys)
    counts = slices.select(*keys, SLICE, F.size("items").cast("bigint").alias("_n"))
    carried = carry(counts, "_n", "sum", "_offset", keys)
    return (
        beside(slices, carried, keys)
        .select(*keys, SLICE, "_offset", F.posexplode("items").alias("_i", "w"))
        .select(
            *_unpack(df, df.columns, order, keys),
            (F.col("_offset") + F.col("_i") + F.lit(first)).cast("bigint").alias(out),
        )
    )


def facts_per_block(facts: DataFrame, low: str, high: str, width: int, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Repeat one-row-per-key facts once per block of positions ``low..high``.

    Rows then join on (keys, position div width) instead of the bare key, so a recording
    with very many rows is spread over many join keys, while an ordinary recording keeps
    exactly one copy of its facts.
    """
    return facts.withColumn(
        "_at", F.explode(F.expr(f"sequence(`{low}` div {width}L, `{high}` div {width}L)"))
    ).drop(low, high)


def with_facts(
    rows: DataFrame,
    facts: DataFrame,
    position: str,
    low: str,
    high: str,
    width: int,
    keys: Sequence[str] = (KEY,),
    how: str = "inner",
) -> DataFrame:
    """Join per-key ``facts`` (holding the range ``low..high`` of ``position``) onto ``rows``."""
    keys = list(keys)
    return (
        rows.withColumn("_at", F.expr(f"`{position}` div {width}L"))
        .join(facts_per_block(facts, low, high, width, keys), [*keys, "_at"], how)
        .drop("_at")
    )


def relative_slice(value: Column) -> Column:
    """Slice number that grows with the value, in steps of a constant factor away from zero."""
    steps = lambda x: F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.log(x))) * 64)
    zero = F.lit(-3_000).cast("bigint")
    return F.when(value > 0, steps(value)).when(value < 0, 2 * zero - steps(-value)).otherwise(zero)


def exact_percentiles(
    df: DataFrame,
    value: str,
    points: Sequence[float],
    names: Sequence[str],
    width: float | None = None,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, without collecting a key's values.

    Equal values are first folded into counts; counts are then ranked across slices of
    ``width`` value units, or of about 1.6 per cent of the value where no width is given;
    each percentile needs the two values around its rank only.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(SLICE, F.floor(F.col("_v") / F.lit(width)) if width else relative_slice(F.col("_v")))
    )
    ranked = running(counted, F.col("_n"), ["_v"], "_before", "sum", keys)
    totals = counted.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi")
    )
    ranked = with_facts(ranked, totals, SLICE, "_lo", "_hi", SLICES_PER_BLOCK, keys)
    picks = []
    for p, name in zip(points, names):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            hit = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    found = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    result = []
    for p, name in zip(points, names):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + (hi - lo) * (rank - F.floor(rank))).cast("double").alias(name))
    return found.select(*keys, *result)
