"""Word tables: flattening segments, repairing timings, gaps.

Cleaning and bucketing use one physical layout: per (recording, slice) an array of that
slice's words in order.  The words are shuffled once into it; every later per-word step is
local to the row, and only slice summaries move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import strip, to_ms
from cadenza.timeline import KEY, SLICE, SLICE_MS, beside, carry, known

REPAIR_MS = 20
OVERLAP_STEP_MS = 1

WORD_COLUMNS = ["recording_id", "segment_id", "pos", "word", "start_ms", "end_ms", "probability", "timing_repaired"]


def flatten_words(segments: DataFrame) -> DataFrame:
    """One row per word of each segment.

    A segment without words becomes one word: its whole text, with avg_logprob as the
    probability.  Empty words are dropped.
    """
    whole = F.array(
        F.struct(
            F.col("text").alias("word"),
            F.col("start").alias("start"),
            F.col("end").alias("end"),
            F.col("avg_logprob").alias("probability"),
        )
    )
    fallback = F.coalesce(F.size("words"), F.lit(0)) <= 0
    return (
        segments.select(
            KEY,
            "segment_id",
            fallback.alias("_fallback"),
            F.posexplode(F.when(fallback, whole).otherwise(F.col("words"))).alias("pos", "w"),
        )
        .select(
            KEY,
            "segment_id",
            "pos",
            strip(F.coalesce("w.word", F.lit(""))).alias("word"),
            F.coalesce(to_ms("w.start"), F.lit(0)).cast("bigint").alias("start_ms"),
            F.coalesce(to_ms("w.end"), F.lit(0)).cast("bigint").alias("end_ms"),
            F.coalesce("w.probability", F.lit(0.0)).alias("probability"),
            F.lit(False).alias("timing_repaired"),
            "_fallback",
        )
        .where(F.col("_fallback") | (F.col("word") != ""))
        .drop("_fallback")
    )


def word_slices(words: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """(recording_id, slice, words): the words of each slice in time order."""
    sort = F.col("sort_ms") if "sort_ms" in words.columns else F.col("start_ms")
    item = F.struct(
        sort.alias("sort_ms"),
        F.col("segment_id"),
        F.col("pos"),
        F.col("start_ms"),
        F.col("end_ms"),
        F.col("word"),
        F.col("probability"),
        F.col("timing_repaired"),
    )
    return (
        known(words)
        .withColumn(SLICE, F.floor(sort / F.lit(slice_ms)).cast("bigint"))
        .groupBy(KEY, SLICE)
        .agg(F.array_sort(F.collect_list(item)).alias("words"))
    )


def repaired(words: DataFrame, timing_repair: bool = True) -> DataFrame:
    """Row-local part of cleaning: drop negative times, repair or drop empty spans."""
    kept = words.where((F.col("start_ms") >= 0) & (F.col("end_ms") >= 0))
    bad = F.col("end_ms") <= F.col("start_ms")
    if not timing_repair:
        return kept.where(~bad).withColumn("timing_repaired", F.lit(False))
    return kept.withColumn("timing_repaired", bad).withColumn(
        "end_ms", F.when(bad, F.col("start_ms") + REPAIR_MS).otherwise(F.col("end_ms"))
    )


def _with_previous_end(slices: DataFrame) -> DataFrame:
    tails = slices.select(KEY, SLICE, F.element_at("words", -1)["end_ms"].alias("_tail"))
    joined = beside(slices, carry(tails, "_tail", "last", "_carried"))

    def step(w: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("_carried")).otherwise(F.get("words", i - 1)["end_ms"])
        return w.withField("prev_end_ms", before)

    return joined.select(KEY, SLICE, F.transform("words", step).alias("words"))


def clean_slices(words: DataFrame, timing_repair: bool = True, slice_ms: int = SLICE_MS) -> DataFrame:
    """Cleaned words in slice layout.

    Ends never change after the repair, so the sequential overlap fix is a plain look at
    the previous word's end.
    """
    slices = _with_previous_end(word_slices(repaired(words, timing_repair), slice_ms))

    def fix(w: Column) -> Column:
        overlapped = w["start_ms"] < w["prev_end_ms"]
        return w.withField(
            "start_ms", F.when(overlapped, w["prev_end_ms"] + OVERLAP_STEP_MS).otherwise(w["start_ms"])
        )

    return slices.select(KEY, SLICE, F.transform("words", fix).alias("words"))


def ordered_slices(words: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """Slice layout of words that need no cleaning."""
    return _with_previous_end(word_slices(words, slice_ms))


def explode_slices(slices: DataFrame, *extra: str) -> DataFrame:
    return slices.select(KEY, SLICE, *extra, F.explode("words").alias("w")).select(KEY, SLICE, *extra, "w.*")


def clean_words(words: DataFrame, timing_repair: bool = True, slice_ms: int = SLICE_MS) -> DataFrame:
    """Validated words: starts after the previous end, positive spans, repairs flagged.

    ``sort_ms`` keeps the order (the start before the overlap fix); ``prev_end_ms`` is the
    end of the word before.
    """
    return explode_slices(clean_slices(words, timing_repair, slice_ms))


def gap_ms(start: Column, prev_end: Column) -> Column:
    return F.greatest(F.lit(0), start - prev_end)


def word_gaps(clean: DataFrame) -> DataFrame:
    """Pause before each word; the first word of a recording has none."""
    return clean.select(
        KEY,
        "sort_ms",
        "segment_id",
        "pos",
        "word",
        F.when(F.col("prev_end_ms").isNotNull(), gap_ms(F.col("start_ms"), F.col("prev_end_ms"))).alias("gap_ms"),
    )


def join_words(words: DataFrame, *group: str) -> DataFrame:
    """Text of each group of words, in time order.  Groups must be bounded (a bucket, a segment)."""
    item = F.struct("sort_ms", "segment_id", "pos", "word")
    return words.groupBy(KEY, *group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda w: w["word"]), " ").alias("text")
    )
