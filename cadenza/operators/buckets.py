"""Cutting words into buckets of about four seconds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import folds
from cadenza.operators.words import clean_slices, gap_ms, ordered_slices
from cadenza.timeline import KEY, SLICE, SLICE_MS, beside, carry, numbered, running, with_slice

BUCKET_MS = 4000
TOLERANCE_MS = 250
BUCKETS_PER_SLICE = 4096

_CUT = "struct<number:array<bigint>,began:array<bigint>,first:array<boolean>>"
_CUT_FIELDS = (("number", pa.int64()), ("began", pa.int64()), ("first", pa.bool_()))


def _closing_maps(span: int):
    def make(ends, first_start):
        pieces = folds.closing_map(folds.numbers(ends), span)
        return pieces, folds.look_up(pieces, first_start.as_py())

    return folds.mapped(make)


def _closing_cuts(span: int):
    def cut(ends, state, closed, fresh):
        e = folds.numbers(ends)
        return folds.closing_walk(e, state.as_py(), closed.as_py(), fresh.as_py(), span), 3 * len(e)

    return folds.by_row(cut, lambda rows: folds.columns_of(rows, _CUT_FIELDS), _CUT)


def _splitting_maps(near: int, far: int):
    def make(starts, ends):
        s, e = folds.numbers(starts), folds.numbers(ends)
        *_, state, splits = folds.splitting_walk(s, e, int(s[0]), 0, True, near, far)
        return folds.splitting_map(s, e, near, far), (state, splits, False)

    return folds.mapped(make)


def _splitting_cuts(near: int, far: int):
    def cut(starts, ends, state, splits, cold):
        s, e = folds.numbers(starts), folds.numbers(ends)
        return folds.splitting_walk(s, e, state.as_py(), splits.as_py(), cold.as_py(), near, far)[:3], 3 * len(e)

    return folds.by_row(cut, lambda rows: folds.columns_of(rows, _CUT_FIELDS), _CUT)


def _explode_cut(entered: DataFrame) -> DataFrame:
    # columns of flat rows are compiled; a function on array elements would be interpreted for every word
    rows = entered.select(KEY, SLICE, "cut", F.posexplode("words").alias("_i", "w"))
    gap = F.when(~F.get("cut.first", F.col("_i")), gap_ms(F.col("w.start_ms"), F.col("w.prev_end_ms")))
    return rows.select(
        KEY,
        SLICE,
        "w.*",
        F.get("cut.number", F.col("_i")).alias("bucket_index"),
        F.get("cut.began", F.col("_i")).alias("bucket_start_ms"),
        gap.alias("gap_ms"),
    )


def bucket_slices(slices: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    ends = F.transform("words", lambda w: w["end_ms"])
    start = F.element_at("words", 1)["start_ms"]
    maps = slices.select(KEY, SLICE, _closing_maps(bucket_ms)(ends, start).alias("m")).select(KEY, SLICE, "m.map", "m.cold")
    entered = beside(slices, folds.slice_entries(maps), how="inner")
    cut = _closing_cuts(bucket_ms)(
        ends,
        F.coalesce("entry.state", start),
        F.coalesce("entry.closes", F.lit(0)),
        F.coalesce("entry.fresh", F.lit(True)),
    )
    return _explode_cut(entered.withColumn("cut", cut))


def legacy_slices(slices: DataFrame, bucket_ms: int = BUCKET_MS, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    near, far = bucket_ms - tolerance_ms, bucket_ms + tolerance_ms
    starts = F.transform("words", lambda w: w["start_ms"])
    ends = F.transform("words", lambda w: w["end_ms"])
    maps = slices.select(KEY, SLICE, _splitting_maps(near, far)(starts, ends).alias("m")).select(
        KEY, SLICE, "m.map", "m.cold"
    )
    entered = beside(slices, folds.slice_entries(maps), how="inner")
    cut = _splitting_cuts(near, far)(
        starts,
        ends,
        F.coalesce("entry.state", F.get(starts, F.lit(0))),
        F.coalesce("entry.closes", F.lit(0)),
        F.col("entry").isNull(),
    )
    return _explode_cut(entered.withColumn("cut", cut))


def bucketize(words: DataFrame, bucket_seconds: float = 4.0, slice_ms: int = SLICE_MS) -> DataFrame:
    """Words with ``bucket_index``, ``bucket_start_ms`` and ``gap_ms`` (null on a bucket's first word).

    A word is added first; the bucket closes once the word's end lies ``bucket_seconds`` or
    more after the bucket's start, and the next bucket starts at that end.
    """
    return bucket_slices(ordered_slices(words, slice_ms), round(bucket_seconds * 1000))


def bucketize_legacy(
    words: DataFrame, bucket_seconds: float = 4.0, tolerance: float = 0.25, slice_ms: int = SLICE_MS
) -> DataFrame:
    """As ``bucketize`` with the older rule: split before a word that ends within the tolerance.

    A bucket that jumps past the tolerance never splits again and takes the rest of the
    recording, so nothing here or downstream gathers the words of one bucket.
    """
    return legacy_slices(ordered_slices(words, slice_ms), round(bucket_seconds * 1000), round(tolerance * 1000))


def bucketize_raw(words: DataFrame, timing_repair: bool = True, bucket_seconds: float = 4.0, slice_ms: int = SLICE_MS):
    """Clean and bucketize in one pass over the words.

    The words shuffle once; the branches that work out the carries and the maps read the same
    exchange, and everything else that moves is one small row per slice.
    """
    return bucket_slices(clean_slices(words, timing_repair, slice_ms), round(bucket_seconds * 1000))


def bucketize_legacy_raw(words: DataFrame, timing_repair: bool = True, slice_ms: int = SLICE_MS) -> DataFrame:
    return legacy_slices(clean_slices(words, timing_repair, slice_ms))


def bucket_table(bucketed: DataFrame) -> DataFrame:
    """One row per bucket with ordered words, text and gap sums in whole milliseconds."""
    item = F.struct("sort_ms", "segment_id", "pos", "word", "start_ms", "end_ms", "probability", "gap_ms")
    ordered = F.array_sort("items")
    gaps = F.filter(F.transform("items", lambda w: w["gap_ms"]), lambda g: g.isNotNull())
    return (
        bucketed.groupBy(KEY, "bucket_index")
        .agg(
            F.min("bucket_start_ms").alias("start_ms"),
            F.count(F.lit(1)).alias("word_count"),
            F.count("gap_ms").alias("gap_count"),
            F.coalesce(F.sum("gap_ms"), F.lit(0)).alias("gap_sum"),
            F.coalesce(F.sum(F.col("gap_ms") * F.col("gap_ms")), F.lit(0)).alias("gap_squares"),
            F.coalesce(F.min("gap_ms"), F.lit(0)).alias("gap_min"),
            F.coalesce(F.max("gap_ms"), F.lit(0)).alias("gap_max"),
            F.sum(F.when(F.col("probability") > 0, F.col("probability")).cast("decimal(18,8)")).alias("_p"),
            F.count(F.when(F.col("probability") > 0, 1)).alias("_pn"),
            F.collect_list(item).alias("items"),
        )
        .withColumn("items", ordered)
        .select(
            KEY,
            "bucket_index",
            "start_ms",
            F.element_at("items", -1)["end_ms"].alias("end_ms"),
            "word_count",
            F.array_join(F.transform("items", lambda w: w["word"]), " ").alias("text"),
            "gap_count",
            gaps.alias("gaps_ms"),
            "gap_sum",
            "gap_squares",
            "gap_min",
            "gap_max",
            F.when(F.col("_pn") > 0, F.col("_p").cast("double") / F.col("_pn")).otherwise(F.lit(0.0)).alias("confidence"),
            F.col("items").alias("words"),
        )
    )


def merge_short(buckets: DataFrame, min_duration: float = 2.0) -> DataFrame:
    """Join each short bucket with its successor, greedily in pairs.

    Within a run of short buckets the even ones start a merge, so a bucket is swallowed by
    its predecessor exactly when an odd number of short buckets stands right before it.
    A merged bucket is not looked at again, and the last bucket never starts a merge.
    """
    short = (F.col("end_ms") - F.col("start_ms")) < F.lit(round(min_duration * 1000))
    long_at = F.when(~short, F.col("bucket_index"))
    rows = running(
        with_slice(buckets, "bucket_index", BUCKETS_PER_SLICE), long_at, ["bucket_index"], "_long_before", "max"
    )
    shorts_before = F.col("bucket_index") - 1 - F.coalesce("_long_before", F.lit(-1))
    target = F.col("bucket_index") - F.when(shorts_before % 2 == 1, F.lit(1)).otherwise(F.lit(0))
    merged = (
        rows.groupBy(KEY, target.alias("first_bucket"))
        .agg(
            F.min_by("start_ms", "bucket_index").alias("start_ms"),
            F.max_by("end_ms", "bucket_index").alias("end_ms"),
            F.sum("word_count").alias("word_count"),
            F.array_sort(F.collect_list(F.struct("bucket_index", "text"))).alias("_t"),
            F.count(F.lit(1)).alias("merged_from"),
        )
        .withColumn("text", F.array_join(F.transform("_t", lambda x: x["text"]), " "))
        .drop("_t")
    )
    return numbered(with_slice(merged, "first_bucket", BUCKETS_PER_SLICE), ["first_bucket"], "bucket_index").drop(SLICE)


def validate_buckets(buckets: DataFrame, target: float = 4.0, tolerance: float = 0.25) -> DataFrame:
    """Per recording: count of bad durations (the last bucket is exempt) and duration statistics."""
    length = F.col("end_ms") - F.col("start_ms")
    lo, hi = round((target - tolerance) * 1000), round((target + tolerance) * 1000)
    bad = ((length < lo) | (length > hi)).cast("int")
    return (
        buckets.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("bucket_count"),
            (F.sum(bad) - F.max_by(bad, F.col("bucket_index"))).alias("duration_violations"),
            F.sum(length).alias("_total"),
            F.sum("word_count").alias("_words"),
            F.min(length).alias("_min"),
            F.max(length).alias("_max"),
        )
        .select(
            KEY,
            "bucket_count",
            (F.col("duration_violations") == 0).alias("valid"),
            "duration_violations",
            (F.col("_total") / 1000.0).alias("total_duration"),
            (F.col("_total") / F.col("bucket_count") / 1000.0).alias("average_duration"),
            (F.col("_words") / F.col("bucket_count")).alias("average_word_count"),
            (F.col("_min") / 1000.0).alias("min_duration"),
            (F.col("_max") / 1000.0).alias("max_duration"),
        )
    )


def bucket_violations(buckets: DataFrame, target: float = 4.0, tolerance: float = 0.25) -> DataFrame:
    """The offending buckets themselves, one row each."""
    lo, hi = round((target - tolerance) * 1000), round((target + tolerance) * 1000)
    length = F.col("end_ms") - F.col("start_ms")
    rows = with_slice(buckets, "bucket_index", BUCKETS_PER_SLICE)
    heads = rows.groupBy(KEY, SLICE).agg(F.max("bucket_index").alias("_top"))
    later = carry(heads, "_top", "next", "_later")
    return (
        rows.join(heads, [KEY, SLICE])
        .join(later, [KEY, SLICE], "left")
        .where((F.col("bucket_index") < F.col("_top")) | F.col("_later").isNotNull())
        .where((length < lo) | (length > hi))
        .select(
            KEY,
            "bucket_index",
            (length / 1000.0).alias("duration"),
            F.lit(lo / 1000.0).alias("expected_min"),
            F.lit(hi / 1000.0).alias("expected_max"),
        )
    )
