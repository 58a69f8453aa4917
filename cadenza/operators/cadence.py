"""Pauses and cadence of buckets; the assembled record per bucket and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import exact_mean, half_up, present, ratio
from cadenza.operators.buckets import BUCKETS_PER_SLICE
from cadenza.timeline import KEY, with_facts

# fixed values: overlap states and cadence classes of a record
UNKNOWN_OVERLAP = "unknown check pyannote"
OVERLAP_STATES = ("overlap", "single", UNKNOWN_OVERLAP)
CADENCES = ("slow", "fast", "normal")


def mean_s(total: Column, n: Column) -> Column:
    return ratio(total / F.lit(1000.0), n)


def variance_s2(total: Column, squares: Column, n: Column) -> Column:
    """Population variance in s² from whole-millisecond sums."""
    mean = total / n
    return F.when(n > 0, F.greatest(F.lit(0.0), squares / n - mean * mean) / F.lit(1e6)).otherwise(F.lit(0.0))


def gap_stats(buckets: DataFrame) -> DataFrame:
    """Population gap statistics of each bucket; fewer than two words give zeros."""
    n, s, q = F.col("gap_count"), F.col("gap_sum"), F.col("gap_squares")
    var = variance_s2(s, q, n)
    return buckets.select(
        KEY,
        "bucket_index",
        n.alias("gap_count"),
        mean_s(s, n).alias("gap_mean"),
        var.alias("gap_var"),
        F.sqrt(var).alias("gap_std"),
        (F.col("gap_min") / 1000.0).alias("min_gap"),
        (F.col("gap_max") / 1000.0).alias("max_gap"),
    )


def cadence_context(buckets: DataFrame, gap_threshold: float = 1.5) -> DataFrame:
    """Per-recording mean and deviation over all in-bucket gaps, and the class thresholds.

    ``_lo``/``_hi`` span the recording's bucket numbers, for spreading the facts.
    """
    n, s, q = F.col("total_gaps"), F.col("_s"), F.col("_q")
    var = variance_s2(s, q, n)
    return (
        buckets.groupBy(KEY)
        .agg(
            F.sum("gap_count").alias("total_gaps"),
            F.sum("gap_sum").alias("_s"),
            F.sum("gap_squares").alias("_q"),
            F.min("bucket_index").alias("_lo"),
            F.max("bucket_index").alias("_hi"),
        )
        .select(
            KEY,
            mean_s(s, n).alias("global_mean"),
            F.sqrt(var).alias("global_std"),
            var.alias("global_variance"),
            "total_gaps",
            F.lit(gap_threshold).alias("gap_threshold"),
            "_lo",
            "_hi",
        )
        .withColumn("slow_threshold", F.col("global_mean") + gap_threshold * F.col("global_std"))
        .withColumn("fast_threshold", F.col("global_mean") - gap_threshold * F.col("global_std"))
    )


def with_context(buckets: DataFrame, context: DataFrame) -> DataFrame:
    """Every bucket with its recording's context."""
    return with_facts(buckets, context, "bucket_index", "_lo", "_hi", BUCKETS_PER_SLICE)


def classify_cadence(count: Column, mean: Column, slow: Column, fast: Column) -> Column:
    return (
        F.when(count == 0, F.lit("normal"))
        .when(mean > slow, F.lit("slow"))
        .when(mean < fast, F.lit("fast"))
        .otherwise(F.lit("normal"))
    )


def assemble_records(buckets: DataFrame, overlap_status: DataFrame | None = None, gap_threshold: float = 1.5) -> DataFrame:
    """One record per bucket: text, gaps, cadence, speaker overlap, confidence."""
    rows = with_context(buckets, cadence_context(buckets, gap_threshold))
    n, s, q = F.col("gap_count"), F.col("gap_sum"), F.col("gap_squares")
    mean = mean_s(s, n)
    records = rows.select(
        KEY,
        "bucket_index",
        "start_ms",
        "end_ms",
        "text",
        "word_count",
        n.alias("word_gap_count"),
        "gaps_ms",
        mean.alias("word_gap_mean"),
        variance_s2(s, q, n).alias("word_gap_var"),
        classify_cadence(n, mean, F.col("slow_threshold"), F.col("fast_threshold")).alias("cadence"),
        F.col("confidence").alias("confidence_score"),
        s.alias("gap_sum"),
        q.alias("gap_squares"),
        F.size("words").alias("listed_words"),
        "words",
    )
    if overlap_status is None:
        return records.withColumn("speaker_overlap", F.lit(UNKNOWN_OVERLAP))
    return records.join(overlap_status, [KEY, "bucket_index"], "left").withColumn(
        "speaker_overlap", F.coalesce("speaker_overlap", F.lit(UNKNOWN_OVERLAP))
    )


def validate_gaps(buckets: DataFrame, context: DataFrame) -> DataFrame:
    """Coverage and cadence distribution per recording."""
    rows = with_context(buckets, context)
    n = F.col("gap_count")
    kind = classify_cadence(n, mean_s(F.col("gap_sum"), n), F.col("slow_threshold"), F.col("fast_threshold"))
    return (
        rows.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("total_buckets"),
            F.sum("word_count").alias("total_words"),
            F.sum(F.greatest(F.lit(0), F.col("word_count") - 1)).alias("total_gaps"),
            F.count_if(F.col("word_count") >= 2).alias("buckets_with_gaps"),
            *[F.count_if(kind == k).alias(f"{k}_buckets") for k in ("slow", "normal", "fast")],
            F.first("global_mean").alias("global_mean"),
            F.first("global_std").alias("global_std"),
            F.first("global_variance").alias("global_variance"),
        )
        .withColumn("quality_score", F.col("buckets_with_gaps") / F.col("total_buckets"))
    )


def record_errors(records: DataFrame) -> DataFrame:
    """One row per failed check of a record."""
    checks = present(
        (F.col("start_ms") >= F.col("end_ms"), "Invalid time range"),
        (F.col("word_count") != F.col("listed_words"), "Word count mismatch"),
        (F.col("word_gap_count") != F.size("gaps_ms"), "Gap count mismatch"),
        (~F.col("cadence").isin(*CADENCES), "Invalid cadence classification"),
        (~F.col("speaker_overlap").isin(*OVERLAP_STATES), "Invalid speaker overlap status"),
    )
    return records.select(KEY, "bucket_index", F.explode(checks).alias("_e")).select(
        KEY, "bucket_index", F.format_string("Record %d: %s", "bucket_index", "_e").alias("error")
    )


def _distribution() -> list[Column]:
    return [
        *[F.count_if(F.col("cadence") == k).alias(f"{k}_count") for k in ("slow", "normal", "fast")],
        F.count_if(F.col("speaker_overlap") == "overlap").alias("overlap_count"),
        F.count_if(F.col("speaker_overlap") == "single").alias("single_count"),
        F.count_if(F.col("speaker_overlap") == UNKNOWN_OVERLAP).alias("unknown_count"),
    ]


def _errors_of_record() -> Column:
    return (
        (F.col("start_ms") >= F.col("end_ms")).cast("int")
        + (F.col("word_count") != F.col("listed_words")).cast("int")
        + (F.col("word_gap_count") != F.size("gaps_ms")).cast("int")
        + (~F.col("cadence").isin(*CADENCES)).cast("int")
        + (~F.col("speaker_overlap").isin(*OVERLAP_STATES)).cast("int")
    )


def validate_records(records: DataFrame) -> DataFrame:
    """Error count and quality metrics per recording; the mean confidence includes zeros."""
    seconds = F.col("_ms") / 1000.0
    return (
        records.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(_errors_of_record()).alias("error_count"),
            F.sum(F.col("end_ms") - F.col("start_ms")).alias("_ms"),
            F.sum("word_count").alias("total_words"),
            F.sum("word_gap_count").alias("total_gaps"),
            exact_mean("confidence_score").alias("average_confidence"),
            *_distribution(),
        )
        .select(
            KEY,
            "record_count",
            (F.col("error_count") == 0).alias("valid"),
            "error_count",
            seconds.alias("total_duration"),
            "total_words",
            "total_gaps",
            "average_confidence",
            "slow_count",
            "normal_count",
            "fast_count",
            "overlap_count",
            "single_count",
            "unknown_count",
            ratio(F.col("total_words"), seconds).alias("words_per_second"),
            (F.col("total_gaps") / F.col("record_count")).alias("gaps_per_record"),
        )
    )


def summarize_records(records: DataFrame) -> DataFrame:
    """Rounded summary per recording; the mean confidence leaves zeros out."""
    n, ms = F.col("record_count"), F.col("_ms")
    pct = {f"{k}_pct": half_up(F.col(f"{k}_count") / n * 100, 1).alias(f"{k}_pct") for k in ("slow", "normal", "fast")}
    return (
        records.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(F.col("end_ms") - F.col("start_ms")).alias("_ms"),
            F.sum("word_count").alias("total_words"),
            F.sum("word_gap_count").alias("total_gaps"),
            exact_mean(F.when(F.col("confidence_score") > 0, F.col("confidence_score"))).alias("_c"),
            *_distribution(),
        )
        .select(
            KEY,
            "record_count",
            half_up(ms / 1000.0, 2).alias("total_duration"),
            "total_words",
            "total_gaps",
            half_up(F.coalesce("_c", F.lit(0.0)), 3).alias("average_confidence"),
            "slow_count",
            "normal_count",
            "fast_count",
            *pct.values(),
            "overlap_count",
            "single_count",
            "unknown_count",
            (F.col("overlap_count") > 0).alias("overlap_detected"),
            (F.col("unknown_count") == 0).alias("detection_available"),
            F.when(ms > 0, half_up(F.col("total_words") / (ms / 1000.0), 2)).otherwise(F.lit(0.0)).alias("words_per_second"),
            half_up(ms / 1000.0 / n, 2).alias("average_bucket_duration"),
            half_up(F.col("total_words") / n, 1).alias("average_words_per_bucket"),
        )
    )


def markdown_statistics(records: DataFrame) -> DataFrame:
    """The figures of the Markdown summary: shares, means and recomputed global gap statistics."""
    n, g = F.col("record_count"), F.col("total_gaps")
    var = variance_s2(F.col("_s"), F.col("_q"), g)
    return (
        records.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.sum(F.col("end_ms") - F.col("start_ms")).alias("_ms"),
            F.sum("word_count").alias("total_words"),
            F.sum("word_gap_count").alias("total_gaps"),
            F.sum("gap_sum").alias("_s"),
            F.sum("gap_squares").alias("_q"),
            exact_mean("confidence_score").alias("average_confidence"),
            F.max("bucket_index").alias("last_bucket"),
            *_distribution(),
        )
        .select(
            KEY,
            "record_count",
            "last_bucket",
            (F.col("_ms") / 1000.0).alias("total_duration"),
            "total_words",
            "total_gaps",
            "slow_count",
            "normal_count",
            "fast_count",
            "overlap_count",
            "single_count",
            "unknown_count",
            "average_confidence",
            (F.col("total_words") / n).alias("words_per_segment"),
            (g / n).alias("gaps_per_segment"),
            mean_s(F.col("_s"), g).alias("global_mean"),
            var.alias("global_variance"),
            F.sqrt(var).alias("global_std"),
        )
    )
