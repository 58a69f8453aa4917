"""Confidence, text problems and quality of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import col, exact_mean, present, strip, word_count
from cadenza.timeline import KEY, exact_percentiles, neighbour, with_slice

SEGMENTS_PER_SLICE = 256

# fixed values: filler strings
FILLERS = ("uh", "um", "er", "ah", "like", "you know")

# a word character is a letter, a number or an underscore, in any script
_W = r"[\p{L}\p{N}_]"
# possessive runs and cheap first tests keep long texts free of backtracking
REPETITION = rf"(?<!{_W})({_W}++)[\s\p{{Z}}\x1c-\x1f\x85]+\1(?!{_W})"
SHORT_WORD = rf"(?<!{_W}){_W}{{1,2}}+(?!{_W})"
CUT_OFF = rf"(?=[a-z])(?<!{_W})[a-z]++-(?={_W})"
PUNCTUATION_RUN = r"([.?!])\1++"
CONSONANT_RUN = rf"(?=[bcdfghjklmnpqrstvwxyz]{{4}})(?<!{_W})[bcdfghjklmnpqrstvwxyz]++(?!{_W})"


def uncertainty_level(logprob: Column | str) -> Column:
    x = col(logprob)
    return F.when(x >= -0.5, F.lit("low")).when(x >= -1.5, F.lit("medium")).otherwise(F.lit("high"))


def estimated_accuracy(mean_logprob: Column | str) -> Column:
    x = col(mean_logprob)
    return F.when(x >= -0.5, 0.95).when(x >= -1.0, 0.90).when(x >= -1.5, 0.80).otherwise(0.70)


def quality_level(confidence: Column | str) -> Column:
    x = col(confidence)
    return (
        F.when(x >= 0.95, F.lit("excellent"))
        .when(x >= 0.85, F.lit("good"))
        .when(x >= 0.70, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def speech_priority(share: Column | str) -> Column:
    x = col(share)
    return F.when(x > 0.7, F.lit("high")).when(x >= 0.3, F.lit("medium")).otherwise(F.lit("low"))


def text_indicators(df: DataFrame, text: str = "text", whole_words: bool = False) -> DataFrame:
    """Add struct ``indicators`` and array ``text_issues`` for one text column."""
    t = strip(text)
    lower = F.lower(t)
    count = word_count(t)
    if whole_words:
        fillers = sum(lower.rlike(rf"(?<!{_W}){f}(?!{_W})").cast("int") for f in FILLERS)
    else:
        fillers = sum(F.contains(lower, F.lit(f)).cast("int") for f in FILLERS)
    hits = lambda s, pattern: F.regexp_count(s, F.lit(pattern))
    # each pattern runs once: plain columns first, which Spark keeps in a projection of their own
    rows = df.withColumns(
        {
            "_words": count,
            "_fillers": fillers,
            "_incomplete": hits(t, SHORT_WORD)
            + F.when(F.contains(t, F.lit("-")), hits(t, CUT_OFF)).otherwise(F.lit(0)),
            "_punctuation": hits(t, PUNCTUATION_RUN),
            "_consonants": hits(lower, CONSONANT_RUN),
            "_repeats": F.regexp_like(lower, F.lit(REPETITION)),
            "_empty": F.coalesce(F.length(t), F.lit(0)) == 0,
        }
    )
    ratio = F.when(F.col("_words") > 0, F.col("_fillers") / F.col("_words")).otherwise(F.lit(0.0))
    issues = present(
        (F.col("_repeats"), "repetitive_text"),
        (ratio > 0.2, "excessive_fillers"),
        (F.col("_incomplete") > 2, "incomplete_words"),
        (F.col("_punctuation") > 0, "unusual_punctuation"),
        (F.col("_words") < 2, "very_short_segment"),
        (F.col("_words") > 50, "very_long_segment"),
        (F.col("_consonants") > 0, "incoherent_text"),
    )
    return rows.select(
        *df.columns,
        F.struct(
            ratio.alias("filler_ratio"),
            F.col("_incomplete").alias("incomplete_words"),
            F.col("_punctuation").alias("unusual_punctuation"),
            F.col("_words").alias("word_count"),
            F.col("_consonants").alias("incoherent_matches"),
        ).alias("indicators"),
        F.when(F.col("_empty"), F.array(F.lit("empty_text"))).otherwise(issues).alias("text_issues"),
    )


def rate_issues(start_ms: str, end_ms: str, words: Column) -> Column:
    """Speaking-rate problems of a segment, compared in whole numbers."""
    ms = F.col(end_ms) - F.col(start_ms)
    return present(
        ((ms > 0) & (words * 1000 > ms * 6), "speech_too_fast"),
        ((ms > 0) & (words * 1000 * 2 < ms) & (words > 1), "speech_too_slow"),
        ((ms < 1000) & (words > 10), "duration_text_mismatch"),
    )


def segment_uncertainty(
    segments: DataFrame, threshold: float = -1.0, linguistic: bool = True, statistical: bool = True
) -> DataFrame:
    """Level, ordered reasons and review flag of every segment."""
    rows = text_indicators(segments)
    model = present(
        (F.col("avg_logprob") < threshold, "low_model_confidence"),
        (F.col("no_speech_prob") > 0.5, "high_no_speech_probability"),
    )
    none = F.array().cast("array<string>")
    reasons = F.concat(
        model,
        F.col("text_issues") if linguistic else none,
        rate_issues("start_ms", "end_ms", word_count("text")) if statistical else none,
    )
    level = uncertainty_level("avg_logprob")
    rows = rows.withColumns({"uncertainty_level": level, "uncertainty_reasons": reasons})
    review = (
        (F.col("uncertainty_level") == "high")
        | (F.size("uncertainty_reasons") >= 2)
        | F.array_contains("uncertainty_reasons", "low_model_confidence")
    )
    return rows.select(
        KEY,
        "segment_id",
        "start_ms",
        "end_ms",
        strip("text").alias("text"),
        F.col("avg_logprob").alias("confidence_score"),
        "uncertainty_level",
        "uncertainty_reasons",
        review.alias("suggested_review"),
        *([F.col("indicators").alias("quality_indicators")] if linguistic else []),
    )


def flag_uncertain(analysis: DataFrame, custom_threshold: float = -1.0) -> DataFrame:
    return analysis.where(
        (F.col("confidence_score") < custom_threshold)
        | (F.col("uncertainty_level") == "high")
        | (F.size("uncertainty_reasons") >= 2)
    )


def confidence_stats(segments: DataFrame, score: str = "avg_logprob") -> DataFrame:
    """Distribution of scores per recording (population deviation); scores above 0 fall in no bin."""
    x = F.col(score)
    base = segments.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("segment_count"),
        exact_mean(x).alias("mean_confidence"),
        F.stddev_pop(x).alias("std_confidence"),
        F.min(x).alias("min_confidence"),
        F.max(x).alias("max_confidence"),
        F.count_if(x < -2.0).alias("very_low_bin"),
        F.count_if((x >= -2.0) & (x < -1.0)).alias("low_bin"),
        F.count_if((x >= -1.0) & (x < -0.5)).alias("medium_bin"),
        F.count_if((x >= -0.5) & (x <= 0.0)).alias("high_bin"),
        F.count_if(x < -1.5).alias("low_confidence_count"),
        F.count_if((x >= -1.5) & (x < -0.5)).alias("medium_confidence_count"),
        F.count_if(x >= -0.5).alias("high_confidence_count"),
    )
    median = exact_percentiles(segments.select(KEY, score), score, [0.5], ["median_confidence"], 0.01)
    return base.join(median, KEY, "left")


def confidence_threshold(segments: DataFrame, percentile: float = 10.0, score: str = "avg_logprob") -> DataFrame:
    """Per recording, the score below which ``percentile`` per cent of its segments lie."""
    return exact_percentiles(segments.select(KEY, score), score, [percentile / 100.0], ["threshold"], 0.01)


def temporal_consistency(segments: DataFrame) -> DataFrame:
    """1 minus the share of segment borders with a gap over 5 s or an overlap."""
    rows = neighbour(
        with_slice(segments.select(KEY, "segment_id", "start_ms", "end_ms"), "segment_id", SEGMENTS_PER_SLICE),
        ["start_ms"],
        ["segment_id"],
        "_next",
        following=True,
    )
    jump = F.col("_next.start_ms") - F.col("end_ms")
    issue = F.coalesce(((jump > 5000) | (jump < 0)).cast("int"), F.lit(0))
    n = F.col("_n")
    return (
        rows.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(issue).alias("_issues"))
        .select(
            KEY,
            F.when(n < 2, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_issues") / (n - 1)))
            .alias("temporal_consistency"),
        )
    )


def consistency_score(std_samp: Column, n: Column) -> Column:
    return F.when(n < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - std_samp / 2.0))


def quality_metrics(analysis: DataFrame) -> DataFrame:
    """Weighted quality score of each recording from its segment analysis."""
    n = F.col("total_segments")
    problem = (F.col("uncertainty_level") != "low") | F.col("suggested_review")
    base = analysis.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.count_if("suggested_review").alias("flagged_segments"),
        F.count_if(problem).alias("_problems"),
        F.count_if(F.col("confidence_score") < -1.5).alias("_low"),
        exact_mean("confidence_score").alias("average_segment_confidence"),
        F.stddev_samp("confidence_score").alias("_std"),
        F.count_if(F.array_contains("uncertainty_reasons", "mixed_languages")).alias("_mixed"),
    )
    rows = base.join(temporal_consistency(analysis), KEY).withColumns(
        {
            "transcription_reliability": 1.0 - F.col("_low") / n,
            "estimated_accuracy": estimated_accuracy("average_segment_confidence"),
            "problematic_segments_ratio": F.col("_problems") / n,
            "consistency_score": consistency_score(F.col("_std"), n),
            "language_consistency": 1.0 - F.col("_mixed") / n,
            "flagged_percentage": F.col("flagged_segments") / n * 100,
        }
    )
    overall = (
        F.col("transcription_reliability") * 0.3
        + F.col("estimated_accuracy") * 0.3
        + (1.0 - F.col("problematic_segments_ratio")) * 0.2
        + F.col("consistency_score") * 0.1
        + F.col("language_consistency") * 0.05
        + F.col("temporal_consistency") * 0.05
    )
    return rows.withColumn("overall_quality_score", overall).drop("_low", "_problems", "_std", "_mixed")


def issue_counts(analysis: DataFrame) -> DataFrame:
    return (
        analysis.select(KEY, F.explode("uncertainty_reasons").alias("reason"))
        .groupBy(KEY, "reason")
        .agg(F.count(F.lit(1)).alias("segments"))
    )


# fixed values: advice texts, in the order they are given
ADVICE_QUALITY = "Consider using a higher quality audio source or different model settings"
ADVICE_PROBLEMS = "High number of problematic segments detected - manual review recommended"
ADVICE_MODEL = "Consider using a larger model or different compute settings for better confidence"
ADVICE_NOISE = "Audio may contain significant silence or noise - consider preprocessing"
ADVICE_REPETITION = "Repetitive text detected - may indicate model hallucination"
ADVICE_FILLERS = "Excessive filler words detected - consider post-processing cleanup"
ADVICE_CONSISTENCY = "Low consistency detected - check for audio quality variations"
ADVICE_TEMPORAL = "Temporal inconsistencies detected - check audio segmentation"
ADVICE_GOOD = "Good quality transcription with minor areas for improvement"
ADVICE_HIGH = "High quality transcription - minimal issues detected"


def recommendations(analysis: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Ordered advice per recording."""
    has = lambda r: F.count_if(F.array_contains("uncertainty_reasons", r))
    counts = analysis.groupBy(KEY).agg(
        has("low_model_confidence").alias("_model"),
        has("high_no_speech_probability").alias("_noise"),
        has("repetitive_text").alias("_repeat"),
        has("excessive_fillers").alias("_fill"),
    )
    m = quality_metrics(analysis) if metrics is None else metrics
    n, q = F.col("total_segments"), F.col("overall_quality_score")
    advice = present(
        (q < 0.7, ADVICE_QUALITY),
        (F.col("problematic_segments_ratio") > 0.3, ADVICE_PROBLEMS),
        (F.col("_model") > n * 0.2, ADVICE_MODEL),
        (F.col("_noise") > n * 0.1, ADVICE_NOISE),
        (F.col("_repeat") > 0, ADVICE_REPETITION),
        (F.col("_fill") > 0, ADVICE_FILLERS),
        (F.col("consistency_score") < 0.8, ADVICE_CONSISTENCY),
        (F.col("temporal_consistency") < 0.9, ADVICE_TEMPORAL),
    )
    fallback = F.array(F.when(q < 0.9, F.lit(ADVICE_GOOD)).otherwise(F.lit(ADVICE_HIGH)))
    return m.join(counts, KEY).select(
        KEY, F.when(F.size(advice) == 0, fallback).otherwise(advice).alias("recommendations")
    )


def analyze_uncertainty(segments: DataFrame, threshold: float = -1.0) -> DataFrame:
    """One row per recording: quality metrics, confidence statistics, flagged share and advice."""
    analysis = segment_uncertainty(segments, threshold)
    metrics = quality_metrics(analysis)
    stats = confidence_stats(segments).drop("segment_count")
    return metrics.join(stats, KEY).join(recommendations(analysis, metrics), KEY)


def quality_report(segments: DataFrame) -> DataFrame:
    """Corpus form of the quality analysis command."""
    m = quality_metrics(segment_uncertainty(segments))
    return m.select(KEY, "overall_quality_score", "flagged_segments", "total_segments", "flagged_percentage")
