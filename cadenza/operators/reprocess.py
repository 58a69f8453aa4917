"""A second pass over the least confident segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.columns import exact_mean, overlap_ms, word_count
from cadenza.operators.hooks import map_chunks
from cadenza.timeline import KEY, SLICE, neighbour, with_slice

THRESHOLD, PADDING_MS = -0.5, 2000
SLOW_SPEED = 0.7
# slowed-down times carry this many steps per ms, so that division by the speed stays whole
SLOW_TENTHS = 7
SEGMENTS_PER_SLICE = 256


def lowest_confidence(segments: DataFrame, threshold: float = THRESHOLD, n: int | None = None) -> DataFrame:
    """All segments below ``threshold`` but short, silent and wordless ones.

    With ``n`` only the ``n`` lowest scores of a recording, ``rank`` by score; that cut comes
    before the filters.  It is taken in every slice first, so that no task ranks a whole recording.
    """
    low = segments.where(F.col("avg_logprob") < threshold)
    if n is None:
        return reprocess_filter(low)
    order = ["avg_logprob", "segment_id"]
    sliced = with_slice(low, "segment_id", max(SEGMENTS_PER_SLICE, n))
    near = sliced.withColumn("rank", F.row_number().over(Window.partitionBy(KEY, SLICE).orderBy(*order))).where(F.col("rank") <= n)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy(KEY).orderBy(*order))).where(F.col("rank") <= n)
    return reprocess_filter(top.drop(SLICE))


def reprocess_filter(candidates: DataFrame) -> DataFrame:
    return candidates.where(
        (F.col("end_ms") - F.col("start_ms") >= 1000) & (F.col("no_speech_prob") <= 0.8) & (word_count("text") >= 2)
    )


def expand_context(segments: DataFrame, padding_ms: int = PADDING_MS) -> DataFrame:
    """Window of each segment widened by the padding and by its neighbours."""
    slim = with_slice(segments.select(KEY, "segment_id", "start_ms", "end_ms"), "segment_id", SEGMENTS_PER_SLICE)
    rows = neighbour(slim, ["start_ms"], ["segment_id"], "_p")
    rows = neighbour(rows, ["end_ms"], ["segment_id"], "_n", following=True)
    start = F.greatest(F.lit(0), F.least(F.col("start_ms") - padding_ms, F.col("_p.start_ms")))
    end = F.greatest(F.col("end_ms") + padding_ms, F.col("_n.end_ms"))
    return rows.select(
        KEY,
        "segment_id",
        "start_ms",
        "end_ms",
        start.alias("expanded_start_ms"),
        end.alias("expanded_end_ms"),
        (F.col("start_ms") - start).alias("overlap_before_ms"),
        (end - F.col("end_ms")).alias("overlap_after_ms"),
    )


def match_target(results: DataFrame, context: DataFrame, min_overlap_ms: int = 500) -> DataFrame:
    """The slow-pass result that covers most of each target, if it covers more than half a second.

    Result times are in slowed-down milliseconds; comparison is exact in sevenths.
    """
    target = context.select(
        KEY,
        "segment_id",
        (F.col("overlap_before_ms") * 10).alias("_ts"),
        ((F.col("overlap_before_ms") + F.col("end_ms") - F.col("start_ms")) * 10).alias("_te"),
    )
    shared = overlap_ms(F.col("result_start_ms") * SLOW_TENTHS, F.col("result_end_ms") * SLOW_TENTHS, "_ts", "_te")
    row = F.struct("result_no", "result_start_ms", "result_end_ms", "text", "avg_logprob", "no_speech_prob")
    return (
        results.join(target, [KEY, "segment_id"])
        .withColumn("_shared", shared)
        .where(F.col("_shared") > min_overlap_ms * SLOW_TENTHS)
        .groupBy(KEY, "segment_id")
        .agg(F.max_by(row, F.struct("_shared", -F.col("result_no"))).alias("r"))
        .select(KEY, "segment_id", "r.*")
    )


def map_back(matched: DataFrame, context: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Slow-pass times back on the recording, each end held within the tolerance of the original."""
    rows = matched.join(context, [KEY, "segment_id"])
    at = lambda c: F.col("expanded_start_ms") + F.floor(F.col(c) * SLOW_TENTHS / F.lit(10.0) + 0.5)
    hold = lambda x, c: F.greatest(F.col(c) - tolerance_ms, F.least(F.col(c) + tolerance_ms, x))
    return rows.select(
        KEY,
        "segment_id",
        hold(at("result_start_ms"), "start_ms").cast("bigint").alias("start_ms"),
        hold(at("result_end_ms"), "end_ms").cast("bigint").alias("end_ms"),
        "text",
        "avg_logprob",
        "no_speech_prob",
    )


def apply_reprocessed(segments: DataFrame, reprocessed: DataFrame, only_if_better: bool = False) -> DataFrame:
    """Segments with their second-pass versions; ``original_confidence`` keeps the old score."""
    new = reprocessed.select(
        KEY, "segment_id", F.struct("start_ms", "end_ms", "text", "avg_logprob", "no_speech_prob").alias("_new")
    )
    rows = segments.join(new, [KEY, "segment_id"], "left")
    if only_if_better:
        rows = rows.withColumn("_new", F.when(F.col("_new.avg_logprob") > F.col("avg_logprob"), F.col("_new")))
    pick = lambda c: F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    return rows.select(
        KEY,
        "segment_id",
        *[pick(c) for c in ("start_ms", "end_ms", "text", "avg_logprob", "no_speech_prob")],
        F.col("_new").isNotNull().alias("reprocessed"),
        F.col("avg_logprob").alias("original_confidence"),
    )


def confidence_delta(original: DataFrame, final: DataFrame) -> DataFrame:
    old = original.select(KEY, "segment_id", F.col("avg_logprob").alias("_old"))
    return final.join(old, [KEY, "segment_id"]).select(
        KEY, "segment_id", "reprocessed", (F.col("avg_logprob") - F.col("_old")).alias("improvement")
    )


def reprocess_report(original: DataFrame, final: DataFrame, threshold: float = THRESHOLD, padding: float = 2.0) -> DataFrame:
    gain = F.when(F.col("reprocessed"), F.col("improvement"))
    return (
        confidence_delta(original, final)
        .groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("total_segments"),
            F.count_if("reprocessed").alias("reprocessed_segments"),
            F.coalesce(exact_mean(gain), F.lit(0.0)).alias("average_confidence_improvement"),
            F.coalesce(F.max(gain), F.lit(0.0)).alias("max_confidence_improvement"),
        )
        .withColumns(
            {
                "reprocessing_rate": F.col("reprocessed_segments") / F.col("total_segments"),
                "confidence_threshold_used": F.lit(threshold),
                "slow_speed_multiplier": F.lit(SLOW_SPEED),
                "context_padding_seconds": F.lit(padding),
            }
        )
    )


RESULT = (
    "recording_id bigint, segment_id bigint, result_no int, result_start_ms bigint, result_end_ms bigint, "
    "text string, avg_logprob double, no_speech_prob double"
)


def reprocess(segments: DataFrame, fn: Callable, threshold: float = THRESHOLD, n: int | None = None) -> DataFrame:
    """The whole second pass: pick, widen, run ``fn`` over the windows, match, map back, replace.

    ``fn`` receives pandas frames of windows and returns rows of ``RESULT`` (slowed-down times).
    A segment whose window failed keeps its first version and says why in ``error``.
    """
    picked = lowest_confidence(segments, threshold, n).select(KEY, "segment_id", "text", "avg_logprob", "no_speech_prob")
    context = expand_context(segments).join(picked.select(KEY, "segment_id"), [KEY, "segment_id"], "left_semi")
    ran = map_chunks(context.join(picked, [KEY, "segment_id"]), fn, RESULT)
    results = ran.where(F.col("error").isNull()).drop("error")
    failed = ran.where(F.col("error").isNotNull()).groupBy(KEY, "segment_id").agg(F.max("error").alias("error"))
    return apply_reprocessed(segments, map_back(match_target(results, context), context)).join(failed, [KEY, "segment_id"], "left")


