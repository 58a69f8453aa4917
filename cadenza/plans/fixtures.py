"""Transcript tables derived from the driver's tables (rules in FIXTURES.md, section 3).

Each derivation scales like the operators: running sums over a conversation cross slices of
turns, never a whole conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.columns import tokens
from cadenza.operators.chunks import FRAMES_PER_SLICE, row_range
from cadenza.operators.intervals import interval_pairs
from cadenza.timeline import KEY, SLICE, numbered, running, with_slice

TURNS_PER_SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias(KEY), F.col("turn").alias("segment_id"), "role", "text"
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw word list, with the overlaps, pauses and broken times the rules put in."""
    spoken = F.expr(
        "transform(tokens, (t, i) -> struct(t as word, i as pos, "
        "(recording_id * 7919 + segment_id * 104729 + i * 12917) % 9973 as h, "
        "120 + 35 * least(length(t), 12) as dur))"
    )
    stepped = F.expr(
        "transform(spoken, w -> struct(w.word as word, w.pos as pos, w.h as h, w.dur as dur, cast(w.dur + case when w.h % 37 = 0 then -60 "
        "when w.h % 41 = 0 then 2500 else w.h % 400 end as bigint) as step))"
    )
    total = F.expr("aggregate(spoken, 0L, (a, w) -> a + w.step)")
    ends = F.expr("aggregate(spoken, cast(array() as array<bigint>), (a, w) -> "
                  "array_append(a, coalesce(try_element_at(a, -1), 0L) + w.step))")
    turns = (
        conversations(spark, sf_dir)
        .select(KEY, "segment_id", tokens("text").alias("tokens"))
        .select(KEY, "segment_id", spoken.alias("spoken"))
        .select(KEY, "segment_id", stepped.alias("spoken"))
    )
    placed = running(with_slice(turns, "segment_id", TURNS_PER_SLICE), total, ["segment_id"], "_before")
    end = F.col("_before") + F.get("ends", F.col("w.pos"))
    return (
        placed.select(KEY, "segment_id", "_before", "spoken", ends.alias("ends"))
        .select(KEY, "segment_id", "_before", "ends", F.explode("spoken").alias("w"))
        .select(KEY, "segment_id", "w.*", end.alias("e"))
        .select(
            KEY,
            "segment_id",
            "pos",
            "word",
            F.when(F.col("h") % 211 == 0, F.lit(-1)).otherwise(F.col("e") - F.col("dur")).cast("bigint").alias("start_ms"),
            F.when(F.col("h") % 53 == 0, F.col("e") - F.col("dur")).otherwise(F.col("e")).cast("bigint").alias("end_ms"),
            ((F.col("h") % 101) / 100.0).alias("probability"),
            F.lit(False).alias("timing_repaired"),
        )
    )


def segments_from(spark: SparkSession, sf_dir: str, clean: DataFrame) -> DataFrame:
    """One row per turn: spans from its cleaned words, scores from the key columns."""
    spans = clean.groupBy(KEY, "segment_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )
    logprob = F.expr("-((recording_id * 31 + segment_id * 17) % 250) / 100.0").cast("double")
    silence = F.expr("((recording_id * 13 + segment_id * 29) % 100) / 100.0").cast("double")
    return (
        conversations(spark, sf_dir)
        .join(spans, [KEY, "segment_id"])
        .select(
            KEY,
            "segment_id",
            "start_ms",
            "end_ms",
            "text",
            logprob.alias("avg_logprob"),
            silence.alias("no_speech_prob"),
            "role",
        )
    )


def diarization_from(seg: DataFrame) -> DataFrame:
    """Speaker turns: each segment widened, plus an occasional moderator."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    own = seg.select(
        KEY,
        F.col("role").alias("speaker"),
        F.greatest(F.lit(0), F.col("start_ms") - 300).alias("start_ms"),
        (F.col("end_ms") + 400).alias("end_ms"),
    )
    extra = seg.where((F.col(KEY) + F.col("segment_id")) % 5 == 0).select(
        KEY, F.lit("moderator").alias("speaker"), mid.alias("start_ms"), (mid + 800).alias("end_ms")
    )
    both = with_slice(own.unionByName(extra), "start_ms", 300_000)
    return numbered(both, ["start_ms", "end_ms", "speaker"], "turn_no").select(
        KEY, "turn_no", "speaker", "start_ms", "end_ms"
    )


def durations_from(clean: DataFrame) -> DataFrame:
    return clean.groupBy(KEY).agg(F.max("end_ms").alias("duration_ms"))


def nested_segments(seg: DataFrame, w: DataFrame) -> DataFrame:
    """Segments with their raw words nested."""
    item = F.struct(
        "pos",
        F.col("word"),
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("end_ms") / 1000.0).alias("end"),
        "probability",
    )
    lists = w.groupBy(KEY, "segment_id").agg(F.array_sort(F.collect_list(item)).alias("_w"))
    return seg.join(lists, [KEY, "segment_id"]).select(
        KEY,
        "segment_id",
        (F.col("start_ms") / 1000.0).alias("start"),
        (F.col("end_ms") / 1000.0).alias("end"),
        "text",
        "avg_logprob",
        "no_speech_prob",
        F.lit("en").alias("language"),
        F.lit(0.0).alias("temperature"),
        F.transform("_w", lambda x: x.dropFields("pos")).alias("words"),
    )




def frame_slices(clean: DataFrame, durations: DataFrame, hop_ms: int = 100) -> DataFrame:
    """One frame per hop, in slices: energy and centroid of the loudest word that covers it, else 0.

    Words move as spans of frames, once; frames are made where their slice lies.
    """
    of = lambda x, n: F.coalesce(x % n + 1, F.lit(0))
    spoken = clean.where("end_ms > start_ms").select(
        KEY,
        F.expr(f"start_ms div {hop_ms}L").alias("a"),
        F.expr(f"(end_ms - 1) div {hop_ms}L").alias("b"),
        F.expr("(recording_id * 7919 + segment_id * 104729 + pos * 12917) % 9973").alias("h"),
    )
    low = F.col(SLICE) * FRAMES_PER_SLICE
    parts = spoken.withColumn(SLICE, F.explode(F.expr(f"sequence(a div {FRAMES_PER_SLICE}L, b div {FRAMES_PER_SLICE}L)"))).select(
        KEY, SLICE, F.greatest("a", low).alias("a"), F.least("b", low + FRAMES_PER_SLICE - 1).alias("b"), "h"
    )
    hops = durations.select(KEY, F.ceil(F.col("duration_ms") / hop_ms).cast("bigint").alias("_hops"))
    silent = row_range(hops, F.expr(f"(_hops + {FRAMES_PER_SLICE - 1}) div {FRAMES_PER_SLICE}L"), SLICE).select(
        KEY, SLICE, low.alias("a"), (F.least("_hops", low + FRAMES_PER_SLICE) - 1).alias("b"), F.lit(None).cast("bigint").alias("h")
    )
    spans = parts.unionByName(silent).groupBy(KEY, SLICE).agg(F.collect_list(F.struct("a", "b", "h")).alias("spans"))
    # idx * 16 + value of every frame of every span; the largest of a frame is the last in order
    of_all = lambda n: F.sort_array(F.flatten(F.transform("spans", lambda s: F.transform(F.sequence(s["a"], s["b"]), lambda i: i * 16 + of(s["h"], n)))))
    ordered = spans.select(KEY, SLICE, of_all(9).alias("e"), of_all(11).alias("c"))
    largest = lambda name: F.filter(name, lambda x, i: ~F.coalesce(F.shiftright(F.get(name, i + 1), 4) == F.shiftright(x, 4), F.lit(False)))
    frame = lambda e, c: F.struct(
        F.shiftright(e, 4).alias("idx"), (e % 16).cast("double").alias("energy"), (c % 16).cast("double").alias("centroid")
    )
    return ordered.select(KEY, SLICE, largest("e").alias("e"), largest("c").alias("c")).select(KEY, SLICE, F.zip_with("e", "c", frame).alias("frames"))


def frames(clean: DataFrame, durations: DataFrame, hop_ms: int = 100) -> DataFrame:
    """One row per hop."""
    # the plain explode would put the making of the frames into a filter, too
    return frame_slices(clean, durations, hop_ms).select(KEY, F.explode_outer("frames").alias("f")).select(KEY, "f.*")


def chunk_results(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments heard in each padded chunk, times relative to the chunk's start."""
    a = chunks.select(
        KEY,
        "chunk_id",
        F.round(F.col("start_time") * 1000).cast("bigint").alias("_a"),
        F.round(F.col("end_time") * 1000).cast("bigint").alias("_b"),
    )
    b = segments.withColumns({"_s": F.col("start_ms"), "_e": F.col("start_ms") + 1})
    return interval_pairs(a, b, ("_a", "_b"), ("_s", "_e")).where("start_ms >= _a").select(
        KEY,
        "chunk_id",
        "segment_id",
        (F.col("start_ms") - F.col("_a")).alias("start_ms"),
        (F.col("end_ms") - F.col("_a")).alias("end_ms"),
        "text",
        "avg_logprob",
        "no_speech_prob",
    )


def chunk_runs(chunks: DataFrame) -> DataFrame:
    """Per-chunk results of a pretended transcription run."""
    c = F.col("chunk_id")
    return chunks.select(
        KEY,
        "chunk_id",
        F.when((F.col(KEY) + c) % 3 == 0, F.lit("en")).otherwise(F.lit("de")).alias("language"),
        ((F.lit(80) + c % 20) / 100.0).alias("language_probability"),
        "duration",
        (F.lit(1.0) + (c % 4) * 0.25).alias("processing_time"),
        (-((F.col(KEY) + c) % 200) / 100.0).alias("avg_confidence"),
    )


def slow_results(windows: DataFrame) -> DataFrame:
    """What a slow pass returns for each window: the target, 0.2 s late, and the rest before it."""
    lead, span = F.col("overlap_before_ms"), F.col("end_ms") - F.col("start_ms")
    slow = lambda ms: F.floor(ms * 10 / F.lit(7.0) + 0.5).cast("bigint")
    hit = F.struct(
        F.lit(1).alias("result_no"),
        slow(lead + 200).alias("result_start_ms"),
        slow(lead + span + 200).alias("result_end_ms"),
        F.col("text"),
        (F.col("avg_logprob") + 0.15).alias("avg_logprob"),
        F.col("no_speech_prob"),
    )
    before = F.struct(
        F.lit(0).alias("result_no"),
        F.lit(0).cast("bigint").alias("result_start_ms"),
        slow(lead).alias("result_end_ms"),
        F.lit("before").alias("text"),
        F.lit(-0.1).alias("avg_logprob"),
        F.lit(0.0).alias("no_speech_prob"),
    )
    return windows.select(KEY, "segment_id", F.explode(F.array(before, hit)).alias("r")).select(KEY, "segment_id", "r.*")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcription jobs."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("queued")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (k % 3600).cast("int").alias("processing_time_seconds"),
        (k * 1000).alias("file_size_bytes"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("duration_seconds"),
    )


def processing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed per order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").cast("string").alias("job_id")).agg(
        F.count(F.lit(1)).cast("int").alias("chunks_processed"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("original_duration_seconds"),
        F.sum(F.floor(F.col("l_quantity") / 2).cast("bigint")).alias("processed_duration_seconds"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("cost_estimate_usd"),
        F.max(F.col("l_discount").cast("decimal(18,2)")).alias("speed_multiplier_applied"),
    )


def job_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as timing buckets of their order's job."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"),
        F.col("l_linenumber").cast("string").alias("bucket_id"),
        F.col("l_discount").cast("decimal(18,2)").alias("confidence"),
        (F.col("l_returnflag") == "R").alias("cadence_anomaly"),
    )


def job_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("job_id"),
        ((k % 1000) / 1000.0).alias("gap_mean"),
        F.concat(F.lit("pace "), (k % 5).cast("string")).alias("cadence_summary"),
    )
