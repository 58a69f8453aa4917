"""Warehouse tables, their views, and corpus-level reports."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import schemas
from cadenza.functions.columns import exact_sum, ratio
from cadenza.timeline import KEY, settle

# fixed values: severity words of the code and of the tables
SEVERITY = {"normal": "low", "mild": "medium", "moderate": "high", "severe": "critical"}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A warehouse table with its declared schema and generated columns."""
    return with_generated(spark.read.schema(schemas.WAREHOUSE[name]).parquet(f"{path}/{name}"), name)


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    declared = df.sparkSession.createDataFrame([], schemas.WAREHOUSE[name]).schema
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared]).write.mode(mode).parquet(f"{path}/{name}")


def with_generated(df: DataFrame, name: str) -> DataFrame:
    if name in ("timing_buckets", "word_timestamps"):
        return df.withColumn("duration", F.col("end_timestamp") - F.col("start_timestamp"))
    if name == "processing_metrics":
        saved = F.col("original_duration_seconds") - F.col("processed_duration_seconds")
        return df.withColumn("time_saved_seconds", saved.cast("int"))
    return df


def to_warehouse_buckets(flagged: DataFrame, texts: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """Flagged timing buckets as rows of ``timing_buckets`` with the tables' severity words."""
    pairs = [F.lit(x) for kv in SEVERITY.items() for x in kv]
    severity = F.create_map(*pairs)[F.col("cadence_severity")]
    rows = flagged.join(texts.select(KEY, "bucket_index", "text"), [KEY, "bucket_index"])
    if overlap is not None:
        rows = rows.join(overlap, [KEY, "bucket_index"], "left")
        spoken_over = F.coalesce(F.col("speaker_overlap") == "overlap", F.lit(False))
    else:
        spoken_over = F.lit(False)
    return rows.select(
        F.col(KEY).cast("string").alias("job_id"),
        F.format_string("bucket_%05d", "bucket_index").alias("bucket_id"),
        (F.col("start_ms") / 1000.0).cast("decimal(10,3)").alias("start_timestamp"),
        (F.col("end_ms") / 1000.0).cast("decimal(10,3)").alias("end_timestamp"),
        "text",
        F.col("word_count").cast("int").alias("word_count"),
        F.col("word_gap_count").cast("int").alias("word_gap_count"),
        F.col("word_gap_mean").cast("decimal(8,6)").alias("word_gap_mean"),
        F.col("word_gap_var").cast("decimal(10,8)").alias("word_gap_variance"),
        F.col("words_per_second").cast("decimal(6,3)").alias("words_per_second"),
        F.col("total_speech_time").cast("decimal(8,3)").alias("total_speech_time"),
        F.col("total_silence_time").cast("decimal(8,3)").alias("total_silence_time"),
        F.col("confidence").cast("decimal(4,3)").alias("confidence"),
        spoken_over.alias("speaker_overlap"),
        "cadence_anomaly",
        severity.alias("cadence_severity"),
    )


# ---------------------------------------------------------------- builders of the other tables


def bucket_name(job: str, bucket: Column) -> Column:
    """What ``word_timestamps`` calls a bucket: buckets are numbered within their job."""
    return F.concat(F.col(job).cast("string"), F.lit("/"), F.format_string("bucket_%05d", bucket))


def to_transcription_jobs(recordings: DataFrame) -> DataFrame:
    """Recordings (key, duration_ms and any columns of the table) as rows of ``transcription_jobs`` with the declared defaults."""
    given = set(recordings.columns)

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in given else default

    # fixed values: the defaults that the table declares
    values = {
        "job_id": column("job_id", F.col(KEY).cast("string")),
        "input_path": column("input_path", F.concat(F.lit("recording_"), F.col(KEY).cast("string"))),
        "status": column("status", F.lit("queued")),
        "model_size": column("model_size", F.lit("large-v3")),
        "language": column("language", F.lit("auto")),
        "speed_multiplier": column("speed_multiplier", F.lit(1.75)),
        "enhanced_analysis": column("enhanced_analysis", F.lit(False)),
        "speaker_diarization": column("speaker_diarization", F.lit(False)),
        "created_at": column("created_at", F.current_timestamp()),
        "duration_seconds": column("duration_seconds", F.col("duration_ms") / 1000.0 if "duration_ms" in given else F.lit(None)),
    }
    return _declared(recordings.select(*[values.get(n, F.col(n) if n in given else F.lit(None)).alias(n) for n in _names("transcription_jobs")]), "transcription_jobs")


def to_word_timestamps(cut: DataFrame) -> DataFrame:
    """Words with their bucket as rows of ``word_timestamps``, numbered from 0 in each bucket."""
    order = Window.partitionBy(KEY, "bucket_index").orderBy("sort_ms", "segment_id", "pos")  # a bucket spans a few seconds
    rows = cut.select(
        bucket_name(KEY, F.col("bucket_index")).alias("bucket_id"),
        (F.row_number().over(order) - 1).alias("word_index"),
        "word",
        (F.col("start_ms") / 1000.0).alias("start_timestamp"),
        (F.col("end_ms") / 1000.0).alias("end_timestamp"),
        "probability",
    )
    return _declared(rows, "word_timestamps")


def to_cadence_analysis(analysis: DataFrame) -> DataFrame:
    """Global cadence with its count of anomalous buckets as rows of ``cadence_analysis``."""
    rows = analysis.select(
        F.col(KEY).cast("string").alias("job_id"),
        F.coalesce("global_gap_mean", F.lit(0.0)).alias("gap_mean"),
        F.coalesce("global_gap_std", F.lit(0.0)).alias("gap_std"),
        "total_words",
        "total_gaps",
        "anomaly_threshold",
        "anomalous_buckets",
        *[F.col(f"p{p}").alias(f"gap_p{p}") for p in (50, 75, 90, 95, 99)],
        "cadence_summary",
    )
    return _declared(rows, "cadence_analysis")


def to_speaker_analysis(summary: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """Speaker and overlap counts (and a confidence per recording) as rows of ``speaker_analysis``."""
    rows = summary if confidence is None else summary.join(confidence.select(KEY, "confidence_score"), KEY, "left")
    score = F.lit(None) if confidence is None else F.col("confidence_score")
    job = F.col(KEY).cast("string").alias("job_id")
    return _declared(rows.select(job, "speaker_count", F.col("total_overlaps").alias("overlaps_detected"), score.alias("confidence_score")), "speaker_analysis")


def to_processing_metrics(runs: DataFrame, durations: DataFrame) -> DataFrame:
    """Chunk runs (chunk_id, duration, processing_time[, status, workers]) as rows of ``processing_metrics``."""
    failed = F.count_if(F.col("status") == "failed") if "status" in runs.columns else F.lit(0)
    totals = runs.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("chunks_processed"), failed.alias("chunks_failed"), exact_sum("processing_time").alias("seconds"), exact_sum("duration").alias("processed")
    )
    rows = totals.join(durations, KEY).select(
        F.col(KEY).cast("string").alias("job_id"),
        "chunks_processed",
        "chunks_failed",
        F.floor("seconds").alias("transcription_time_seconds"),
        F.floor("seconds").alias("total_processing_time_seconds"),
        (F.col("duration_ms") / 1000.0).alias("original_duration_seconds"),
        F.col("processed").alias("processed_duration_seconds"),
    )
    given = set(rows.columns)
    return _declared(rows.select(*[F.col(n) if n in given else F.lit(None).alias(n) for n in _names("processing_metrics")]), "processing_metrics")


def _names(name: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schemas.WAREHOUSE[name])]


def _declared(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table with their declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schemas.WAREHOUSE[name])])


# ---------------------------------------------------------------- declared rules

# fixed values: keys, required columns, ranges, words and references that the tables declare
KEYS = {
    "transcription_jobs": ["job_id"],
    "timing_buckets": ["job_id", "bucket_id"],
    "word_timestamps": ["bucket_id", "word_index"],
    "cadence_analysis": ["job_id"],
    "speaker_analysis": ["job_id"],
    "processing_metrics": ["job_id"],
}
REQUIRED = {
    "transcription_jobs": ["input_path", "status"],
    "timing_buckets": ["start_timestamp", "end_timestamp", "text", "word_count"],
    "word_timestamps": ["word", "start_timestamp", "end_timestamp"],
    "cadence_analysis": ["gap_mean", "gap_std", "total_words", "total_gaps", "anomaly_threshold", "anomalous_buckets"],
    "speaker_analysis": ["speaker_count", "overlaps_detected"],
    "processing_metrics": [],
}
SHARES = {"timing_buckets": ["confidence"], "word_timestamps": ["probability"]}
WORDS = {"timing_buckets": {"cadence_severity": list(SEVERITY.values())}}
REFERENCES = {
    "timing_buckets": "transcription_jobs",
    "word_timestamps": "timing_buckets",
    "cadence_analysis": "transcription_jobs",
    "speaker_analysis": "transcription_jobs",
    "processing_metrics": "transcription_jobs",
}


def check_table(rows: DataFrame, name: str, parents: DataFrame | None = None) -> DataFrame:
    """(key columns, failed_check) of the rows of a table that break what it declares.

    Required columns and keys, ranges and words are checked row by row, UNIQUE by counting keys, and
    REFERENCES, if ``parents`` (the table referred to) is given, by the keys that it lacks.
    """
    key = KEYS[name]
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in [*key, *REQUIRED[name]]]
    tests += [F.when((F.col(c) < 0) | (F.col(c) > 1), F.lit(c)) for c in SHARES.get(name, ())]
    tests += [F.when(~F.col(c).isin(*words), F.lit(c)) for c, words in WORDS.get(name, {}).items()]
    broken = rows.select(*key, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("failed_check"))
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit("unique").alias("failed_check"))
    out = broken.unionByName(repeated)
    if parents is not None and name in REFERENCES:
        named = F.concat("job_id", F.lit("/"), "bucket_id") if name == "word_timestamps" else F.col("job_id")
        known = parents.select(named.alias(key[0])).where(F.col(key[0]).isNotNull()).distinct()
        lost = rows.where(F.col(key[0]).isNotNull()).join(known, key[0], "left_anti")
        out = out.unionByName(lost.select(*key, F.lit("reference").alias("failed_check")))
    return out


def check_buckets(rows: DataFrame) -> DataFrame:
    """Rows of ``timing_buckets`` that break the declared checks, with the check's name."""
    return check_table(rows, "timing_buckets").where(F.col("failed_check").isin("confidence", "cadence_severity"))


# ---------------------------------------------------------------- tables on disk with keyed delivery

#: A table lies in so many parts, by a hash of its first key column.
PARTS = 64


def _manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, str]]:
    """Number of the newest version of a table, and the folder of each of its parts."""
    try:
        rows = spark.read.schema("part int, folder string, version bigint").parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0, {}
        raise
    newest = rows.agg(F.max("version")).first()[0] or 0
    return newest, {r.part: r.folder for r in rows.where(F.col("version") == newest).collect() if r.part >= 0}  # at most PARTS rows


def current_table(spark: SparkSession, path: str, name: str, generated: bool = True) -> DataFrame:
    """The rows of a table that deliveries have left, with its generated columns."""
    folders = _manifest(spark, f"{path}/{name}")[1]
    schema = T.StructType.fromDDL(schemas.WAREHOUSE[name])
    rows = spark.read.schema(schema).parquet(*folders.values()) if folders else spark.createDataFrame([], schema)
    return with_generated(rows, name) if generated else rows


def deliver(rows: DataFrame, path: str, name: str, parents: DataFrame | None = None) -> DataFrame:
    """Bring ``rows`` into a table on disk and return the checks that failed, as ``check_table``.

    A delivery replaces all rows that share its first key column (a job's buckets, a bucket's words, a
    job's only row).  Rows whose key fails a check are left out.  Only the parts that hold arriving
    keys are written, to a new folder; the table then changes at once by a new manifest, so
    that readers see the old version or the new one.  Of two deliveries at a time the later
    finds its version taken and fails without changing anything.
    """
    spark, folder, key = rows.sparkSession, f"{path}/{name}", KEYS[name]
    part = F.pmod(F.xxhash64(key[0]), F.lit(PARTS)).cast("int")
    arriving = settle(_declared(rows, name))
    failed = settle(check_table(arriving, name, parents))
    sound = arriving
    for c in key:
        sound = sound.where(F.col(c).isNotNull())
    sound = settle(sound.join(failed.select(*key).distinct(), key, "left_anti").withColumn("part", part))
    touched = {r.part for r in sound.select("part").distinct().collect()}  # at most PARTS
    version, parts = _manifest(spark, folder)
    merged = sound
    held = [parts[p] for p in touched if p in parts]
    if held:
        old = spark.read.schema(T.StructType.fromDDL(schemas.WAREHOUSE[name])).parquet(*held)
        merged = merged.unionByName(old.join(sound.select(key[0]).distinct(), key[0], "left_anti").withColumn("part", part))
    target = f"{folder}/data/{uuid.uuid4().hex}"
    merged.repartition("part").write.partitionBy("part").parquet(target)
    listed = parts | {p: f"{target}/part={p}" for p in touched}
    entries = list(listed.items()) or [(-1, "")]
    spark.createDataFrame(entries, "part int, folder string").coalesce(1).write.mode("error").parquet(f"{folder}/manifest/version={version + 1}")
    return failed


def job_status_summary(jobs: DataFrame, buckets: DataFrame, cadence: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per job: bucket counts, mean confidence, gap mean, summary and cost.

    Buckets are counted before the join, so the join is one row to one row.
    """
    counted = buckets.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_buckets"),
        F.count(F.when(F.col("cadence_anomaly"), 1)).alias("anomalous_buckets"),
        F.avg("confidence").alias("avg_confidence"),
    )
    return (
        jobs.join(counted, "job_id", "left")
        .join(cadence.select("job_id", "gap_mean", "cadence_summary"), "job_id", "left")
        .join(metrics.select("job_id", "cost_estimate_usd"), "job_id", "left")
        .select(
            "job_id",
            "status",
            "created_at",
            "processing_time_seconds",
            "file_size_bytes",
            "duration_seconds",
            F.coalesce("total_buckets", F.lit(0)).alias("total_buckets"),
            F.coalesce("anomalous_buckets", F.lit(0)).alias("anomalous_buckets"),
            "avg_confidence",
            "gap_mean",
            "cadence_summary",
            "cost_estimate_usd",
        )
    )


def processing_performance(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Completed jobs per day, newest first."""
    return (
        jobs.where(F.col("status") == "completed")
        .join(metrics, "job_id")
        .groupBy(F.date_trunc("day", "created_at").alias("processing_date"))
        .agg(
            F.count(F.lit(1)).alias("jobs_processed"),
            F.avg("processing_time_seconds").alias("avg_processing_time"),
            F.avg("chunks_processed").alias("avg_chunks_per_job"),
            F.avg("time_saved_seconds").alias("avg_time_saved"),
            F.sum("cost_estimate_usd").alias("total_cost_usd"),
            F.avg("speed_multiplier_applied").alias("avg_speed_multiplier"),
        )
        .orderBy(F.col("processing_date").desc())
    )


def file_stats(runs: DataFrame, key: str = "batch_id") -> DataFrame:
    """Totals, ratios and how often each operation was applied."""
    totals = runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("processing_time").alias("total_processing_time"),
        F.sum("original_duration").alias("total_original_duration"),
        F.sum("processed_duration").alias("total_processed_duration"),
    )
    operations = (
        runs.select(key, F.explode("applied_operations").alias("op"))
        .groupBy(key, "op")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("op", "n")))).alias("operation_counts"))
    )
    before, after, busy = (F.col(f"total_{c}") for c in ("original_duration", "processed_duration", "processing_time"))
    return totals.join(operations, key, "left").withColumns(
        {
            "compression_ratio": ratio(after, before, 1.0),
            "processing_speed": ratio(before, busy),
            "average_processing_time": busy / F.col("total_files"),
        }
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals by outcome per batch."""
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("seconds").alias("total_time"),
    )


# fixed values: stages whose share of the time is reported
STAGES = {
    "chunking": "chunking_percentage",
    "initial_transcription": "transcription_percentage",
    "confidence_reprocessing": "reprocessing_percentage",
    "output_generation": "output_percentage",
}


def stage_metrics(stage_timings: DataFrame, totals: DataFrame) -> DataFrame:
    """Share of each stage in the job's time; a missing stage counts 0."""
    per = stage_timings.groupBy("job_id").pivot("stage", list(STAGES)).agg(F.sum("seconds"))
    rows = totals.join(per, "job_id", "left")
    share = lambda s: ratio(F.coalesce(F.col(s), F.lit(0.0)) * 100, F.col("total_time"))
    return rows.select(
        "job_id",
        F.col("total_time").alias("total_processing_time"),
        *[share(s).alias(name) for s, name in STAGES.items()],
    )


def stage_outcomes(stage_log: DataFrame) -> DataFrame:
    """Completed and failed stages, success rate and speed factor per run."""
    return (
        stage_log.groupBy("run_id")
        .agg(
            F.count_if(F.col("status") == "completed").alias("stages_completed"),
            F.count_if(F.col("status") == "failed").alias("stages_failed"),
            F.count(F.lit(1)).alias("_all"),
            F.sum("seconds").alias("total_processing_time"),
            F.max("audio_duration").alias("audio_duration"),
        )
        .withColumns(
            {
                "success_rate": F.col("stages_completed") / F.col("_all") * 100,
                "processing_speed_factor": ratio(F.col("audio_duration"), F.col("total_processing_time")),
            }
        )
        .drop("_all")
    )


def recording_report(
    recordings: DataFrame, quality: DataFrame, speakers: DataFrame, cadence: DataFrame
) -> DataFrame:
    """One row per recording; columns of a stage that did not run are null."""
    return (
        recordings.join(quality.select(KEY, "overall_quality_score", "flagged_segments"), KEY, "left")
        .join(speakers.select(KEY, "speaker_count"), KEY, "left")
        .join(cadence.select(KEY, "bucket_count", "anomalous_buckets", "global_gap_mean", "cadence_summary"), KEY, "left")
    )


def search_text(buckets: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rows that contain every term of the query (case-folded words), with the number of hits."""
    terms = [t for t in query.lower().split() if t]
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    rows = buckets.withColumn("_w", words)
    hits = F.size(F.filter("_w", lambda w: w.isin(*terms)))
    for t in terms:
        rows = rows.where(F.array_contains("_w", t))
    return rows.withColumn("hits", hits).drop("_w")


