"""Explicit schemas.  Nothing in the library infers a schema from data."""

WORD = "struct<word:string,start:double,end:double,probability:double>"

SEGMENTS = (
    "recording_id bigint, segment_id bigint, start double, end double, text string, "
    "avg_logprob double, no_speech_prob double, language string, temperature double, "
    f"words array<{WORD}>"
)

WORDS = (
    "recording_id bigint, segment_id bigint, pos int, word string, start_ms bigint, end_ms bigint, "
    "probability double, timing_repaired boolean"
)

DIARIZATION = "recording_id bigint, turn_no bigint, speaker string, start_ms bigint, end_ms bigint"

# segment documents as the pipeline writes them; both spellings of the aliased keys, both places of the segments
_SEGMENTS = (
    "array<struct<id:bigint,start:double,end:double,text:string,"
    "avg_logprob:double,confidence:double,no_speech_prob:double,language:string,temperature:double,"
    "reprocessed:boolean,original_confidence:double,"
    "words:array<struct<word:string,text:string,start:double,end:double,probability:double,confidence:double>>>>"
)
SEGMENT_DOCUMENT = f"struct<recording_id:bigint,segments:{_SEGMENTS},transcription:struct<segments:{_SEGMENTS}>>"

CHUNK_DOCUMENT = (
    "struct<recording_id:bigint,original_file:string,total_duration:double,total_chunks:bigint,"
    "processing_time:double,silence_removed:double,compression_ratio:double,chunking_strategy:string,"
    "chunks:array<struct<chunk_id:bigint,start_time:double,end_time:double,duration:double,file_path:string,"
    "original_start:double,original_end:double,overlap_prev:double,overlap_next:double>>>"
)

TIMING_DOCUMENT = (
    "struct<recording_id:bigint,timing_analysis:struct<bucket_count:bigint,buckets:array<struct<"
    "bucket_id:bigint,start_ts:double,end_ts:double,duration:double,text:string,word_count:bigint,"
    f"words:array<{WORD}>,"
    "timing_metrics:struct<word_gap_count:bigint,word_gaps:array<double>,word_gap_mean:double,word_gap_var:double,"
    "words_per_second:double,total_speech_time:double,total_silence_time:double>,"
    "quality_metrics:struct<confidence:double,speaker_overlap:boolean,cadence_anomaly:boolean,"
    "cadence_severity:string>>>>>"
)

# warehouse tables; generated columns are added by operators.warehouse
TRANSCRIPTION_JOBS = (
    "job_id string, input_path string, output_path string, status string, model_size string, language string, "
    "speed_multiplier decimal(3,2), enhanced_analysis boolean, speaker_diarization boolean, created_at timestamp, "
    "started_at timestamp, completed_at timestamp, processing_time_seconds int, file_size_bytes bigint, "
    "duration_seconds decimal(10,3), error_message string"
)
TIMING_BUCKETS = (
    "job_id string, bucket_id string, start_timestamp decimal(10,3), end_timestamp decimal(10,3), text string, "
    "word_count int, word_gap_count int, word_gap_mean decimal(8,6), word_gap_variance decimal(10,8), "
    "words_per_second decimal(6,3), total_speech_time decimal(8,3), total_silence_time decimal(8,3), "
    "confidence decimal(4,3), speaker_overlap boolean, cadence_anomaly boolean, cadence_severity string"
)
WORD_TIMESTAMPS = (
    "bucket_id string, word_index int, word string, start_timestamp decimal(10,3), end_timestamp decimal(10,3), "
    "probability decimal(4,3)"
)
CADENCE_ANALYSIS = (
    "job_id string, gap_mean decimal(8,6), gap_std decimal(8,6), total_words int, total_gaps int, "
    "anomaly_threshold decimal(4,2), anomalous_buckets int, gap_p50 decimal(8,6), gap_p75 decimal(8,6), "
    "gap_p90 decimal(8,6), gap_p95 decimal(8,6), gap_p99 decimal(8,6), cadence_summary string"
)
SPEAKER_ANALYSIS = "job_id string, speaker_count int, overlaps_detected int, confidence_score decimal(4,3)"
PROCESSING_METRICS = (
    "job_id string, gpu_workers_used int, cpu_workers_used int, peak_memory_mb int, chunks_processed int, "
    "chunks_failed int, chunking_time_seconds int, transcription_time_seconds int, assembly_time_seconds int, "
    "total_processing_time_seconds int, speed_multiplier_applied decimal(3,2), "
    "original_duration_seconds decimal(10,3), processed_duration_seconds decimal(10,3), cost_estimate_usd decimal(8,2)"
)
WAREHOUSE = {
    "transcription_jobs": TRANSCRIPTION_JOBS,
    "timing_buckets": TIMING_BUCKETS,
    "word_timestamps": WORD_TIMESTAMPS,
    "cadence_analysis": CADENCE_ANALYSIS,
    "speaker_analysis": SPEAKER_ANALYSIS,
    "processing_metrics": PROCESSING_METRICS,
}
