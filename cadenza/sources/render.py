"""Text documents as ordered line tables.

A document is the lines of one recording, ordered by (section, item, sub).  No row holds a
whole document, so a recording of any length renders and writes in parallel; writers sort
the lines and put them out as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import fixed, format_gaps, mmss, mmss_ms, seconds, srt_time, strip, time_range
from cadenza.operators.cadence import UNKNOWN_OVERLAP, markdown_statistics
from cadenza.operators.legacy import PERCENTILES
from cadenza.timeline import KEY, SLICE, numbered, with_slice

LINE_ORDER = ("section", "item", "sub")
PER_SLICE = 256


def _lines(df: DataFrame, section: int, item: Column, lines: Column) -> DataFrame:
    return df.select(
        KEY,
        F.lit(section).alias("section"),
        item.cast("bigint").alias("item"),
        F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("sub", "line"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def with_cue(df: DataFrame, order: str = "segment_id") -> DataFrame:
    """Cue numbers from 1 in the order of ``order``."""
    return numbered(with_slice(df, order, PER_SLICE), [order], "cue", first=1).drop(SLICE)


# ---------------------------------------------------------------- SRT and text

SRT_STYLES = ("plain", "speaker", "timing", "confidence", "advanced")


def cue_text(style: str) -> Column:
    """Text of a cue with the labels of ``style``."""
    text = F.col("text")
    mark = lambda cond, label: F.when(cond, F.lit(f" {label}")).otherwise(F.lit(""))
    low = mark(F.col("avg_logprob") < -1.0, "[LOW_CONF]") if style == "advanced" else F.lit("")
    if style in ("speaker", "advanced"):
        named = F.coalesce(F.col("speaker"), F.lit("")) != ""
        prefix = F.when(named, F.concat(F.lit("["), F.col("speaker"), F.lit("] "))).otherwise(F.lit(""))
        return F.concat(prefix, text, mark(F.col("has_overlap"), "[OVERLAP]"), low)
    if style == "timing":
        cadence = F.when(
            F.col("cadence_anomaly"), F.concat(F.lit(" ["), F.upper("cadence_severity"), F.lit("_CADENCE]"))
        ).otherwise(F.lit(""))
        return F.concat(
            text, cadence, mark(F.coalesce("speaker_overlap", F.lit(False)), "[OVERLAP]"), mark(F.col("confidence") < 0.5, "[LOW_CONF]")
        )
    if style == "confidence":
        weak = F.when(F.col("reprocessed"), F.lit(" [ENHANCED]")).when(
            F.col("avg_logprob") < -0.5, F.lit(" [LOW_CONF]")
        )
        return F.concat(strip(text), F.coalesce(weak, F.lit("")))
    return text


def to_srt(rows: DataFrame, style: str = "plain", order: str = "segment_id") -> DataFrame:
    """SRT cues, four lines each."""
    if style not in SRT_STYLES:
        raise ValueError(f"unknown style {style}")
    cues = with_cue(rows, order)
    times = _text(srt_time("start_ms"), " --> ", srt_time("end_ms"))
    return _lines(cues, 0, F.col("cue"), F.array(F.col("cue").cast("string"), times, cue_text(style), F.lit("")))


def to_txt(rows: DataFrame, style: str = "timestamped", report: DataFrame | None = None) -> DataFrame:
    """``timestamped`` lines, a ``paragraph``, or a ``confidence`` header followed by the text."""
    if style == "timestamped":
        named = F.coalesce(F.col("speaker"), F.lit("")) != ""
        who = F.when(named, F.concat(F.lit("["), F.col("speaker"), F.lit("] "))).otherwise(F.lit(""))
        return _lines(rows, 0, F.col("segment_id"), F.array(_text("[", mmss("start_ms"), "] ", who, F.col("text"))))
    body = _lines(rows, 1, F.col("segment_id"), F.array(strip("text")))
    if style == "paragraph":
        return body
    n, k = F.col("total_segments"), F.col("reprocessed_segments")
    head = F.array(
        F.lit("# Transcription with Confidence Enhancement"),
        _text("# Total segments: ", n.cast("string")),
        _text("# Enhanced segments: ", k.cast("string")),
        _text("# Enhancement rate: ", fixed(k / n * 100, 1), "%"),
        F.lit(""),
    )
    return _lines(report, 0, F.lit(0), head).unionByName(body)


# ---------------------------------------------------------------- CSV


def segment_csv(rows: DataFrame, with_speakers: bool = True) -> DataFrame:
    columns = [
        F.col("segment_id"),
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        F.col("text"),
        F.col("avg_logprob").alias("confidence"),
    ]
    if with_speakers:
        columns += [F.coalesce("speaker", F.lit("")).alias("speaker"), F.col("has_overlap")]
    return rows.select(KEY, *columns)


def analysis_csv(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        KEY,
        "segment_id",
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        "text",
        F.col("avg_logprob").alias("confidence"),
        "no_speech_prob",
        "speaker",
        "has_overlap",
        "uncertainty_level",
        "quality_flag",
    )


def timing_csv(flagged: DataFrame) -> DataFrame:
    return flagged.select(
        KEY,
        F.col("bucket_index").alias("bucket_id"),
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        "text",
        "word_count",
        "confidence",
        "speaker_overlap",
        "word_gap_count",
        "word_gap_mean",
        "word_gap_var",
        "words_per_second",
        F.col("total_speech_time").alias("speech_time"),
        F.col("total_silence_time").alias("silence_time"),
        "cadence_anomaly",
        "cadence_severity",
        "gap_deviation_from_global",
    )


def uncertainty_csv(analysis: DataFrame) -> DataFrame:
    return analysis.select(
        KEY,
        "segment_id",
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        "text",
        "confidence_score",
        "uncertainty_level",
        F.array_join("uncertainty_reasons", "; ").alias("uncertainty_reasons"),
        "suggested_review",
    )


def to_csv(rows: DataFrame, kind: str = "segment") -> DataFrame:
    """The fixed columns of one CSV kind."""
    return {"segment": segment_csv, "analysis": analysis_csv, "timing": timing_csv, "uncertainty": uncertainty_csv}[kind](rows)


# ---------------------------------------------------------------- JSON


def json_document(facts: DataFrame, head: dict[str, Column], inner: str, items: DataFrame, no: str, item: Column) -> DataFrame:
    """A JSON object per recording: the ``head`` members, then array ``inner`` with one item per line.

    ``inner`` may be dotted (``timing_analysis.buckets``).  ``no`` numbers the items from 0.
    """
    path = inner.split(".")
    opening = "".join(f'"{p}":{{' for p in path[:-1]) + f'"{path[-1]}":['
    members = [_text(f'"{k}":', F.coalesce(v, F.lit("null")), ",") for k, v in head.items()]
    first = _text('{"recording_id":', F.col(KEY).cast("string"), ",", *members, opening)
    last = "]" + "}" * len(path)
    line = _text(F.when(F.col(no) == 0, F.lit("")).otherwise(F.lit(",")), F.to_json(item))
    return (
        _lines(facts, 0, F.lit(0), F.array(first))
        .unionByName(_lines(items, 1, F.col(no), F.array(line)))
        .unionByName(_lines(facts, 2, F.lit(0), F.array(F.lit(last))))
    )


def _metadata(version: str, form: str) -> Column:
    return F.to_json(F.struct(F.lit(version).alias("version"), F.lit(form).alias("format")))


def _segment_struct(*extra: str) -> Column:
    return F.struct(
        F.col("segment_id").alias("id"),
        seconds("start_ms").alias("start"),
        seconds("end_ms").alias("end"),
        "text",
        "avg_logprob",
        "no_speech_prob",
        *extra,
    )


def _counted(rows: DataFrame, order: str) -> DataFrame:
    return with_cue(rows, order).withColumn("_no", F.col("cue") - 1)


def segment_json(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Plain segment document.  ``facts``: recording, language, duration_ms."""
    head = {
        "metadata": _metadata("0.1.0", "Transcript JSON v1.0"),
        "transcription": F.to_json(F.struct("language", seconds("duration_ms").alias("duration"))),
    }
    extra = [c for c in ("words",) if c in rows.columns]
    return json_document(facts, head, "segments", _counted(rows, "segment_id"), "_no", _segment_struct(*extra))


def advanced_json(labelled: DataFrame, facts: DataFrame) -> DataFrame:
    """Segments with speaker labels, and the speaker and quality analysis in the head.

    ``facts``: language, speaker_count, total_overlaps, overall_quality_score,
    flagged_segments, recommendations.
    """
    head = {
        "metadata": _metadata("0.1.0", "Advanced Transcript JSON v1.0"),
        "speaker_analysis": F.to_json(
            F.struct(F.lit(True).alias("enabled"), "speaker_count", F.col("total_overlaps").alias("overlaps_detected"))
        ),
        "quality_analysis": F.to_json(
            F.struct(
                F.lit(True).alias("enabled"),
                F.col("overall_quality_score").alias("overall_score"),
                "flagged_segments",
                "recommendations",
            )
        ),
    }
    items = _counted(labelled, "segment_id")
    return json_document(facts, head, "segments", items, "_no", _segment_struct("speaker", "has_overlap"))


def orchestrator_json(segments: DataFrame, report: DataFrame, speed: float = 1.75) -> DataFrame:
    """Second-pass document: segments with their old scores, the report in the head."""
    head = {
        "metadata": F.to_json(
            F.struct(
                F.col(KEY).cast("string").alias("job_id"),
                F.lit("0.3.0").alias("version"),
                F.array(F.lit("confidence_reprocessing"), F.lit("timing_analysis")).alias("features"),
                F.lit(speed).alias("processing_speed"),
                F.lit(True).alias("confidence_reprocessing_enabled"),
            )
        ),
        "confidence_report": F.to_json(F.struct(*[c for c in report.columns if c != KEY])),
    }
    item = _segment_struct("reprocessed", "original_confidence")
    return json_document(report, head, "segments", _counted(segments, "segment_id"), "_no", item)


def _word_array() -> Column:
    return F.transform(
        "words",
        lambda w: F.struct(
            w["word"].alias("word"),
            seconds(w["start_ms"]).alias("start"),
            seconds(w["end_ms"]).alias("end"),
            w["probability"].alias("probability"),
        ),
    )


def enhanced_json(records: DataFrame, context: DataFrame, summary: DataFrame) -> DataFrame:
    """Record document: cadence context and totals in the head, one record per line."""
    facts = context.join(summary, KEY)
    head = {
        "metadata": _metadata("0.4.0", "Enhanced Transcript JSON v2.0"),
        "analysis_context": F.to_json(
            F.struct(
                "global_mean",
                F.col("global_std").alias("global_std_dev"),
                "global_variance",
                context["total_gaps"],
                "gap_threshold",
                "slow_threshold",
                "fast_threshold",
            )
        ),
        "summary": F.to_json(
            F.struct(
                F.col("record_count").alias("total_buckets"),
                "total_duration",
                "total_words",
                F.struct(F.col("slow_count").alias("slow"), F.col("normal_count").alias("normal"), F.col("fast_count").alias("fast")).alias(
                    "cadence_distribution"
                ),
            )
        ),
    }
    item = F.struct(
        "bucket_index",
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        "text",
        "word_count",
        "word_gap_count",
        F.transform("gaps_ms", lambda g: seconds(g)).alias("word_gaps"),
        "word_gap_mean",
        "word_gap_var",
        "cadence",
        "speaker_overlap",
        "confidence_score",
        _word_array().alias("words"),
    )
    return json_document(facts, head, "timing_buckets", records, "bucket_index", item)


def timing_json(flagged: DataFrame, cadence: DataFrame) -> DataFrame:
    """Timing document: global cadence in the head, one bucket per line."""
    head = {
        "metadata": _metadata("0.2.0", "Enhanced Transcript JSON with Timing Analysis v1.0"),
        "global_cadence": F.to_json(
            F.struct(
                F.col("global_gap_mean").alias("gap_mean"),
                F.col("global_gap_std").alias("gap_std"),
                "total_words",
                "total_gaps",
                "anomaly_threshold",
                "anomalous_buckets",
                F.struct(*[f"p{p}" for p in PERCENTILES]).alias("gap_percentiles"),
                "cadence_summary",
            )
        ),
    }
    item = F.struct(
        F.col("bucket_index").alias("bucket_id"),
        seconds("start_ms").alias("start_ts"),
        seconds("end_ms").alias("end_ts"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
        "text",
        "word_count",
        *([_word_array().alias("words")] if "words" in flagged.columns else []),
        F.struct(
            "word_gap_count",
            F.transform("gaps_ms", lambda g: seconds(g)).alias("word_gaps"),
            "word_gap_mean",
            "word_gap_var",
            "words_per_second",
            "total_speech_time",
            "total_silence_time",
        ).alias("timing_metrics"),
        F.struct("confidence", "speaker_overlap", "cadence_anomaly", "cadence_severity").alias("quality_metrics"),
    )
    return json_document(cadence, head, "timing_analysis.buckets", flagged, "bucket_index", item)


def chunk_json(chunks: DataFrame, totals: DataFrame, strategy: str = "silence_aware") -> DataFrame:
    """Chunk metadata.  ``totals``: total_duration, total_chunks, silence_removed, compression_ratio."""
    head = {
        "total_duration": F.col("total_duration").cast("string"),
        "total_chunks": F.col("total_chunks").cast("string"),
        "silence_removed": F.col("silence_removed").cast("string"),
        "compression_ratio": F.col("compression_ratio").cast("string"),
        "chunking_strategy": F.lit(f'"{strategy}"'),
    }
    item = F.struct(
        "chunk_id", "start_time", "end_time", "duration", "file_path", "original_start", "original_end", "overlap_prev", "overlap_next"
    )
    return json_document(totals, head, "chunks", _counted(chunks, "chunk_id"), "_no", item)


def diarization_json(diarization: DataFrame, summary: DataFrame) -> DataFrame:
    head = {"summary": F.to_json(F.struct(*[c for c in summary.columns if c != KEY]))}
    item = F.struct(
        F.col("speaker").alias("speaker_id"),
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        seconds(F.col("end_ms") - F.col("start_ms")).alias("duration"),
    )
    return json_document(summary, head, "speaker_segments", diarization, "turn_no", item)


def uncertainty_json(analysis: DataFrame, metrics: DataFrame) -> DataFrame:
    head = {"quality_metrics": F.to_json(F.struct(*[c for c in metrics.columns if c != KEY]))}
    item = F.struct(
        "segment_id",
        seconds("start_ms").alias("start_time"),
        seconds("end_ms").alias("end_time"),
        "text",
        "confidence_score",
        "uncertainty_level",
        "uncertainty_reasons",
        "suggested_review",
    )
    return json_document(metrics, head, "uncertain_segments", _counted(analysis, "segment_id"), "_no", item)


# ---------------------------------------------------------------- RTTM and Markdown


def to_rttm(diarization: DataFrame, stem: str = "recording_") -> DataFrame:
    start, length = F.col("start_ms"), F.col("end_ms") - F.col("start_ms")
    dec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
    line = _text("SPEAKER ", stem, F.col(KEY).cast("string"), " 1 ", dec(start), " ", dec(length), " <NA> <NA> ", F.col("speaker"), " <NA> <NA>")
    return _lines(diarization, 0, F.col("turn_no"), F.array(line))


def _percent(n: Column, of: Column) -> Column:
    return fixed(n / of * 100, 1)


def to_bucket_markdown(records: DataFrame, title: str = "Enhanced Transcription", precision: int = 4) -> DataFrame:
    """Per-bucket report: header, one section per record with all gaps, summary."""
    st = markdown_statistics(records)
    n = F.col("record_count")
    head = F.array(
        F.lit(f"# {title}"),
        F.lit(""),
        F.lit("## Processing Summary"),
        F.lit(""),
        _text("**Total Duration:** ", fixed("total_duration", 1), " seconds  "),
        _text("**Total Words:** ", F.col("total_words").cast("string"), "  "),
        _text("**Total Word Gaps:** ", F.col("total_gaps").cast("string"), "  "),
        _text("**Timing Buckets:** ", n.cast("string"), " (4-second windows)  "),
        F.lit("**Analysis Method:** Population variance with ±1.5σ cadence thresholds  "),
        F.lit(""),
        F.lit("## Enhanced Transcript"),
        F.lit(""),
        F.lit("*Each section represents a ~4-second timing window with comprehensive word-gap analysis.*"),
        F.lit(""),
    )
    section = F.array(
        _text((F.col("bucket_index") + 1).cast("string"), ". **[", time_range("start_ms", "end_ms"), "]** ", F.col("text")),
        _text("<sub>confidence ", fixed("confidence_score", 2), "</sub>"),
        _text("<sub>speaker_overlap ", F.col("speaker_overlap"), "</sub>"),
        _text("<sub>word_gap_count ", F.col("word_gap_count").cast("string"), "</sub>"),
        _text("<sub>word_gaps ", format_gaps("gaps_ms", None, precision), "</sub>"),
        _text("<sub>word_gap_mean ", fixed("word_gap_mean", precision), "</sub>"),
        _text("<sub>word_gap_var ", fixed("word_gap_var", precision + 2), "</sub>"),
        _text("<sub>cadence ", F.col("cadence"), "</sub>"),
        F.lit(""),
    )
    share = lambda label, c: _text(
        f"- **{label}:** ", F.col(c).cast("string"), " segments (", _percent(F.col(c), n), "%)  "
    )
    some = F.col("total_gaps") > 0
    limit = lambda sign: fixed(F.col("global_mean") + F.lit(sign * 1.5) * F.col("global_std"), 3)
    tail = F.array(
        F.lit("## Analysis Summary"),
        F.lit(""),
        F.lit("### Cadence Distribution"),
        F.lit(""),
        share("Slow", "slow_count"),
        share("Normal", "normal_count"),
        share("Fast", "fast_count"),
        F.lit(""),
        F.lit("### Speaker Overlap Analysis"),
        F.lit(""),
        share("Overlap", "overlap_count"),
        share("Single", "single_count"),
        share(UNKNOWN_OVERLAP.title(), "unknown_count"),
        F.lit(""),
        F.lit("### Quality Metrics"),
        F.lit(""),
        _text("- **Average Confidence:** ", fixed("average_confidence", 3), "  "),
        _text("- **Words per Segment:** ", fixed("words_per_segment", 1), "  "),
        _text("- **Gaps per Segment:** ", fixed("gaps_per_segment", 1), "  "),
        F.lit(""),
        F.when(some, F.lit("### Global Gap Statistics")),
        F.when(some, F.lit("")),
        F.when(some, _text("- **Total Gaps Analyzed:** ", F.col("total_gaps").cast("string"), "  ")),
        F.when(some, _text("- **Global Mean:** ", fixed("global_mean", precision), "s  ")),
        F.when(some, _text("- **Global Variance:** ", fixed("global_variance", precision + 2), "  ")),
        F.when(some, _text("- **Global Std Dev:** ", fixed("global_std", precision), "s  ")),
        F.when(some, _text("- **Cadence Thresholds:** Fast < ", limit(-1), "s, Slow > ", limit(1), "s  ")),
    )
    return (
        _lines(st, 0, F.lit(0), head)
        .unionByName(_lines(records, 1, F.col("bucket_index"), section))
        .unionByName(_lines(st, 2, F.lit(0), tail))
    )


def to_timing_markdown(flagged: DataFrame, text_parts: DataFrame, cadence: DataFrame) -> DataFrame:
    """Timing report.  A bucket's text fills one line per part, so long buckets stay in pieces."""
    n, odd = F.col("bucket_count"), F.col("anomalous_buckets")
    head = F.array(
        F.lit("# Enhanced Transcription with Timing Analysis"),
        F.lit(""),
        _text("**Timing Buckets:** ", n.cast("string"), "  "),
        _text("**Total Words:** ", F.col("total_words").cast("string"), "  "),
        _text("**Total Gaps:** ", F.col("total_gaps").cast("string"), "  "),
        _text("**Cadence Summary:** ", F.col("cadence_summary"), "  "),
        F.when(odd > 0, _text("**Anomalous Buckets:** ", odd.cast("string"), "/", n.cast("string"), " (", _percent(odd, n), "%)  ")),
        F.lit(""),
        F.lit("## Cadence Statistics"),
        F.lit(""),
        _text("- **Global Gap Mean:** ", fixed("global_gap_mean", 3), "s  "),
        _text("- **Global Gap Std:** ", fixed("global_gap_std", 3), "s  "),
        _text("- **Anomaly Threshold:** ", F.col("anomaly_threshold").cast("string"), "x standard deviation  "),
        F.lit(""),
        F.lit("### Gap Distribution Percentiles"),
        F.lit(""),
        *[F.when(F.col(f"p{p}").isNotNull(), _text(f"- **P{p}:** ", fixed(f"p{p}", 3), "s  ")) for p in PERCENTILES],
        F.lit(""),
        F.lit("## Detailed Transcript with Timing Analysis"),
        F.lit(""),
    )
    opening = text_parts.groupBy(KEY, "bucket_index").agg(F.min("part_no").alias("_first"))
    spans = flagged.select(KEY, "bucket_index", "start_ms", "end_ms").join(opening, [KEY, "bucket_index"])
    spoken = text_parts.join(spans, [KEY, "bucket_index"])
    label = _text((F.col("bucket_index") + 1).cast("string"), ". **[", mmss_ms("start_ms"), "–", mmss_ms("end_ms"), "]** ")
    body = spoken.select(
        KEY,
        F.lit(1).alias("section"),
        (F.col("bucket_index") * 2).alias("item"),
        (F.col("part_no") - F.col("_first")).cast("int").alias("sub"),
        _text(F.when(F.col("part_no") == F.col("_first"), label).otherwise(F.lit("    ")), F.col("text"), "  ").alias("line"),
    )
    status = F.when(F.col("speaker_overlap").isNull(), F.lit("unknown")).otherwise(F.col("speaker_overlap").cast("string"))
    detail = F.array(
        _text("    <sub>confidence ", fixed("confidence", 2), "</sub>  "),
        _text("    <sub>speaker_overlap ", status, "</sub>  "),
        _text("    <sub>word_gap_count ", F.col("word_gap_count").cast("string"), "</sub>  "),
        F.when(F.size("gaps_ms") > 0, _text("    <sub>word_gaps ", format_gaps("gaps_ms", None, 4, ","), "</sub>  ")),
        _text("    <sub>word_gap_mean ", fixed("word_gap_mean", 4), "</sub>  "),
        _text("    <sub>word_gap_var ", fixed("word_gap_var", 6), "</sub>  "),
        F.lit(""),
    )
    return (
        _lines(cadence, 0, F.lit(0), head)
        .unionByName(body)
        .unionByName(_lines(flagged, 1, F.col("bucket_index") * 2 + 1, detail))
    )


def to_cadence_report(cadence: DataFrame, flagged: DataFrame) -> DataFrame:
    """Totals, percentile table, anomalous buckets and advice."""
    n, odd = F.col("bucket_count"), F.col("anomalous_buckets")
    comma = lambda c: F.format_number(F.col(c), 0)
    head = F.array(
        F.lit("# Cadence Analysis Report"),
        F.lit(""),
        _text("**Analysis Summary:** ", F.col("cadence_summary"), "  "),
        F.lit(""),
        F.lit("## Global Statistics"),
        F.lit(""),
        _text("- **Total Words:** ", comma("total_words"), "  "),
        _text("- **Total Word Gaps:** ", comma("total_gaps"), "  "),
        _text("- **Global Gap Mean:** ", fixed("global_gap_mean", 4), "s  "),
        _text("- **Global Gap Std:** ", fixed("global_gap_std", 4), "s  "),
        _text("- **Anomaly Threshold:** ", F.col("anomaly_threshold").cast("string"), "x std deviation  "),
        _text("- **Anomalous Buckets:** ", odd.cast("string"), "/", n.cast("string"), " (", _percent(odd, n), "%)  "),
        F.lit(""),
        F.lit("## Gap Distribution"),
        F.lit(""),
        F.lit("| Percentile | Gap Duration |"),
        F.lit("|------------|-------------|"),
        *[F.when(F.col(f"p{p}").isNotNull(), _text(f"| P{p} | ", fixed(f"p{p}", 4), "s |")) for p in PERCENTILES],
        F.lit(""),
        F.when(odd > 0, F.lit("## Anomalous Cadence Segments")),
        F.when(odd > 0, F.lit("")),
        F.when(odd > 0, F.lit("| Time Range | Severity | Gap Mean | Gap Var | Deviation |")),
        F.when(odd > 0, F.lit("|------------|----------|----------|---------|----------|")),
    )
    row = _text(
        "| ",
        mmss_ms("start_ms"),
        "–",
        mmss_ms("end_ms"),
        " | ",
        F.col("cadence_severity"),
        " | ",
        fixed("word_gap_mean", 4),
        "s | ",
        fixed("word_gap_var", 6),
        " | ",
        fixed("gap_deviation_from_global", 4),
        "s |",
    )
    mean, std = F.col("global_gap_mean"), F.col("global_gap_std")
    verdict = (
        F.when(odd == 0, F.lit("✅ **Excellent cadence consistency** - No anomalous segments detected.  "))
        .when(odd / n < 0.1, F.lit("✅ **Good cadence consistency** - Only minor anomalies detected.  "))
        .when(odd / n < 0.3, F.lit("⚠️ **Moderate cadence variation** - Consider reviewing flagged segments.  "))
        .otherwise(F.lit("🔴 **High cadence variation** - Significant pacing inconsistencies detected.  "))
    )
    pace = F.when(mean > 0.3, F.lit("- Consider speech coaching for faster delivery  ")).when(
        mean < 0.05, F.lit("- Consider slowing down for better clarity  ")
    )
    tail = F.array(
        F.when(odd > 0, F.lit("")),
        F.lit("## Recommendations"),
        F.lit(""),
        verdict,
        pace,
        F.when(std > 0.1, F.lit("- Work on consistent pacing throughout speech  ")),
    )
    return (
        _lines(cadence, 0, F.lit(0), head)
        .unionByName(_lines(flagged.where("cadence_anomaly"), 1, F.col("bucket_index"), F.array(row)))
        .unionByName(_lines(cadence, 2, F.lit(0), tail))
    )


def to_quality_report(analysis: DataFrame, quality: DataFrame) -> DataFrame:
    """Plain-text uncertainty report; only segments marked for review are listed.

    ``quality``: metrics and recommendations per recording.
    """
    head = F.array(
        F.lit("Uncertainty Analysis Report"),
        F.lit("=" * 40),
        F.lit(""),
        _text("Overall Quality Score: ", fixed("overall_quality_score", 2)),
        _text(
            "Flagged Segments: ",
            F.col("flagged_segments").cast("string"),
            "/",
            F.col("total_segments").cast("string"),
            " (",
            fixed("flagged_percentage", 1),
            "%)",
        ),
        _text("Average Confidence: ", fixed("average_segment_confidence", 2)),
        F.lit(""),
        F.lit("Recommendations:"),
    )
    advice = F.transform("recommendations", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    after = F.array(F.lit(""), F.lit("Flagged Segments:"), F.lit("-" * 20))
    tenth = lambda c: fixed(seconds(c), 1)
    block = F.array(
        F.lit(""),
        _text("Segment ", F.col("segment_id").cast("string"), " (", tenth("start_ms"), "s - ", tenth("end_ms"), "s)"),
        _text("Text: ", F.col("text")),
        _text("Confidence: ", fixed("confidence_score", 2)),
        _text("Issues: ", F.array_join("uncertainty_reasons", ", ")),
    )
    return _lines(quality, 0, F.lit(0), F.concat(head, advice, after)).unionByName(
        _lines(analysis.where("suggested_review"), 1, F.col("segment_id"), block)
    )


def to_reprocess_report(report: DataFrame, speed: float = 1.75) -> DataFrame:
    """Markdown report on the second pass."""
    gain, k = F.col("average_confidence_improvement"), F.col("reprocessed_segments")
    verdict = (
        F.when(k == 0, F.lit("✅ **All segments had acceptable confidence - no enhancement needed.**  "))
        .when(gain > 0.1, F.lit("✅ **Significant quality improvements achieved!**  "))
        .when(gain > 0.05, F.lit("✅ **Moderate quality improvements achieved.**  "))
        .otherwise(F.lit("ℹ️ **Minor quality improvements achieved.**  "))
    )
    lines = F.array(
        F.lit("# Confidence Enhancement Report"),
        F.lit(""),
        _text("**Job ID:** ", F.col(KEY).cast("string"), "  "),
        F.lit(f"**Processing Speed:** {speed}x  "),
        F.lit("**Enhancement Enabled:** True  "),
        F.lit(""),
        F.lit("## Enhancement Results"),
        F.lit(""),
        _text("- **Total Segments:** ", F.col("total_segments").cast("string"), "  "),
        _text("- **Enhanced Segments:** ", k.cast("string"), "  "),
        _text("- **Enhancement Rate:** ", fixed(F.col("reprocessing_rate") * 100, 1), "%  "),
        _text("- **Average Confidence Improvement:** ", fixed(gain, 3), "  "),
        _text("- **Maximum Improvement:** ", fixed("max_confidence_improvement", 3), "  "),
        F.lit(""),
        F.lit("## Processing Parameters"),
        F.lit(""),
        _text("- **Confidence Threshold:** ", F.col("confidence_threshold_used").cast("string"), "  "),
        _text("- **Enhancement Speed:** ", F.col("slow_speed_multiplier").cast("string"), "x  "),
        _text("- **Context Padding:** ", F.col("context_padding_seconds").cast("string"), "s  "),
        F.lit(""),
        verdict,
    )
    return _lines(report, 0, F.lit(0), lines)


def to_speaker_markdown(labelled: DataFrame, facts: DataFrame) -> DataFrame:
    """Transcript with speakers and flags.  ``facts``: language, total_segments, quality columns."""
    head = F.array(
        F.lit("# Advanced Transcription Report"),
        F.lit(""),
        _text("**Language:** ", F.col("language"), "  "),
        _text("**Segments:** ", F.col("total_segments").cast("string")),
        F.lit(""),
        _text("**Quality Score:** ", fixed("overall_quality_score", 2), "  "),
        _text("**Flagged Segments:** ", F.col("flagged_segments").cast("string")),
        F.lit(""),
        F.lit("## Transcript"),
        F.lit(""),
    )
    cues = with_cue(labelled)
    named = F.coalesce(F.col("speaker"), F.lit("")) != ""
    who = F.when(named, _text("**[", F.col("speaker"), "]** ")).otherwise(F.lit(""))
    flags = F.concat(
        F.when(F.col("has_overlap"), F.lit(" ⚠️ OVERLAP")).otherwise(F.lit("")),
        F.when(F.col("avg_logprob") < -1.0, F.lit(" 🔍 LOW_CONF")).otherwise(F.lit("")),
    )
    hundredth = lambda c: fixed(seconds(c), 2)
    block = F.array(
        _text(F.col("cue").cast("string"), ". **[", hundredth("start_ms"), "–", hundredth("end_ms"), "]** ", who, F.col("text"), flags, "  "),
        _text("    <sub>confidence ", fixed("avg_logprob", 2), "</sub>"),
        F.lit(""),
    )
    return _lines(facts, 0, F.lit(0), head).unionByName(_lines(cues, 1, F.col("cue"), block))


