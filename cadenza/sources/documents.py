"""Readers for the documents the exporters write; each has an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import schemas
from cadenza.functions.columns import to_ms
from cadenza.sources.items import array_items, line_items
from cadenza.sources.writers import read_packed
from cadenza.timeline import KEY, settle, with_facts


#: Where the items of each kind of document stand.
PLACES = {
    "segments": [("segments",), ("transcription", "segments")],
    "chunks": [("chunks",)],
    "timing_analysis.buckets": [("timing_analysis", "buckets")],
}


def _listed(spark: SparkSession, path: str, inner: str, name: str | None) -> tuple[DataFrame, DataFrame]:
    return array_items(spark, path, PLACES[inner]) if name is None else line_items(read_packed(spark, path, name), PLACES[inner])


def _documents(spark: SparkSession, path: str, inner: str, name: str | None = None) -> DataFrame:
    """Every item of the array ``inner`` in the documents below ``path`` as a document of its own, with its number.

    Documents may be pretty-printed, on one line, or in several parts in one directory per
    recording; none is ever held whole.  With ``name`` they are the packed ones of that format.
    """
    listed, _ = _listed(spark, path, inner, name)
    return listed.select(_document(F.col(KEY), inner, F.col("text")).alias("document"), "item")


def _document(key: Column, inner: str, item: Column) -> Column:
    path = inner.split(".")
    opening = "".join(f'"{p}":{{' for p in path[:-1]) + f'"{path[-1]}":['
    return F.concat(F.lit('{"recording_id":'), key.cast("string"), F.lit("," + opening), item, F.lit("]" + "}" * len(path)))


def unreadable(spark: SparkSession, path: str, inner: str = "segments", name: str | None = None) -> DataFrame:
    """(path, length, problem) of the documents below ``path`` of which the readers miss something.

    That is a document whose brackets or strings do not close, one without the array ``inner``, and one
    of whose items is no JSON (the first of them is named).  ``length`` is in bytes.
    """
    listed, whole = _listed(spark, path, inner, name)
    bad = listed.where(F.expr("try_parse_json(text)").isNull()).groupBy("doc").agg(F.min("item").alias("bad"))
    problem = (
        F.when(~F.col("balanced"), F.lit("brackets or strings do not close"))
        .when(~F.col("found"), F.lit(f"no array {inner}"))
        .when(F.col("bad").isNotNull(), F.concat(F.lit("item "), F.col("bad").cast("string"), F.lit(" is no JSON")))
    )
    found = whole.join(bad, "doc", "left").select(F.col("doc").alias("path"), "length", problem.alias("problem"))
    return found.where("problem is not null")


def _keyed(documents: DataFrame, column: str, schema: str) -> DataFrame:
    """The parsed document ``d``, its key, and the number of its first item."""
    first = F.col("item") if "item" in documents.columns else F.lit(0)
    return documents.withColumn("d", F.from_json(column, schema)).select(F.col(f"d.{KEY}").alias(KEY), "d", first.cast("bigint").alias("first"))


def parse_segments(documents: DataFrame, column: str = "document") -> DataFrame:
    """Segment documents to rows; both spellings of text, score and probability keys are accepted."""
    doc = _keyed(documents, column, schemas.SEGMENT_DOCUMENT)
    word = lambda w: F.struct(
        F.coalesce(w["word"], w["text"], F.lit("")).alias("word"),
        F.coalesce(w["start"], F.lit(0.0)).alias("start"),
        F.coalesce(w["end"], F.lit(0.0)).alias("end"),
        F.coalesce(w["probability"], w["confidence"], F.lit(0.0)).alias("probability"),
    )
    return doc.select(KEY, "first", F.posexplode(F.coalesce("d.segments", "d.transcription.segments")).alias("_i", "s")).select(
        KEY,
        F.coalesce("s.id", F.col("first") + F.col("_i")).alias("segment_id"),
        F.coalesce("s.start", F.lit(0.0)).alias("start"),
        F.coalesce("s.end", F.lit(0.0)).alias("end"),
        F.coalesce("s.text", F.lit("")).alias("text"),
        F.coalesce("s.avg_logprob", "s.confidence", F.lit(0.0)).alias("avg_logprob"),
        F.coalesce("s.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"),
        F.col("s.language").alias("language"),
        F.col("s.temperature").alias("temperature"),
        F.transform("s.words", word).alias("words"),
    )


def read_segments(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return parse_segments(_documents(spark, path, "segments", name))


def parse_chunk_metadata(documents: DataFrame, column: str = "document") -> DataFrame:
    """Chunk metadata to rows; speech flag and confidence are not stored and take their defaults."""
    doc = _keyed(documents, column, schemas.CHUNK_DOCUMENT)
    return (
        doc.select(KEY, F.explode("d.chunks").alias("c"))
        .select(KEY, "c.*")
        .withColumns({"has_speech": F.lit(True), "confidence": F.lit(1.0)})
    )


def read_chunk_metadata(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return parse_chunk_metadata(_documents(spark, path, "chunks", name))


def parse_rttm(lines: DataFrame, column: str = "line") -> DataFrame:
    """RTTM lines to speaker turns; the file stem is the recording."""
    f = F.split(F.trim(F.col(column)), " +")
    start, length = f[3].cast("double"), f[4].cast("double")
    return lines.where(F.col(column).startswith("SPEAKER ")).select(
        f[1].alias("stem"),
        f[7].alias("speaker"),
        to_ms(start).alias("start_ms"),
        (to_ms(start) + to_ms(length)).alias("end_ms"),
    )


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_timing(documents: DataFrame, column: str = "document") -> DataFrame:
    """Timing documents to bucket rows with flat metrics."""
    doc = _keyed(documents, column, schemas.TIMING_DOCUMENT)
    return (
        doc.select(KEY, F.explode("d.timing_analysis.buckets").alias("b"))
        .select(KEY, "b.*")
        .select(
            KEY,
            "bucket_id",
            "start_ts",
            "end_ts",
            "duration",
            "text",
            "word_count",
            "words",
            "timing_metrics.*",
            "quality_metrics.*",
        )
    )


def read_timing_json(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    return parse_timing(_documents(spark, path, "timing_analysis.buckets", name))


def item_documents(lines: DataFrame, inner: str = "segments") -> DataFrame:
    """Each item line of a JSON line table as a document of its own, for the parsers above.

    No row ever holds a whole document, however long the recording.
    """
    item = F.regexp_replace("line", "^,", "")
    return lines.where(F.col("section") == 1).select(_document(F.col(KEY), inner, item).alias("document"))


def parse_lines(lines: DataFrame, head: str, item: str) -> DataFrame:
    """Items of a JSON line table (struct ``x``) with the members of its head (struct ``d``).

    ``head`` and ``item`` are struct schemas.  The opening and the closing line together are
    a valid document with an empty array.
    """
    opening = lines.where(F.col("section") == 0).select(KEY, F.col("line").alias("_a"))
    closing = lines.where(F.col("section") == 2).select(KEY, F.col("line").alias("_b"))
    items = lines.where(F.col("section") == 1)
    span = items.groupBy(KEY).agg(F.min("item").alias("_lo"), F.max("item").alias("_hi"))
    heads = opening.join(closing, KEY).join(span, KEY)  # a document without items has no rows
    facts = heads.select(KEY, F.from_json(F.concat("_a", "_b"), head).alias("d"), "_lo", "_hi")
    parsed = items.select(KEY, "item", F.from_json(F.regexp_replace("line", "^,", ""), item).alias("x"))
    return with_facts(parsed, facts, "item", "_lo", "_hi", 4096).select(KEY, "d", "x")


def validate_report_lines(lines: DataFrame) -> DataFrame:
    """``validate_report`` on a line table: the same checks as aggregates over the lines."""
    return _checked(lines, KEY, (F.col("section") == 0) & (F.col("sub") == 0) & F.col("line").startswith("#"))


def _checked(lines: DataFrame, key: str, title: Column) -> DataFrame:
    ever = lambda text: F.max(F.contains("line", F.lit(text)))
    checks = {
        "has_title": F.max(title),
        "has_transcript": ever("## Enhanced Transcript"),
        "has_summary": ever("## Analysis Summary"),
        "has_cadence_info": ever("cadence"),
        "has_gap_info": ever("word_gaps"),
    }
    counted = lines.groupBy(key).agg(
        *[c.alias(n) for n, c in checks.items()],
        F.sum(F.regexp_count("line", F.lit(r"(?m)^\d+\.\s\*\*\["))).alias("section_count"),
        (F.sum(F.length("line") + 1) - 1).alias("file_size"),
    )
    every = None
    for n in checks:
        every = F.col(n) if every is None else every & F.col(n)
    return counted.withColumn("valid", every)


def validate_report(documents: DataFrame, column: str = "document") -> DataFrame:
    """Checks a Markdown report for its headings and counts its numbered sections."""
    c = F.col(column)
    flags = {
        "has_title": c.startswith("#"),
        "has_transcript": F.contains(c, F.lit("## Enhanced Transcript")),
        "has_summary": F.contains(c, F.lit("## Analysis Summary")),
        "has_cadence_info": F.contains(c, F.lit("cadence")),
        "has_gap_info": F.contains(c, F.lit("word_gaps")),
    }
    every = None
    for f in flags.values():
        every = f if every is None else every & f
    return documents.withColumns(
        {
            **flags,
            "valid": every,
            "file_size": F.length(c),
            "section_count": F.regexp_count(c, F.lit(r"(?m)^\d+\.\s\*\*\[")),
        }
    )


def read_and_validate_packed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``validate_report_lines`` of the packed reports of one format."""
    return validate_report_lines(read_packed(spark, path, name))


def read_and_validate_report(spark: SparkSession, path: str) -> DataFrame:
    """``validate_report`` of the files below ``path``, all parts of a recording's directory as one report; by lines."""
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"^(.*/recording_id=[^/]*)/[^/]*$", 1)
    place = F.struct(file, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = settle(spark.read.text(path).select(F.when(folder != "", folder).otherwise(file).alias("path"), place.alias("place"), F.col("value").alias("line")))
    first = lines.groupBy("path").agg(F.min("place").alias("first"))
    # a report's first line is its title; headings never cross lines
    title = lines.join(first, "path").where("place = first").select("path", F.col("line").startswith("#").alias("has_title"))
    return _checked(lines, "path", F.lit(True)).drop("has_title").join(title, "path").withColumn("valid", F.col("valid") & F.col("has_title"))
