"""Speaker turns: overlaps, labels for segments and buckets, statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import folds
from cadenza.functions.columns import overlap_ms, ratio
from cadenza.operators.intervals import BIN_MS, interval_pairs
from cadenza.timeline import KEY, SLICE, SLICE_MS, known, neighbour, numbered, settle, with_facts, with_slice

SEGMENTS_PER_PART = 256
EPSILON_MS = 100
COMPLETE_SHARE_PERCENT = 80


def detect_overlaps(diarization: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Every pair of turns by different speakers that speak at once."""
    a = diarization.select(KEY, F.col("turn_no"), F.col("speaker"), "start_ms", "end_ms")
    b = diarization.select(
        KEY,
        F.col("turn_no").alias("turn_no_r"),
        F.col("speaker").alias("speaker_r"),
        F.col("start_ms").alias("start_ms_r"),
        F.col("end_ms").alias("end_ms_r"),
    )
    different = (F.col("turn_no") < F.col("turn_no_r")) & (F.col("speaker") != F.col("speaker_r"))
    pairs = interval_pairs(a, b, bin_ms=bin_ms, extra=different)
    start, end = F.greatest("start_ms", "start_ms_r"), F.least("end_ms", "end_ms_r")
    shorter = F.least(F.col("end_ms") - F.col("start_ms"), F.col("end_ms_r") - F.col("start_ms_r"))
    complete = (end - start) * 100 >= shorter * COMPLETE_SHARE_PERCENT
    return pairs.where(end > start).select(
        KEY,
        F.col("turn_no").alias("first_turn"),
        F.col("turn_no_r").alias("second_turn"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        (end - start).alias("duration_ms"),
        F.array("speaker", "speaker_r").alias("speakers"),
        F.when(complete, F.lit("complete")).otherwise(F.lit("partial")).alias("overlap_type"),
    )


_STRIP = "array<struct<first_turn:bigint,second_turn:bigint,start_ms:bigint,end_ms:bigint>>"


def _kept(rows: list[tuple], around: list[tuple], eps: int) -> list[tuple]:
    """The rows (first_turn, second_turn, start, end) that survive, in order, beside the kept rows ``around``.

    Kept rows lie in a grid of cells of ``eps``; a cell holds one of them at most, and only the
    nine cells around a row can hold one that is near.
    """
    grid: dict[tuple[int, int], tuple[int, int]] = {}
    out = []
    given = set(around)
    for row in sorted([*rows, *given]):
        start, end = row[2], row[3]
        x, y = start // eps, end // eps
        if row not in given and any(
            (k := grid.get((i, j))) is not None and abs(k[0] - start) < eps and abs(k[1] - end) < eps for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1)
        ):
            continue
        grid[x, y] = (start, end)
        if row not in given:
            out.append(row)
    return out


def _settle_slices(slices: DataFrame, keys: list[str], eps_ms: int) -> DataFrame:
    """(keys, slice, kept, low, high): what survives of each slice beside what its neighbours keep at the border.

    ``low`` and ``high`` are the kept rows within ``eps_ms`` of the slice's own borders.
    """

    names = ("first_turn", "second_turn", "start_ms", "end_ms")

    def tuples(scalar) -> list[tuple]:
        return list(zip(*[scalar.values.field(n).to_pylist() for n in names]))

    def settled(items, around, number):
        kept = _kept(tuples(items), tuples(around), eps_ms)
        begin, end = number.as_py() * SLICE_MS, (number.as_py() + 1) * SLICE_MS
        result = kept, [k for k in kept if k[2] < begin + eps_ms], [k for k in kept if k[2] > end - eps_ms]
        return result, 4 * sum(map(len, result))

    def assemble(done):
        parts = ("kept", "low", "high")
        return pa.StructArray.from_arrays([folds.row_lists(column, names) for column in zip(*done)], list(parts))

    settle_rows = folds.by_row(settled, assemble, f"struct<kept:{_STRIP},low:{_STRIP},high:{_STRIP}>")
    return slices.select(*keys, SLICE, settle_rows("items", "around", SLICE).alias("s")).select(*keys, SLICE, "s.*")


def dedupe_overlaps(overlaps: DataFrame, eps_ms: int = EPSILON_MS, by_speakers: bool = False) -> DataFrame:
    """Drop near-duplicates: both ends within ``eps_ms`` of an overlap kept before.

    Copies of the same span are first folded to the earliest; slices of five minutes are then settled
    at once, each by a walk over a grid of kept overlaps.  Only overlaps within ``eps_ms`` of a slice border
    can be decided by another slice: slices whose neighbours keep something there are settled anew
    until nothing changes at any border.  The rule has one consistent answer (it looks at earlier
    overlaps only), so that is the answer of the walk over the whole recording.  Rounds are as
    many as the slices that one unbroken chain of near overlaps decides, usually two.
    """
    keys = [KEY, "speakers"] if by_speakers else [KEY]
    order = F.struct("first_turn", "second_turn")
    value = F.struct("first_turn", "second_turn", "duration_ms", *([] if by_speakers else ["speakers"]), "overlap_type")
    single = (
        known(overlaps).groupBy(*keys, "start_ms", "end_ms")
        .agg(F.min_by(value, order).alias("v"))
        .select(*keys, "start_ms", "end_ms", "v.*")
    )
    single = settle(with_slice(single, "start_ms", SLICE_MS))
    number = ("first_turn", "second_turn", "start_ms", "end_ms")
    item = F.struct(*[F.col(c).cast("bigint").alias(c) for c in number])
    slices = single.groupBy(*keys, SLICE).agg(F.collect_list(item).alias("items"))
    none = F.array().cast(_STRIP)
    now = settle(_settle_slices(slices.withColumn("around", none), keys, eps_ms).withColumn("around", none))
    while True:
        # what each slice keeps at its borders, as its neighbours see it
        given = now.select(*keys, (F.col(SLICE) + 1).alias(SLICE), F.col("high").alias("strip")).unionAll(
            now.select(*keys, (F.col(SLICE) - 1).alias(SLICE), F.col("low").alias("strip"))
        )
        met = given.where(F.size("strip") > 0).groupBy(*keys, SLICE).agg(F.array_sort(F.flatten(F.collect_list("strip"))).alias("around"))
        beside_it = now.join(met.withColumnRenamed("around", "_around"), [*keys, SLICE], "left")
        around = F.coalesce("_around", none)
        stale = settle(beside_it.where(around != F.col("around")).select(*keys, SLICE, around.alias("around")))
        if stale.isEmpty():
            break
        again = settle(_settle_slices(slices.join(stale, [*keys, SLICE]), keys, eps_ms).join(stale, [*keys, SLICE]))
        rest = now.join(stale.select(*keys, SLICE), [*keys, SLICE], "left_anti")
        now = settle(rest.unionByName(again))
    kept = now.select(*keys, F.explode("kept").alias("k")).select(*keys, *[F.col(f"k.{c}").alias(c) for c in number])
    return single.join(kept, [*keys, *number], "left_semi").select(*overlaps.columns)


def assign_speakers(segments: DataFrame, diarization: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Label each segment with the turn that covers most of it; earlier turns win ties."""
    a = segments.select(KEY, "segment_id", "start_ms", "end_ms")
    b = diarization.select(
        KEY, "turn_no", "speaker", F.col("start_ms").alias("start_ms_r"), F.col("end_ms").alias("end_ms_r")
    )
    shared = overlap_ms("start_ms", "end_ms", "start_ms_r", "end_ms_r")
    best = (
        interval_pairs(a, b, bin_ms=bin_ms)
        .where((F.col("end_ms") > F.col("start_ms")) & (shared > 0))
        .groupBy(KEY, "segment_id")
        .agg(F.max_by("speaker", F.struct(shared, -F.col("turn_no"))).alias("speaker"))
    )
    return segments.join(best, [KEY, "segment_id"], "left")


def attach_overlaps(segments: DataFrame, overlaps: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Each segment with the overlaps that touch it, in order, and a flag."""
    a = segments.select(KEY, "segment_id", "start_ms", "end_ms")
    b = overlaps.select(
        KEY,
        "first_turn",
        "second_turn",
        F.col("start_ms").alias("start_ms_r"),
        F.col("end_ms").alias("end_ms_r"),
        "speakers",
        "overlap_type",
    )
    item = F.struct(
        "first_turn",
        "second_turn",
        F.col("start_ms_r").alias("start_ms"),
        F.col("end_ms_r").alias("end_ms"),
        "speakers",
        "overlap_type",
    )
    touching = (
        interval_pairs(a, b, bin_ms=bin_ms)
        .groupBy(KEY, "segment_id")
        .agg(F.array_sort(F.collect_list(item)).alias("overlaps"))
    )
    none = F.array().cast(touching.schema["overlaps"].dataType)
    return segments.join(touching, [KEY, "segment_id"], "left").withColumns(
        {"overlaps": F.coalesce("overlaps", none), "has_overlap": F.col("overlaps").isNotNull()}
    )


def label_segments(segments: DataFrame, diarization: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Segments with speaker, overlaps and overlap flag."""
    return attach_overlaps(assign_speakers(segments, diarization), overlaps)


def bucket_overlap_status(buckets: DataFrame, overlaps: DataFrame, diarization: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """(recording, bucket, speaker_overlap): overlap or single; no row where nobody diarized the recording."""
    spans = buckets.select(KEY, "bucket_index", "start_ms", "end_ms")
    b = overlaps.select(KEY, F.col("start_ms").alias("start_ms_r"), F.col("end_ms").alias("end_ms_r"))
    hit = interval_pairs(spans, b, bin_ms=bin_ms).groupBy(KEY, "bucket_index").agg(F.lit(True).alias("_hit"))
    ranges = spans.groupBy(KEY).agg(F.min("bucket_index").alias("_lo"), F.max("bucket_index").alias("_hi"))
    diarized = ranges.join(diarization.select(KEY).distinct(), KEY, "left_semi")
    return (
        with_facts(spans.select(KEY, "bucket_index"), diarized, "bucket_index", "_lo", "_hi", 4096)
        .join(hit, [KEY, "bucket_index"], "left")
        .select(
            KEY,
            "bucket_index",
            F.when(F.col("_hit"), F.lit("overlap")).otherwise(F.lit("single")).alias("speaker_overlap"),
        )
    )


def speaker_stats(diarization: DataFrame) -> DataFrame:
    """Speaking time per speaker; ``rank`` orders speakers by total time, longest first."""
    length = F.col("end_ms") - F.col("start_ms")
    per_speaker = diarization.groupBy(KEY, "speaker").agg(
        F.sum(length).alias("_total"),
        F.count(F.lit(1)).alias("segment_count"),
        F.max(length).alias("_max"),
        F.min(length).alias("_min"),
        F.max("end_ms").alias("_end"),
        F.min("turn_no").alias("_first_turn"),
    )
    # one row per speaker from here on, ranked in slices of speaking time
    ends = per_speaker.groupBy(KEY).agg(F.max("_end").alias("_last"))
    ranked = numbered(
        with_slice(per_speaker.withColumn("_less", -F.col("_total")), "_less", 600_000), ["_less", "_first_turn"], "rank", first=1
    )
    return ranked.join(ends, KEY).select(
        KEY,
        "speaker",
        (F.col("_total") / 1000.0).alias("total_duration"),
        "segment_count",
        (F.col("_total") / F.col("segment_count") / 1000.0).alias("average_segment_duration"),
        (F.col("_total") / F.col("_last") * 100).alias("speaking_percentage"),
        (F.col("_max") / 1000.0).alias("longest_segment"),
        (F.col("_min") / 1000.0).alias("shortest_segment"),
        "rank",
    )


def diarization_summary(diarization: DataFrame, overlaps: DataFrame) -> DataFrame:
    turns = diarization.groupBy(KEY).agg(
        F.max("end_ms").alias("_end"),
        F.countDistinct("speaker").alias("speaker_count"),
        F.count(F.lit(1)).alias("total_segments"),
    )
    both = overlaps.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.sum("duration_ms").alias("_ms"))
    ms = F.coalesce("_ms", F.lit(0))
    return turns.join(both, KEY, "left").select(
        KEY,
        (F.col("_end") / 1000.0).alias("total_duration"),
        "speaker_count",
        "total_segments",
        F.coalesce("_n", F.lit(0)).alias("total_overlaps"),
        (ms / 1000.0).alias("overlap_duration"),
        ratio(ms * 100.0, F.col("_end")).alias("overlap_percentage"),
    )


def speaker_transcripts(labelled: DataFrame, per_part: int = SEGMENTS_PER_PART) -> DataFrame:
    """Each speaker's text in numbered parts; joining the parts with a space gives the whole.

    Parts cover a fixed number of segment ids, so no row grows with the recording.
    """
    text = F.concat("text", F.when(F.col("has_overlap"), F.lit(" [OVERLAP]")).otherwise(F.lit("")))
    return (
        labelled.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))
        .groupBy(KEY, "speaker", F.expr(f"segment_id div {per_part}L").alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("start_ms", "segment_id", text.alias("t")))).alias("_t"))
        .select(KEY, "speaker", "part_no", F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("transcript"))
    )


def conversation_mode(labelled: DataFrame) -> DataFrame:
    """overlap, interruption (speaker change before the last one ended), dialogue or monologue."""
    rows = neighbour(
        with_slice(labelled.select(KEY, "segment_id", "speaker", "start_ms", "end_ms", "has_overlap"), "segment_id", 256),
        ["speaker", "end_ms"],
        ["segment_id"],
        "_before",
    )
    changed = F.col("_before").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_before.speaker"))
    mode = (
        F.when(F.col("has_overlap"), F.lit("overlap"))
        .when(changed & (F.col("start_ms") < F.col("_before.end_ms")), F.lit("interruption"))
        .when(changed, F.lit("dialogue"))
        .otherwise(F.lit("monologue"))
    )
    return rows.select(KEY, "segment_id", mode.alias("mode"))


def enrich_segments(segments: DataFrame, labelled: DataFrame, uncertainty: DataFrame) -> DataFrame:
    """Segments with speaker, overlap flag, uncertainty level and review flag, with defaults."""
    who = labelled.select(KEY, "segment_id", "speaker", "has_overlap")
    doubt = uncertainty.select(KEY, "segment_id", "uncertainty_level", "suggested_review")
    return (
        segments.join(who, [KEY, "segment_id"], "left")
        .join(doubt, [KEY, "segment_id"], "left")
        .withColumns(
            {
                "speaker": F.coalesce("speaker", F.lit("")),
                "has_overlap": F.coalesce("has_overlap", F.lit(False)),
                "uncertainty_level": F.coalesce("uncertainty_level", F.lit("medium")),
                "quality_flag": F.when(F.col("suggested_review"), F.lit("REVIEW_NEEDED")).otherwise(F.lit("")),
            }
        )
        .drop("suggested_review")
    )


def speaker_report(diarization: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Corpus form of the speaker analysis command: one row per recording."""
    s = diarization_summary(diarization, overlaps)
    return s.select(KEY, "speaker_count", "total_segments", "total_overlaps", "total_duration")
