"""Silences and speech, chunk planning, and merging chunk results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import folds, planning
from cadenza.functions.columns import exact_mean, fixed, ratio, word_count
from cadenza.operators.intervals import BIN_MS, interval_pairs
from cadenza.timeline import KEY, SLICE, SLICE_MS, beside, carry, exact_percentiles, facts_per_block, known, neighbour, numbered, running, settle, with_facts, with_slice

MIN_SILENCE_MS = 1000
CHUNK_MS, OVERLAP_MS, MIN_CHUNK_MS = 30_000, 5_000, 5_000
VAD_TARGET_MS, VAD_OVERLAP_MS, VAD_MIN_MS = 45_000, 3_000, 10_000
PLAN_MS = 3_600_000
POINTS_PER_STEP = 4096
FRAMES_PER_SLICE = 30_000
CHUNKS_PER_SLICE = 256
TASKS_A_CORE = 4


# ---------------------------------------------------------------- speech and silence


def speech_from_words(clean: DataFrame, min_silence_ms: int = MIN_SILENCE_MS) -> DataFrame:
    """Stretches of cleaned words whose gaps stay below ``min_silence_ms``."""
    order = ["sort_ms", "segment_id", "pos"]
    gap = F.col("start_ms") - F.col("prev_end_ms")
    opens = (F.col("prev_end_ms").isNull() | (gap >= min_silence_ms)).cast("bigint")
    rows = clean.select(KEY, SLICE, *order, "start_ms", "end_ms", opens.alias("_opens"))
    runs = running(rows, F.col("_opens"), order, "_before").withColumn("run_no", F.col("_before") + F.col("_opens") - 1)
    return runs.groupBy(KEY, "run_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def silence_from_speech(speech: DataFrame, min_silence_ms: int = MIN_SILENCE_MS) -> DataFrame:
    """Silences between speech stretches that last at least half of ``min_silence_ms``."""
    rows = neighbour(
        with_slice(speech.select(KEY, "start_ms", "end_ms"), "start_ms", SLICE_MS),
        ["start_ms"],
        ["start_ms", "end_ms"],
        "_next",
        following=True,
    )
    end = F.col("_next.start_ms")
    return rows.where(end - F.col("end_ms") >= min_silence_ms // 2).select(
        KEY, F.col("end_ms").alias("start_ms"), end.alias("end_ms")
    )


def silences_with_edges(speech: DataFrame, durations: DataFrame) -> DataFrame:
    """Everything that is not speech, the recording's two ends included."""
    inner = silence_from_speech(speech, 2)
    ends = speech.groupBy(KEY).agg(F.min("start_ms").alias("_a"), F.max("end_ms").alias("_b"))
    edges = (
        durations.join(ends, KEY, "left")
        .select(
            KEY,
            F.explode(
                F.array(
                    F.struct(F.lit(0).cast("bigint").alias("start_ms"), F.coalesce("_a", "duration_ms").alias("end_ms")),
                    F.struct(F.coalesce("_b", "duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms")),
                )
            ).alias("s"),
        )
        .select(KEY, "s.*")
    )
    return inner.unionByName(edges).where(F.col("end_ms") > F.col("start_ms"))


def frame_slices(frames: DataFrame) -> DataFrame:
    """(recording_id, slice, frames): the frames of each slice in order; a frame has idx, energy, centroid."""
    rows = with_slice(frames.where("idx is not null"), "idx", FRAMES_PER_SLICE)
    return known(rows).groupBy(KEY, SLICE).agg(F.array_sort(F.collect_list(F.struct("idx", "energy", "centroid"))).alias("frames"))


def speech_runs(frames: DataFrame, hop_ms: int = 100, energy_pct: float = 0.30, centroid_pct: float = 0.40) -> DataFrame:
    """Runs of frames above the recording's own energy and centroid percentiles."""
    return speech_runs_sliced(frame_slices(frames), hop_ms, energy_pct, centroid_pct)


def speech_runs_sliced(slices: DataFrame, hop_ms: int = 100, energy_pct: float = 0.30, centroid_pct: float = 0.40) -> DataFrame:
    """``speech_runs`` of frames in slice layout (``frame_slices``).

    Frames never move by themselves: the limits come to the slices, and a slice hands on its runs.
    Only runs that touch a slice's border meet others.
    """
    # the plain explode would test the array's size in a filter, and so make the frames twice
    values = slices.select(KEY, F.explode_outer("frames").alias("f")).select(
        KEY, F.explode(F.array(F.struct(F.lit("e").alias("_of"), F.col("f.energy").alias("v")), F.struct(F.lit("c").alias("_of"), F.col("f.centroid").alias("v")))).alias("x")
    )
    points = exact_percentiles(values.select(KEY, "x.*"), "v", [energy_pct, centroid_pct], ["_e", "_c"], keys=(KEY, "_of"))
    limits = points.groupBy(KEY).agg(F.max(F.when(F.col("_of") == "e", F.col("_e"))).alias("_energy"), F.max(F.when(F.col("_of") == "c", F.col("_c"))).alias("_centroid"))
    span = slices.groupBy(KEY).agg(F.min(SLICE).alias("_lo"), F.max(SLICE).alias("_hi"))
    each = facts_per_block(limits.join(span, KEY), "_lo", "_hi", 1).withColumnRenamed("_at", SLICE)

    judged = F.transform("frames", lambda f: F.struct(f["idx"].alias("idx"), ((f["energy"] > F.col("_energy")) & (f["centroid"] > F.col("_centroid"))).alias("voiced")))
    marks = beside(slices, each, how="inner").select(KEY, SLICE, judged.alias("marks")).select(KEY, SLICE, F.filter("marks", lambda m: m["voiced"].isNotNull()).alias("marks"))
    voiced = lambda i: F.coalesce(F.get("marks", i)["voiced"], F.lit(False))
    first = F.filter("marks", lambda m, i: m["voiced"] & ~voiced(i - 1))
    last = F.filter("marks", lambda m, i: m["voiced"] & ~voiced(i + 1))
    found = marks.select(
        KEY,
        SLICE,
        F.zip_with(first, last, lambda a, b: F.struct(a["idx"].alias("first"), b["idx"].alias("last"))).alias("runs"),
        F.array_max(F.transform("marks", lambda m: F.when(~m["voiced"], m["idx"]))).alias("_quiet"),
        voiced(F.lit(0)).alias("_from_left"),
        voiced(F.size("marks") - 1).alias("_to_right"),
    )
    found = settle(found)
    runs = found.select(KEY, SLICE, "_quiet", "_from_left", "_to_right", F.size("runs").alias("_n"), F.posexplode("runs").alias("_i", "r"))
    left, right = F.col("_from_left") & (F.col("_i") == 0), F.col("_to_right") & (F.col("_i") == F.col("_n") - 1)
    within = runs.where(~left & ~right).select(KEY, F.col("r.first").alias("first"), F.col("r.last").alias("last"))
    carried = carry(found.select(KEY, SLICE, "_quiet"), "_quiet", "max", "_carried")
    edges = beside(runs.where(left | right).withColumn("_left", left), carried)
    before = F.when(F.col("_left"), F.col("_carried")).otherwise(F.col("_quiet"))
    met = edges.groupBy(KEY, F.coalesce(before, F.lit(-1)).alias("_run")).agg(F.min("r.first").alias("first"), F.max("r.last").alias("last"))
    return within.unionByName(met.drop("_run")).select(KEY, (F.col("first") * hop_ms).alias("start_ms"), ((F.col("last") + 1) * hop_ms).alias("end_ms"))


def silence_removal_plan(speech: DataFrame, durations: DataFrame, padding_ms: int = 100) -> DataFrame:
    """Kept stretches with their padding; padding applies to both sides or to none."""
    span = speech.groupBy(KEY).agg(F.min("start_ms").alias("_lo"), F.max("start_ms").alias("_hi"))
    rows = with_facts(speech, durations.join(span, KEY), "start_ms", "_lo", "_hi", PLAN_MS)
    pad = F.least(F.lit(padding_ms), F.col("start_ms"), F.col("duration_ms") - F.col("end_ms"))
    used = F.when(F.col("start_ms") > pad, pad).otherwise(F.lit(0))
    return rows.select(
        KEY, (F.col("start_ms") - used).alias("start_ms"), (F.col("end_ms") + used).alias("end_ms"), used.alias("padding_ms")
    )


def chunking_totals(plan: DataFrame, durations: DataFrame) -> DataFrame:
    """Silence removed and the share of audio kept, per recording."""
    kept = plan.groupBy(KEY).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_kept"))
    d = F.col("duration_ms")
    # with no speech at all the audio is left as it is
    removed = d - F.coalesce("_kept", d)
    return durations.join(kept, KEY, "left").select(
        KEY,
        (d / 1000.0).alias("total_duration"),
        (removed / 1000.0).alias("silence_removed"),
        ratio(d - removed, d).alias("compression_ratio"),
    )


# ---------------------------------------------------------------- split points


def _check(chunk_ms: int, overlap_ms: int) -> None:
    if chunk_ms <= overlap_ms:
        raise ValueError("chunk must be longer than overlap")


def row_range(durations: DataFrame, count, name: str) -> DataFrame:
    """Rows 0..count-1 per recording, generated in two steps so no array grows with the recording."""
    return (
        durations.withColumn("_n", count)
        .where("_n > 0")
        .withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {POINTS_PER_STEP}L"))))
        .withColumn(
            name,
            F.explode(
                F.sequence(
                    F.col("_p") * POINTS_PER_STEP,
                    F.least(F.col("_n"), (F.col("_p") + 1) * POINTS_PER_STEP) - 1,
                )
            ),
        )
        .drop("_p")
    )


def time_splits(durations: DataFrame, chunk_ms: int = CHUNK_MS, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """Split points every chunk - overlap, and the end of the recording."""
    _check(chunk_ms, overlap_ms)
    step = chunk_ms - overlap_ms
    points = F.ceil(F.col("duration_ms") / step).cast("bigint") + 1
    rows = row_range(durations, points, "split_no")
    at = F.when(F.col("split_no") == F.col("_n") - 1, F.col("duration_ms")).otherwise(F.col("split_no") * step)
    return rows.select(KEY, "split_no", (at / 1000.0).alias("split_s"), "duration_ms")


def stream_chunks(durations: DataFrame, chunk_ms: int = 5000, overlap_ms: int = 1000) -> DataFrame:
    """Fixed chunks with back-context; the first has none."""
    rows = row_range(durations, F.ceil(F.col("duration_ms") / chunk_ms).cast("bigint"), "_i")
    start = F.col("_i") * chunk_ms
    back = F.when(start > 0, F.lit(overlap_ms)).otherwise(F.lit(0))
    return rows.select(
        KEY,
        (start / 1000).cast("bigint").alias("chunk_id"),
        ((start - back) / 1000.0).alias("start_time"),
        ((start + chunk_ms) / 1000.0).alias("end_time"),
        ((chunk_ms + back) / 1000.0).alias("duration"),
        (start / 1000.0).alias("original_start"),
        ((start + chunk_ms) / 1000.0).alias("original_end"),
        (back / 1000.0).alias("overlap_prev"),
        F.lit(0.0).alias("overlap_next"),
    )


def _plan_rows(durations: DataFrame, silences: DataFrame, reach_ms: int, plan_ms: int) -> DataFrame:
    """(recording, slice, duration, silences a plan in this slice can look at)."""
    slices = row_range(durations, F.expr(f"duration_ms div {plan_ms}L") + 1, SLICE).drop("_n")
    first = F.greatest(F.lit(0), F.floor((F.col("start_ms") - reach_ms) / F.lit(plan_ms)) - 1)
    last = F.floor(F.col("end_ms") / F.lit(plan_ms))
    seen = (
        silences.withColumn(SLICE, F.explode(F.sequence(first, last)))
        .groupBy(KEY, SLICE)
        .agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms"))).alias("_s"))
    )
    rows = slices.join(seen, [KEY, SLICE], "left")
    part = lambda c: F.coalesce(F.transform("_s", lambda x: x[c]), F.array().cast("array<bigint>"))
    return rows.select(KEY, SLICE, "duration_ms", part("start_ms").alias("starts"), part("end_ms").alias("ends"))


def _planned(rows: DataFrame, plan_ms: int, make_map, walk, item: str) -> DataFrame:
    """Chain the slice maps, then walk every slice from its true entry."""

    names = [part.split(":")[0] for part in item[len("struct<") : -1].split(",")]

    def make(k, duration, starts, ends):
        i, d, s, e = k.as_py(), duration.as_py(), folds.numbers(starts), folds.numbers(ends)
        if i:
            return make_map(i * plan_ms, (i + 1) * plan_ms, s, e, d), (0, 0, False)
        # a plan always begins in slice 0, so that slice needs its cold result only
        _, pos, number = walk(0, 0, plan_ms, s, e, d)
        return folds.identity(), (pos, number, False)

    def steps_of(k, duration, starts, ends, state, closes):
        end = (k.as_py() + 1) * plan_ms
        out = walk(state.as_py(), closes.as_py(), end, folds.numbers(starts), folds.numbers(ends), duration.as_py())[0]
        return out, len(names) * len(out)

    mapped = folds.mapped(make)
    walked = folds.by_row(steps_of, lambda done: folds.row_lists(done, names), f"array<{item}>")
    # planning takes far longer than the bytes of its rows suggest, so their partitions are not merged
    rows = known(rows, [KEY, SLICE]).repartition(rows.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE, KEY, SLICE)
    args = [SLICE, "duration_ms", "starts", "ends"]
    entries = folds.slice_entries(rows.select(KEY, SLICE, mapped(*args).alias("m")).select(KEY, SLICE, "m.map", "m.cold"))
    entered = beside(rows, entries, how="inner")
    steps = walked(*args, F.coalesce("entry.state", F.lit(0)), F.coalesce("entry.closes", F.lit(0)))
    return entered.select(KEY, "duration_ms", F.explode(steps).alias("x")).select(KEY, "duration_ms", "x.*")


def silence_splits(
    durations: DataFrame,
    silences: DataFrame,
    chunk_ms: int = CHUNK_MS,
    overlap_ms: int = OVERLAP_MS,
    min_chunk_ms: int = MIN_CHUNK_MS,
    plan_ms: int = PLAN_MS,
) -> DataFrame:
    """Split points at the silence nearest to each target, within five seconds, else at the target."""
    _check(chunk_ms, overlap_ms)
    _check(max(min_chunk_ms, chunk_ms - planning.SEARCH_MS) + 1, overlap_ms)

    def make_map(begin, end, s, e, d):
        return planning.split_map(begin, end, s, e, d, chunk_ms, overlap_ms, min_chunk_ms)

    def walk(pos, number, end, s, e, d):
        return planning.split_walk(pos, number, end, s, e, d, chunk_ms, overlap_ms, min_chunk_ms)

    rows = _plan_rows(durations, silences, chunk_ms + planning.SEARCH_MS, plan_ms)
    points = _planned(rows, plan_ms, make_map, walk, "struct<split_no:bigint,split2:bigint>")
    begin = durations.select(KEY, "duration_ms", F.lit(0).cast("bigint").alias("split_no"), F.lit(0).cast("bigint").alias("split2"))
    return points.unionByName(begin).select(KEY, "split_no", (F.col("split2") / 2000.0).alias("split_s"), "duration_ms")


def build_chunks(
    splits: DataFrame, overlap_ms: int = OVERLAP_MS, min_chunk_ms: int = MIN_CHUNK_MS, stem: str = "chunk"
) -> DataFrame:
    """Chunks between consecutive split points, padded on both sides; short ones are dropped."""
    rows = neighbour(with_slice(splits, "split_no", POINTS_PER_STEP), ["split_s"], ["split_no"], "_next", following=True)
    rows = rows.where(F.col("_next").isNotNull())
    o, whole = overlap_ms / 1000.0, F.col("duration_ms") / 1000.0
    start, end = F.col("split_s"), F.col("_next.split_s")
    a, b = F.greatest(F.lit(0.0), start - o), F.least(whole, end + o)
    length_ms = F.floor(b * 1000) - F.floor(a * 1000)
    last = end >= whole
    return (
        rows.where(length_ms >= min_chunk_ms)
        .select(
            KEY,
            F.col("split_no").alias("chunk_id"),
            a.alias("start_time"),
            b.alias("end_time"),
            (b - a).alias("duration"),
            F.concat(
                F.format_string(f"{stem}_%03d_", "split_no"), fixed(start, 1), F.lit("s-"), fixed(end, 1), F.lit("s.wav")
            ).alias("file_path"),
            start.alias("original_start"),
            end.alias("original_end"),
            F.lit(True).alias("has_speech"),
            F.lit(1.0).alias("confidence"),
            F.when(F.col("split_no") > 0, start - a).otherwise(F.lit(0.0)).alias("overlap_prev"),
            F.when(~last, b - end).otherwise(F.lit(0.0)).alias("overlap_next"),
        )
    )


def vad_chunks(
    speech: DataFrame,
    durations: DataFrame,
    target_ms: int = VAD_TARGET_MS,
    overlap_ms: int = VAD_OVERLAP_MS,
    min_ms: int = VAD_MIN_MS,
    plan_ms: int = PLAN_MS,
    drop_tail: bool = True,
) -> DataFrame:
    """Chunks cut in the longest silence around each target end, with speech share and priority."""
    shortest = min_ms if drop_tail else 0

    def make_map(begin, end, s, e, d):
        return planning.break_map(begin, end, s, e, d, target_ms, shortest)

    def walk(pos, number, end, s, e, d):
        return planning.break_walk(pos, number, end, s, e, d, target_ms, shortest)

    rows = _plan_rows(durations, silences_with_edges(speech, durations), target_ms + planning.BREAK_AFTER_MS, plan_ms)
    plan = _planned(rows, plan_ms, make_map, walk, "struct<chunk_no:bigint,core_start:bigint,core_end:bigint>")
    talk = speech.select(KEY, F.col("start_ms").alias("start_ms_r"), F.col("end_ms").alias("end_ms_r"))
    heard = (
        interval_pairs(plan, talk, ("core_start", "core_end"), bin_ms=BIN_MS)
        .groupBy(KEY, "chunk_no")
        .agg(F.sum(F.least("core_end", "end_ms_r") - F.greatest("core_start", "start_ms_r")).alias("_talk"))
    )
    half = overlap_ms // 2
    share = F.coalesce("_talk", F.lit(0)) / (F.col("core_end") - F.col("core_start"))
    return (
        plan.join(heard, [KEY, "chunk_no"], "left")
        .withColumn("speech_ratio", share)
        .select(
            KEY,
            "chunk_no",
            F.format_string("chunk_%04d", "chunk_no").alias("chunk_name"),
            (F.greatest(F.lit(0), F.col("core_start") - half) / 1000.0).alias("start_time"),
            (F.least(F.col("duration_ms"), F.col("core_end") + half) / 1000.0).alias("end_time"),
            ((F.col("core_end") - F.col("core_start") + overlap_ms) / 1000.0).alias("duration"),
            (F.col("speech_ratio") > 0.1).alias("has_speech"),
            F.lit(half / 1000.0).alias("silence_padding"),
            F.floor(F.col("speech_ratio") * 100).cast("int").alias("priority"),
        )
    )


def prioritised(chunks: DataFrame) -> DataFrame:
    """Order of work per recording: most speech first, then by position."""
    # slices follow the order: by percentage, then by position, as most chunks share a few percentages
    rows = chunks.withColumn("_rank", -F.col("priority").cast("bigint")).withColumn(
        SLICE, F.expr(f"(_rank + 100) * {1 << 24}L + chunk_no div {CHUNKS_PER_SLICE}L")
    )
    return numbered(rows, ["_rank", "chunk_no"], "work_order").drop("_rank", SLICE)


# ---------------------------------------------------------------- chunk results


def union_chunk_results(*results: DataFrame) -> DataFrame:
    """Plain concatenation; ``chunk_id`` keeps the order."""
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole


def offset_segments(segments: DataFrame, chunks: DataFrame, anchor: str = "chunk_start") -> DataFrame:
    """Chunk-relative milliseconds to recording time.

    The audio of a chunk begins at its padded start; ``anchor="original_start"`` adds the
    unpadded start instead, which is late by the overlap.
    """
    column = {"chunk_start": "start_time", "original_start": "original_start"}[anchor]
    base = chunks.select(KEY, "chunk_id", F.round(F.col(column) * 1000).cast("bigint").alias("_base"))
    return (
        segments.join(base, [KEY, "chunk_id"])
        .withColumns({"start_ms": F.col("start_ms") + F.col("_base"), "end_ms": F.col("end_ms") + F.col("_base")})
        .drop("_base")
    )


def rescale_time(df: DataFrame, speed: float = 1.75, offset: str | None = None) -> DataFrame:
    """Times of sped-up audio back to the original scale: t * speed + offset, for words too."""
    base = F.col(offset) if offset else F.lit(0)
    scaled = lambda c: F.round(c * F.lit(float(speed))).cast("bigint") + base
    out = df.withColumns({"start_ms": scaled(F.col("start_ms")), "end_ms": scaled(F.col("end_ms"))})
    if "words" in df.columns:
        out = out.withColumn(
            "words",
            F.transform(
                "words",
                lambda w: w.withField("start_ms", scaled(w["start_ms"])).withField("end_ms", scaled(w["end_ms"])),
            ),
        )
    return out


def keep_core_segments(segments: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """Drop segments that start outside their chunk's core, so overlaps are not counted twice."""
    if chunks is None:
        return segments
    core = chunks.select(
        KEY,
        "chunk_id",
        F.round(F.col("original_start") * 1000).cast("bigint").alias("_a"),
        F.round(F.col("original_end") * 1000).cast("bigint").alias("_b"),
    )
    return (
        segments.join(core, [KEY, "chunk_id"])
        .where((F.col("start_ms") >= F.col("_a")) & (F.col("start_ms") < F.col("_b")))
        .drop("_a", "_b")
    )


def renumber(segments: DataFrame) -> DataFrame:
    """Dense segment ids across chunks, in chunk order."""
    return numbered(
        with_slice(segments.withColumnRenamed("segment_id", "chunk_segment_id"), "chunk_id", 64),
        ["chunk_id", "chunk_segment_id"],
        "segment_id",
    ).drop(SLICE)


def merge_chunks(segments: DataFrame, results: DataFrame, chunks: DataFrame, durations: DataFrame) -> DataFrame:
    """One merged result per recording, from absolute-time segments and per-chunk results."""
    core = keep_core_segments(segments, chunks)
    from_segments = core.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("segment_count"), exact_mean("avg_logprob").alias("_conf"), F.sum(word_count("text")).alias("word_count")
    )
    per_chunk = results.groupBy(KEY).agg(
        F.min_by("language", "chunk_id").alias("language"),
        exact_mean("language_probability").alias("language_probability"),
        F.sum("processing_time").alias("processing_time"),
        F.count(F.lit(1)).alias("chunk_count"),
    )
    return (
        per_chunk.join(from_segments, KEY, "left")
        .join(durations, KEY)
        .select(
            KEY,
            F.coalesce("segment_count", F.lit(0)).alias("segment_count"),
            "language",
            "language_probability",
            (F.col("duration_ms") / 1000.0).alias("duration"),
            F.coalesce("_conf", F.lit(-5.0)).alias("avg_confidence"),
            "processing_time",
            F.coalesce("word_count", F.lit(0)).alias("word_count"),
            "chunk_count",
        )
    )


def merged_text(segments: DataFrame, chunks: DataFrame, chunks_per_part: int = 64) -> DataFrame:
    """The merged text in numbered parts; joined with a space they give the whole."""
    item = F.struct("chunk_id", "segment_id", "text")
    return (
        keep_core_segments(segments, chunks)
        .groupBy(KEY, F.expr(f"chunk_id div {chunks_per_part}L").alias("part_no"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))
    )


def run_metrics(results: DataFrame, durations: DataFrame, words: DataFrame, wall_clock: DataFrame) -> DataFrame:
    """Speed and efficiency per recording; words per minute count the whole text."""
    per = results.groupBy(KEY).agg(
        F.sum("processing_time").alias("total_processing_time"),
        F.count(F.lit(1)).alias("chunks_processed"),
        exact_mean("duration").alias("avg_chunk_duration"),
        exact_mean("avg_confidence").alias("avg_confidence"),
        F.min("avg_confidence").alias("min_confidence"),
        F.max("avg_confidence").alias("max_confidence"),
    )
    audio, busy, wall = F.col("duration_ms") / 1000.0, F.col("total_processing_time"), F.col("wall_clock_time")
    return (
        per.join(durations, KEY)
        .join(words, KEY, "left")
        .join(wall_clock, KEY, "left")
        .select(
            KEY,
            audio.alias("total_audio_duration"),
            "total_processing_time",
            "wall_clock_time",
            ratio(audio, busy).alias("processing_speed"),
            "chunks_processed",
            (busy / F.col("chunks_processed")).alias("avg_chunk_processing_time"),
            "avg_chunk_duration",
            "avg_confidence",
            "min_confidence",
            "max_confidence",
            F.coalesce(ratio(busy, wall), F.lit(0.0)).alias("parallel_efficiency"),
            ratio(F.coalesce("word_count", F.lit(0)), audio / 60.0).alias("words_per_minute"),
        )
    )


def chunking_stats(chunks: DataFrame, durations: DataFrame, overlap_ms: int = OVERLAP_MS) -> DataFrame:
    """Chunk lengths, chunks per minute, overlap efficiency and core coverage per recording."""
    per = chunks.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        exact_mean("duration").alias("average_chunk_duration"),
        F.min("duration").alias("min_chunk_duration"),
        F.max("duration").alias("max_chunk_duration"),
        F.stddev_pop("duration").alias("std_chunk_duration"),
        F.sum(F.col("original_end") - F.col("original_start")).alias("_core"),
    )
    both = F.array("overlap_prev", "overlap_next")
    spread = (
        chunks.select(KEY, F.explode(both).alias("o")).where("o > 0").groupBy(KEY).agg(F.stddev_pop("o").alias("_std"))
    )
    efficiency = (
        F.when(F.col("total_chunks") < 2, F.lit(1.0))
        .when(F.col("_std").isNull(), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_std") / (overlap_ms / 1000.0))))
    )
    total = F.col("duration_ms") / 1000.0
    return (
        per.join(spread, KEY, "left")
        .join(durations, KEY)
        .select(
            KEY,
            "total_chunks",
            total.alias("total_duration"),
            "average_chunk_duration",
            "min_chunk_duration",
            "max_chunk_duration",
            "std_chunk_duration",
            (F.col("total_chunks") / (total / 60.0)).alias("chunks_per_minute"),
            efficiency.alias("overlap_efficiency"),
            (F.col("_core") / total).alias("core_coverage"),
        )
    )


def nearest_silence(targets: DataFrame, silences: DataFrame, reach_ms: int = 5000) -> DataFrame:
    """For each target the silence that starts within ``reach_ms`` and whose middle is nearest."""
    a = targets.withColumns({"_lo": F.col("target_ms") - reach_ms, "_hi": F.col("target_ms") + reach_ms + 1})
    b = silences.select(
        KEY,
        F.col("start_ms").alias("silence_start_ms"),
        F.col("end_ms").alias("silence_end_ms"),
        (F.col("start_ms") + 1).alias("_point"),
    )
    middle2 = F.col("silence_start_ms") + F.col("silence_end_ms")
    return (
        interval_pairs(a, b, ("_lo", "_hi"), ("silence_start_ms", "_point"))
        .groupBy(KEY, "target_ms")
        .agg(F.min_by(middle2, F.struct(F.abs(middle2 - 2 * F.col("target_ms")), "silence_start_ms")).alias("_m"))
        .select(KEY, "target_ms", (F.col("_m") / 2.0).alias("split_ms"))
    )
