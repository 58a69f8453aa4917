"""Hand-checkable cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import columns as c
from cadenza.operators import buckets, cadence, chunks, legacy, reprocess, speakers, uncertainty, warehouse, words
from cadenza.plans import fixtures, queries

W = "recording_id bigint, segment_id bigint, pos int, word string, start_ms bigint, end_ms bigint, probability double, timing_repaired boolean"


def make_words(spark, spans, recording=1):
    return spark.createDataFrame([(recording, 0, i, f"w{i}", a, b, 0.5, False) for i, (a, b) in enumerate(spans)], W)


def test_word_repair_and_overlap(spark):
    clean = words.clean_words(make_words(spark, [(1000, 1000), (2000, 3000), (2800, 3500), (-5, 10)]))
    rows = [(r.start_ms, r.end_ms, r.timing_repaired) for r in clean.orderBy("sort_ms").collect()]
    assert rows == [(1000, 1020, True), (2000, 3000, False), (3001, 3500, False)]


def test_gap_between_words(spark):
    clean = words.clean_words(make_words(spark, [(0, 500), (700, 1200)]))
    assert [r.gap_ms for r in words.word_gaps(clean).orderBy("sort_ms").collect()] == [None, 200]


def test_flatten_falls_back_to_the_text(spark):
    schema = (
        "recording_id bigint, segment_id bigint, start double, end double, text string, avg_logprob double, "
        "words array<struct<word:string,start:double,end:double,probability:double>>"
    )
    rows = [
        (1, 0, 0.0, 1.0, "Hello world", -0.2, [(" Hello ", 0.0, 0.5, 0.9), ("", 0.5, 0.6, 0.9), ("world", 0.6, 1.0, 0.8)]),
        (1, 1, 1.0, 2.0, "no words", -0.7, None),
    ]
    got = words.flatten_words(spark.createDataFrame(rows, schema)).orderBy("start_ms").collect()
    assert [(r.word, r.start_ms, r.probability) for r in got] == [("Hello", 0, 0.9), ("world", 600, 0.8), ("no words", 1000, -0.7)]


@pytest.mark.parametrize("slice_ms", [1500, 300_000])
def test_twenty_one_words(spark, slice_ms):
    w = make_words(spark, [(600 * i, 600 * i + 500) for i in range(21)])
    table = buckets.bucket_table(buckets.bucketize(w, slice_ms=slice_ms)).orderBy("bucket_index").collect()
    assert [(r.word_count, r.end_ms) for r in table] == [(7, 4100), (7, 8300), (7, 12500)]
    old = buckets.bucketize_legacy(w, slice_ms=slice_ms).groupBy("bucket_index").count().orderBy("bucket_index").collect()
    assert [r["count"] for r in old] == [6, 6, 6, 3]


def test_legacy_rule_may_never_split(spark):
    w = make_words(spark, [(900 * i, 900 * i + 800) for i in range(12)])
    assert buckets.bucketize_legacy(w).select("bucket_index").distinct().count() == 1
    sizes = buckets.bucket_table(buckets.bucketize(w)).orderBy("bucket_index").collect()
    assert [r.word_count for r in sizes] == [5, 5, 2]


def test_gap_statistics_of_three_words(spark):
    table = buckets.bucket_table(buckets.bucketize(make_words(spark, [(0, 500), (600, 1000), (1300, 1800)])))
    row = cadence.gap_stats(table).first()
    assert (row.gap_count, round(row.gap_mean, 6), round(row.gap_var, 6)) == (2, 0.2, 0.01)


def test_cadence_class(spark):
    kind = cadence.classify_cadence(F.lit(1), F.lit(0.2), F.lit(0.175), F.lit(0.025))
    assert spark.range(1).select(kind.alias("k")).first().k == "slow"


@pytest.mark.parametrize(
    "durations,expected",
    [([1, 1, 1, 3], [2, 2]), ([1], [1]), ([1, 3], [2]), ([3, 1], [1, 1]), ([1, 1, 1], [2, 1]), ([3, 1, 1, 1, 3, 1, 1], [1, 2, 2, 2])],
)
def test_merge_short_pairs(spark, durations, expected):
    at, rows = 0, []
    for i, d in enumerate(durations):
        rows.append((1, i, at, at + d * 1000, 1, f"b{i}"))
        at += d * 1000
    df = spark.createDataFrame(rows, "recording_id bigint, bucket_index bigint, start_ms bigint, end_ms bigint, word_count bigint, text string")
    got = buckets.merge_short(df, 2.0).orderBy("bucket_index").collect()
    assert [r.merged_from for r in got] == expected


def test_time_splits_and_chunks(spark):
    d = spark.createDataFrame([(1, 10_000)], "recording_id bigint, duration_ms bigint")
    splits = chunks.time_splits(d, 5000, 1000)
    assert [r.split_s for r in splits.orderBy("split_no").collect()] == [0.0, 4.0, 8.0, 10.0]
    built = chunks.build_chunks(splits, 1000, 5000).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.start_time, r.end_time) for r in built] == [(0, 0.0, 5.0), (1, 3.0, 9.0)]
    long = spark.createDataFrame([(1, 100_000)], "recording_id bigint, duration_ms bigint")
    assert [r.split_s for r in chunks.time_splits(long).orderBy("split_no").collect()] == [0.0, 25.0, 50.0, 75.0, 100.0]
    with pytest.raises(ValueError):
        chunks.time_splits(d, 1000, 1000)


def test_expand_context(spark):
    rows = [(1, 0, 25_000, 30_000), (1, 1, 30_000, 35_000), (1, 2, 35_000, 40_000)]
    df = spark.createDataFrame(rows, "recording_id bigint, segment_id bigint, start_ms bigint, end_ms bigint")
    r = reprocess.expand_context(df).where("segment_id = 1").first()
    assert (r.expanded_start_ms, r.expanded_end_ms, r.overlap_before_ms, r.overlap_after_ms) == (25_000, 40_000, 5000, 5000)


@pytest.mark.parametrize(
    "b,expected", [((9000, 12000), (9000, 10000, "partial")), ((4000, 6000), (4000, 6000, "complete")), ((10000, 11000), None)]
)
def test_overlap_of_two_turns(spark, b, expected):
    rows = [(1, 0, "A", 0, 10_000), (1, 1, "B", *b)]
    df = spark.createDataFrame(rows, "recording_id bigint, turn_no bigint, speaker string, start_ms bigint, end_ms bigint")
    got = [(r.start_ms, r.end_ms, r.overlap_type) for r in speakers.detect_overlaps(df, bin_ms=1000).collect()]
    assert got == ([expected] if expected else [])


def test_dedupe_keeps_the_first(spark):
    spans = [(0, 1000), (50, 1050), (120, 1120), (50, 1050), (5000, 6000), (5000, 9000), (0, 1000)]
    rows = [(1, i, i + 100, a, b, b - a, ["A", "B"], "partial") for i, (a, b) in enumerate(spans)]
    schema = (
        "recording_id bigint, first_turn bigint, second_turn bigint, start_ms bigint, end_ms bigint, duration_ms bigint, "
        "speakers array<string>, overlap_type string"
    )
    got = speakers.dedupe_overlaps(spark.createDataFrame(rows, schema)).orderBy("first_turn").collect()
    assert [r.first_turn for r in got] == [0, 2, 4, 5]


OVERLAP = (
    "recording_id bigint, first_turn bigint, second_turn bigint, start_ms bigint, end_ms bigint, duration_ms bigint, "
    "speakers array<string>, overlap_type string"
)


@pytest.mark.parametrize("seed", [1, 2])
def test_dedupe_across_slices_is_the_plain_walk(spark, seed):
    """Dense overlaps around slice borders, in an order that has nothing to do with time."""
    rng = random.Random(seed)
    rows = []
    for r in (1, 2):
        order = rng.sample(range(400), 400)
        for i in order:
            a = 300_000 * rng.randint(0, 3) + rng.randint(-600, 600)
            b = a + rng.choice([1000, 1060, 2000]) + rng.randint(0, 40)
            rows.append((r, i, i + rng.randint(1, 9), a, b, b - a, ["A", "B"], "partial"))
    want = set()
    for r in (1, 2):
        kept = []
        for x in sorted((x for x in rows if x[0] == r), key=lambda x: (x[1], x[2])):
            if all(abs(x[3] - k[3]) >= 100 or abs(x[4] - k[4]) >= 100 for k in kept):
                kept.append(x)
        want |= {x[:5] for x in kept}
    got = speakers.dedupe_overlaps(spark.createDataFrame(rows, OVERLAP))
    assert {tuple(r)[:5] for r in got.collect()} == want


def test_dedupe_of_one_long_chain(spark):
    """20,000 overlaps of one recording, 40 ms apart, across three slices: every third one stays."""
    i = F.col("id")
    chain = spark.range(20_000).select(
        F.lit(1).cast("bigint").alias("recording_id"), i.alias("first_turn"), (i + 1).alias("second_turn"), (i * 40).alias("start_ms"), (i * 40 + 500).alias("end_ms"),
        F.lit(500).cast("bigint").alias("duration_ms"), F.array(F.lit("A"), F.lit("B")).alias("speakers"), F.lit("partial").alias("overlap_type"),
    )
    got = speakers.dedupe_overlaps(chain).agg(F.count("*").alias("n"), F.max(F.col("first_turn") % 3).alias("m")).first()
    assert tuple(got) == (6_667, 0)


def test_uncertainty_levels_and_bins(spark):
    level = [
        spark.range(1).select(uncertainty.uncertainty_level(F.lit(x)).alias("l")).first().l for x in (-0.5, -1.5, -1.51)
    ]
    assert level == ["low", "medium", "high"]
    df = spark.createDataFrame([(1, 0.0), (1, 0.1)], "recording_id bigint, avg_logprob double")
    r = uncertainty.confidence_stats(df).first()
    assert (r.high_bin, r.high_confidence_count, r.median_confidence) == (1, 2, 0.05)


@pytest.mark.parametrize(
    "text,issues",
    [
        ("the the end", ["repetitive_text"]),
        ("", ["empty_text"]),
        ("well", ["very_short_segment"]),
        ("Wait... what", ["unusual_punctuation"]),
        ("the xkcdq word", ["incoherent_text"]),
        ("été été fini", ["repetitive_text"]),
        ("theme me then", []),
        ("un- able re-do pre-x", ["incomplete_words"]),
    ],
)
def test_text_issues(spark, text, issues):
    df = spark.createDataFrame([(text,)], "text string")
    got = uncertainty.text_indicators(df).first().text_issues
    assert [i for i in got if i != "excessive_fillers"] == issues


def test_times(spark):
    row = spark.range(1).select(
        c.srt_time(F.lit(1001)).alias("a"),
        c.srt_time(F.lit(3_661_500)).alias("b"),
        c.mmss(F.lit(6_100_000)).alias("m"),
        c.format_gaps(F.array(F.lit(200), F.lit(35)), 1).alias("g"),
        c.fixed(F.lit(21.95), 1).alias("f"),
        c.fixed(F.lit(1234567.125), 2).alias("t"),
    )
    assert tuple(row.first()) == ("00:00:01,001", "01:01:01,500", "101:40", "0.2000", "21.9", "1234567.12")


def test_exact_percentiles_of_a_skewed_key(spark):
    import numpy as np

    from cadenza.timeline import exact_percentiles

    values = [(1, int(v)) for v in np.random.default_rng(0).integers(0, 5000, 3000)] + [(2, 7)] * 2000 + [(3, 1)]
    got = exact_percentiles(spark.createDataFrame(values, "recording_id bigint, v bigint"), "v", [0.1, 0.5, 0.95], ["a", "b", "c"], 10.0)
    rows = {r.recording_id: (r.a, r.b, r.c) for r in got.collect()}
    ones = [v for k, v in values if k == 1]
    assert rows[1] == pytest.approx(tuple(np.percentile(ones, [10, 50, 95])))
    assert rows[2] == (7, 7, 7) and rows[3] == (1, 1, 1)


def test_search_and_severity_words(spark):
    df = spark.createDataFrame([(1, 0, "The cat, the hat"), (1, 1, "a cat")], "recording_id bigint, bucket_index bigint, text string")
    assert [(r.bucket_index, r.hits) for r in warehouse.search_text(df, "the CAT").collect()] == [(0, 3)]
    assert list(warehouse.SEVERITY.values()) == ["low", "medium", "high", "critical"]


def test_gap_lists_hold_every_gap(spark):
    w = make_words(spark, [(10_000 * i, 10_000 * i + 100) for i in range(50)])
    cut = buckets.bucketize_legacy(w, slice_ms=70_000)
    parts = legacy.gap_lists(cut).orderBy("part_no").collect()
    assert len(parts) > 1 and [g for r in parts for g in r.gaps_ms] == [9_900] * 49
    assert [r.gaps_ms for r in legacy.first_gaps(cut, 20).collect()] == [[9_900] * 20]
    assert legacy.timing_buckets(cut).first().word_gap_count == 49


def test_hot_recording_spreads_over_slices(spark):
    """Half the words in one recording: every shuffle key still holds one slice only."""
    w = make_words(spark, [(600 * i, 600 * i + 500) for i in range(4000)]).unionByName(make_words(spark, [(0, 10)], 2))
    per_slice = words.word_slices(w, 60_000).select(F.size("words").alias("n")).agg(F.max("n")).first()[0]
    assert per_slice <= 101
    table = buckets.bucket_table(buckets.bucketize_raw(w, slice_ms=60_000))
    assert table.agg(F.sum("word_count")).first()[0] == 4001


def test_dedupe_by_speakers_keeps_other_pairs(spark):
    rows = [(1, 0, 1, 0, 1000, 1000, ["A", "B"], "partial"), (1, 0, 2, 10, 1010, 1000, ["A", "C"], "partial"), (1, 3, 4, 20, 1020, 1000, ["A", "B"], "partial")]
    schema = (
        "recording_id bigint, first_turn bigint, second_turn bigint, start_ms bigint, end_ms bigint, duration_ms bigint, "
        "speakers array<string>, overlap_type string"
    )
    df = spark.createDataFrame(rows, schema)
    got = speakers.dedupe_overlaps(df, by_speakers=True).orderBy("second_turn").collect()
    assert [r.second_turn for r in got] == [1, 2]
    assert speakers.dedupe_overlaps(df).count() == 1


def test_fillers_as_substrings_or_words(spark):
    df = spark.createDataFrame([("there we are",), ("um er ah",)], "text string")
    loose = [r.indicators.filler_ratio for r in uncertainty.text_indicators(df).collect()]
    strict = [r.indicators.filler_ratio for r in uncertainty.text_indicators(df, whole_words=True).collect()]
    assert loose[0] > 0 and strict == [0.0, 1.0]


def test_rescale_reaches_into_words(spark):
    df = spark.createDataFrame(
        [(1, 400, 800, 10_000, [("a", 400, 800)])],
        "recording_id bigint, start_ms bigint, end_ms bigint, chunk_start bigint, words array<struct<word:string,start_ms:bigint,end_ms:bigint>>",
    )
    row = chunks.rescale_time(df, 1.75, "chunk_start").first()
    assert (row.start_ms, row.end_ms, row.words[0].start_ms, row.words[0].end_ms) == (10_700, 11_400, 10_700, 11_400)


def test_reprocessing_can_keep_the_better_score(spark):
    schema = "recording_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string, avg_logprob double, no_speech_prob double"
    old = spark.createDataFrame([(1, 0, 0, 1000, "a", -0.6, 0.1)], schema)
    new = spark.createDataFrame([(1, 0, 0, 1000, "b", -0.9, 0.1)], schema)
    assert reprocess.apply_reprocessed(old, new).first().text == "b"
    kept = reprocess.apply_reprocessed(old, new, only_if_better=True).first()
    assert (kept.text, kept.reprocessed, kept.original_confidence) == ("a", False, -0.6)


def test_white_space_is_unicode(spark):
    from cadenza.operators import uncertainty

    df = spark.createDataFrame([(0, "a\u00a0b\u2003c"), (1, "\n\t\u00a0"), (2, "\u3000x y\u2028")], "id int, text string")
    got = {r.id: r for r in uncertainty.text_indicators(df).collect()}
    assert [got[i].indicators.word_count for i in range(3)] == [3, 0, 2] and got[1].text_issues == ["empty_text"]


def test_hooks_call_batches_and_retry_rows(spark):
    from cadenza.operators import hooks

    def sizes(rows):
        if (rows["segment_id"] == 7).any():
            raise ValueError("bad")
        return rows.assign(size=len(rows))

    df = spark.range(20, numPartitions=1).select(F.lit(1).cast("bigint").alias("recording_id"), F.col("id").alias("segment_id"))
    got = hooks.map_chunks(df, sizes, "recording_id bigint, segment_id bigint, size bigint").collect()
    assert sorted(r.segment_id for r in got) == list(range(20)) and [r.segment_id for r in got if r.error] == [7]
    clean = hooks.map_chunks(df.where("segment_id <> 7"), sizes, "recording_id bigint, segment_id bigint, size bigint").collect()
    assert {r.size for r in clean} == {19}


def test_percentiles_of_real_values_in_relative_slices(spark):
    import numpy as np

    from cadenza import timeline

    rng = np.random.default_rng(1)
    values = [*rng.lognormal(0, 0.5, 900).tolist(), *(-rng.lognormal(0, 3, 80)).tolist(), *[0.0] * 20, 1e300, -1e-300]
    df = spark.createDataFrame([(1, float(v)) for v in values], "recording_id bigint, v double")
    got = timeline.exact_percentiles(df, "v", [0.01, 0.3, 0.5, 0.99], ["a", "b", "c", "d"]).first()
    assert np.allclose([got.a, got.b, got.c, got.d], np.percentile(values, [1, 30, 50, 99]))
    sizes = df.where("v > 0 and v < 1e9").groupBy(timeline.relative_slice(F.col("v")).alias("s")).count()
    assert sizes.agg(F.max("count")).first()[0] < 40


def test_average_confidence_does_not_depend_on_the_order_of_addition(spark):
    schema = "recording_id bigint, bucket_index bigint, start_ms bigint, end_ms bigint, word_count bigint, word_gap_count bigint, gap_sum bigint, gap_squares bigint, confidence_score double, cadence string, speaker_overlap string"
    rows = [(1, i, 0, 4000, 1, 0, 0, 0, v, "normal", "single") for i, v in enumerate([0.1, 0.2, 0.3] * 20)]
    df = spark.createDataFrame(rows, schema)
    got = {cadence.markdown_statistics(x.coalesce(1)).first().average_confidence for x in (df, df.orderBy("confidence_score"), df.orderBy(F.desc("confidence_score")))}
    assert got == {0.2}


# ---------------------------------------------------------------- speech runs


def test_speech_runs_over_slice_borders(spark, monkeypatch):
    """Runs over one, several and no borders of slices, missing frames and frames without a value."""
    monkeypatch.setattr(chunks, "FRAMES_PER_SLICE", 4)
    loud = {1: "0111111111101100", 2: "1111", 3: "01?1-101", 4: "0000000"}
    value = {"0": 0.0, "1": 5.0, "?": None}
    rows = [(k, i, value[x], value[x]) for k, line in loud.items() for i, x in enumerate(line) if x != "-"]
    frames = spark.createDataFrame(rows, "recording_id long, idx long, energy double, centroid double")
    got = chunks.speech_runs(frames, energy_pct=0.1, centroid_pct=0.1)
    # what has no value parts no run; a recording of one loudness has nothing above its percentiles
    want = [(1, 100, 1100), (1, 1200, 1400), (3, 100, 600), (3, 700, 800)]
    assert sorted((r.recording_id, r.start_ms, r.end_ms) for r in got.collect()) == want


def test_frames_are_not_shuffled(spark, small):
    """Words move as spans: no exchange of the query deals out or carries single frames."""
    corpus = queries.Corpus(spark, small)
    frames = fixtures.frames(corpus.clean, corpus.durations)
    plan = frames._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("idx" in line for line in exchanges)
    assert frames.groupBy("recording_id", "idx").count().where("count > 1").count() == 0
