"""State maps against plain loops, on random slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza import folds, planning
from cadenza.operators import buckets, chunks


def _words(rng, n):
    """Sorted starts with ends that may run ahead of later ones."""
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice([0, 50, 200, 400, 900, 3000, 9000])
        rows.append((at, at + rng.choice([20, 150, 300, 700, 2500, 12000])))
    return rows


def _close(words, span):
    out, start, no = [], words[0][0], 0
    for _, end in words:
        out.append((no, start))
        if end - start >= span:
            start, no = end, no + 1
    return out


def _split(words, near, far):
    out, start, no = [], words[0][0], 0
    for i, (begin, end) in enumerate(words):
        if i and near <= end - start <= far:
            start, no = begin, no + 1
        out.append((no, start))
    return out


def _cuts(rng, n):
    points = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 5)))) if n > 1 else []
    return list(zip([0, *points], [*points, n]))


def test_closing_maps_chain_to_the_loop():
    rng = random.Random(1)
    for _ in range(400):
        words = _words(rng, rng.randint(1, 60))
        state, got = None, []
        for a, b in _cuts(rng, len(words)):
            ends = np.array([e for _, e in words[a:b]])
            pieces = folds.closing_map(ends, 4000)
            entry = (words[0][0], 0, True) if state is None else state
            number, began, _ = folds.closing_walk(ends, *entry, 4000)
            got += list(zip(number.tolist(), began.tolist()))
            nxt, closes, fresh = folds.look_up(pieces, entry[0])
            state = (nxt, entry[1] + closes, fresh)
        assert got == _close(words, 4000)


def test_first_word_flags_survive_slice_borders():
    rng = random.Random(2)
    for _ in range(200):
        words = _words(rng, rng.randint(2, 40))
        whole = folds.closing_walk(np.array([e for _, e in words]), words[0][0], 0, True, 4000)[2].tolist()
        state, got = (words[0][0], 0, True), []
        for a, b in _cuts(rng, len(words)):
            ends = np.array([e for _, e in words[a:b]])
            got += folds.closing_walk(ends, *state, 4000)[2].tolist()
            nxt, closes, fresh = folds.look_up(folds.closing_map(ends, 4000), state[0])
            state = (nxt, state[1] + closes, fresh)
        assert got == whole


def test_splitting_maps_chain_to_the_loop():
    rng = random.Random(3)
    for _ in range(400):
        words = _words(rng, rng.randint(1, 60))
        state, got = None, []
        for a, b in _cuts(rng, len(words)):
            s, e = (np.array(x) for x in zip(*words[a:b]))
            cold = state is None
            entry = (words[0][0], 0) if cold else state
            number, began, _, after, splits = folds.splitting_walk(s, e, *entry, cold, 3750, 4250)
            got += list(zip(number.tolist(), began.tolist()))
            if not cold:
                nxt, closes, _ = folds.look_up(folds.splitting_map(s, e, 3750, 4250), entry[0])
                assert (nxt, entry[1] + closes) == (after, splits)
            state = (after, splits)
        assert got == _split(words, 3750, 4250)


def test_composition_is_application_in_turn():
    rng = random.Random(4)
    for _ in range(200):
        a = folds.closing_map(np.array([e for _, e in _words(rng, 12)]), 4000)
        s, e = (np.array(x) for x in zip(*_words(rng, 12)))
        b = folds.splitting_map(s, e, 3750, 4250)
        both = folds.compose(a, b)
        for state in [rng.randint(-5000, 60000) for _ in range(60)]:
            x, n, _ = folds.look_up(a, state)
            y, m, _ = folds.look_up(b, x)
            assert folds.look_up(both, state)[:2] == (y, n + m)


def _silences(rng, length):
    at, out = 0, []
    while at < length:
        at += rng.randint(500, 20_000)
        end = at + rng.choice([500, 700, 1501, 4000, 30_000])
        out.append((at, end))
        at = end + 1
    return [s for s in out if s[1] < length]


def _plan(silences, length, chunk, overlap, shortest):
    """The planner as a loop over one recording, in half milliseconds."""
    out, pos = [0], 0
    while pos < length:
        goal = pos + chunk
        if goal >= length - shortest:
            out.append(2 * length)
            break
        best = None
        for a, b in silences:
            if max(pos + shortest, goal - 5000) <= a <= min(goal + 5000, length):
                if best is None or abs(a + b - 2 * goal) < abs(best - 2 * goal):
                    best = a + b
        best = 2 * goal if best is None else best
        out.append(best)
        pos = best // 2 - overlap
    return out


def test_split_planner_matches_the_loop_for_any_slicing():
    rng = random.Random(5)
    for _ in range(120):
        length = rng.randint(1000, 400_000)
        sil = _silences(rng, length)
        s = np.array([a for a, _ in sil], np.int64)
        e = np.array([b for _, b in sil], np.int64)
        args = (s, e, length, 30_000, 5_000, 5_000)
        width = rng.choice([20_000, 60_000, 500_000])
        pos, number, got = 0, 0, [0]
        for k in range(length // width + 1):
            out, after, count = planning.split_walk(pos, number, (k + 1) * width, *args)
            if k:
                nxt, closes, _ = folds.look_up(planning.split_map(k * width, (k + 1) * width, *args), pos)
                assert (nxt, number + closes) == (after, count)
            got += [v for _, v in out]
            pos, number = after, count
        assert got == _plan(sil, length, 30_000, 5_000, 5_000)


def _breaks(silences, length, target, shortest):
    out, pos = [], 0
    while pos < length:
        goal = pos + target
        lo, hi = max(goal - 5000, pos), min(goal + 10_000, length)
        best, widest = goal, 0
        for a, b in silences:
            a, b = max(a, lo), min(b, hi)
            if b - a > widest:
                best, widest = a + (b - a) // 2, b - a
        stop = min(best if lo < hi else goal, length)
        if stop - pos >= shortest:
            out.append((pos, stop))
        pos = stop
    return out


def test_break_planner_matches_the_loop_for_any_slicing():
    rng = random.Random(6)
    for _ in range(60):
        length = rng.randint(1000, 300_000)
        sil = _silences(rng, length)
        s = np.array([a for a, _ in sil], np.int64)
        e = np.array([b for _, b in sil], np.int64)
        args = (s, e, length, 45_000, 10_000)
        width = rng.choice([30_000, 90_000, 400_000])
        pos, number, got = 0, 0, []
        for k in range(length // width + 1):
            out, after, count = planning.break_walk(pos, number, (k + 1) * width, *args)
            if k and pos < length:
                nxt, closes, _ = folds.look_up(planning.break_map(k * width, (k + 1) * width, *args), pos)
                assert (nxt, number + closes) == (after, count)
            got += [(a, b) for _, a, b in out]
            pos, number = after, count
        assert got == _breaks(sil, length, 45_000, 10_000)


def test_maps_of_very_many_words_in_one_slice():
    """A million words: maps and walks take seconds, also where starts are out of order."""
    import time

    rng = np.random.default_rng(5)
    starts = np.cumsum(rng.integers(0, 200, 1_000_000))
    ends = starts + rng.integers(20, 300, len(starts))
    begin = time.process_time()
    pieces = folds.splitting_map(starts, ends, 3750, 4250)
    number, _, _, state, splits = folds.splitting_walk(starts, ends, int(starts[0]), 0, False, 3750, 4250)
    assert folds.look_up(pieces, int(starts[0]))[:2] == (state, splits) and splits > 10_000
    pieces = folds.closing_map(ends, 4000)
    number, began, _ = folds.closing_walk(ends, int(starts[0]), 0, True, 4000)
    assert folds.look_up(pieces, int(starts[0]))[1] in (int(number[-1]), int(number[-1]) + 1)
    assert time.process_time() - begin < 40


def test_break_maps_are_right_for_every_entry():
    """Each millisecond at which a plan may enter, walked alone, with long, short, touching and equal silences."""
    rng = random.Random(8)
    for trial in range(25):
        length = rng.randint(20_000, 120_000)
        sil = _silences(rng, length)
        if trial % 3 == 0:
            sil = [(i * 4_000 + 500, i * 4_000 + rng.choice([1_500, 1_500, 3_900, 4_500])) for i in range(length // 4_000 - 1)]
            sil = [s for s in sil if s[1] < length]
        s, e = np.array([a for a, _ in sil], np.int64), np.array([b for _, b in sil], np.int64)
        target, shortest = rng.choice([(7_000, 3_000), (30_000, 10_000), (12_000, 2_000)])
        begin, end = rng.choice([(0, 30_000), (20_000, 60_000), (10_000, 500_000)])
        if begin >= length:
            continue
        pieces = planning.break_map(begin, end, s, e, length, target, shortest)
        entry = np.arange(begin, min(end, length, begin + target + planning.BREAK_AFTER_MS) + 1)
        pos, kept = entry.copy(), np.zeros(len(entry), np.int64)
        while (live := pos < min(end, length)).any():
            stop = planning.break_points(pos[live], s, e, length, target)
            kept[live] += stop - pos[live] >= shortest
            pos[live] = stop
        pos = np.where(pos >= length, planning.DONE, pos)
        got = [folds.look_up(pieces, int(p))[:2] for p in entry]
        assert got == list(zip(pos.tolist(), kept.tolist()))


def test_break_maps_follow_silences_not_milliseconds():
    import time

    rng = np.random.default_rng(9)
    s = np.cumsum(rng.integers(2_000, 8_000, 600))
    e = s + rng.integers(300, 1_500, 600)
    begin = time.process_time()
    sizes = [len(planning.break_map(k * 300_000, (k + 1) * 300_000, s, e, int(e[-1]) + 5_000, 60_000, 20_000)) for k in range(1, 8)]
    assert max(sizes) < 1_000 and time.process_time() - begin < 3


def test_slices_of_a_batch_are_handed_over_in_bounded_parts(spark):
    """A full batch of slices: neither maps nor cuts nor chains hold it whole as Python objects."""
    import tracemalloc

    import pyarrow as pa

    from cadenza.operators import buckets

    rng = np.random.default_rng(3)
    n, words = 3000, 300
    ends = np.cumsum(rng.integers(100, 900, (n, words)), axis=1)
    column = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words), pa.array(m.ravel()))
    e, s, zero = column(ends), column(ends - 90), pa.array(np.zeros(n, np.int64))
    no = pa.array(np.zeros(n, bool))
    for udf, args in (
        (buckets._closing_maps(4000), (e, zero)),
        (buckets._splitting_maps(3750, 4250), (s, e)),
        (buckets._closing_cuts(4000), (e, zero, zero, no)),
        (buckets._splitting_cuts(3750, 4250), (s, e, zero, zero, no)),
    ):
        rows = 0
        tracemalloc.start()
        for part in udf.func(iter([args])):
            assert part.nbytes < 16 << 20
            rows += len(part)
        assert rows == n and tracemalloc.get_traced_memory()[1] < 24 << 20
        tracemalloc.stop()


def test_one_position_as_many_at_once():
    rng = np.random.default_rng(5)
    for _ in range(200):
        cuts = np.sort(rng.choice(90_000, 2 * int(rng.integers(0, 12)), replace=False)).astype(np.int64)
        s, e, length = cuts[::2], cuts[1::2], int(rng.integers(1, 100_000))
        pos = rng.integers(0, 90_000, 20)
        split2, nxt, _ = planning.nearest_splits(pos, s, e, length, 12_000, 2_000, 3_000)
        one = [planning.nearest_split(int(p), s.tolist(), e.tolist(), length, 12_000, 2_000, 3_000) for p in pos]
        assert one == list(zip(split2.tolist(), nxt.tolist(), strict=True))
        whole = planning.break_points(pos, s, e, length, 20_000).tolist()
        assert [planning.break_point(int(p), s.tolist(), e.tolist(), length, 20_000) for p in pos] == whole


def test_plans_of_few_bytes_are_made_by_many_tasks(spark):
    durations = spark.range(200).select(F.col("id").alias("recording_id"), F.lit(100_000).cast("bigint").alias("duration_ms"))
    silences = durations.select("recording_id", F.lit(30_000).cast("bigint").alias("start_ms"), F.lit(31_000).cast("bigint").alias("end_ms"))
    points = chunks.silence_splits(durations, silences, 12_000, 2_000, 3_000, plan_ms=60_000).where("split_no > 0")
    assert points.select(F.spark_partition_id()).distinct().count() > 4


def test_rows_of_lists_keep_empty_ones():
    rows = folds.row_lists([[(1, 2)], [], [(3, 4), (5, 6)]], ("a", "b")).to_pylist()
    assert rows == [[{"a": 1, "b": 2}], [], [{"a": 3, "b": 4}, {"a": 5, "b": 6}]]


def test_slices_of_overlaps_settle_one_at_a_time(spark):
    from cadenza.operators import speakers

    item = "array<struct<first_turn:bigint,second_turn:bigint,start_ms:bigint,end_ms:bigint>>"
    rows = [(1, 0, [(0, 1, 10, 500), (0, 2, 60, 540), (1, 2, 299_950, 299_990)], []), (1, 1, [], []), (2, 0, [(3, 4, 0, 9)], [(1, 2, 5, 9)])]
    slices = spark.createDataFrame(rows, f"recording_id bigint, slice bigint, items {item}, around {item}")
    done = speakers._settle_slices(slices, ["recording_id"], 100)
    got = {(r.recording_id, r.slice): [[tuple(x) for x in part] for part in (r.kept, r.low, r.high)] for r in done.collect()}
    first, last = (0, 1, 10, 500), (1, 2, 299_950, 299_990)
    assert got == {(1, 0): [[first, last], [first], [last]], (1, 1): [[], [], []], (2, 0): [[], [], []]}


@pytest.mark.parametrize("cut", [buckets.bucket_slices, buckets.legacy_slices])
def test_words_are_cut_once(spark, cut):
    """The exploded array must not hold the UDF's result: Spark would also run it in a filter on the array's size."""
    word = "sort_ms:bigint,segment_id:bigint,pos:int,start_ms:bigint,end_ms:bigint,word:string,probability:double,timing_repaired:boolean,prev_end_ms:bigint"
    slices = spark.createDataFrame([], f"recording_id bigint, slice bigint, words array<struct<{word}>>")
    plan = cut(slices)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "ArrowEvalPython" in line and "entry" in line and ".state" in line]) == 1
