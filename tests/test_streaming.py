"""Streams run to completion on files must equal the batch result."""

import glob
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cadenza.operators import buckets
from cadenza.plans import queries as plans
from cadenza.streaming import streams


def _split(df, path, column, parts):
    """Write ``df`` as ``parts`` files, which a stream then reads in the order of ``column``."""
    df.repartitionByRange(parts, column).sortWithinPartitions(column).write.parquet(path)
    for i, file in enumerate(sorted(glob.glob(f"{path}/part-*"))):
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))


def _stream(spark, path, one_file=True):
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", 1) if one_file else reader).parquet(path)


def _finish(df, name, mode, tmp_path, **options):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ckpt-{name}")).options(**options).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_error_rate_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    _split(events, str(tmp_path / "e"), "ts", 4)
    is_error = F.col("event_type") == "error"
    got = _finish(streams.stream_error_rate(_stream(spark, str(tmp_path / "e")), is_error), "rates", "append", tmp_path)
    want = streams.stream_error_rate(events, is_error)
    last = got.agg(F.max("window_end")).first()[0]
    # windows past the final watermark stay open
    assert got.exceptAll(want).count() == 0
    assert want.where(F.col("window_end") <= F.lit(last)).exceptAll(got).count() == 0
    assert got.count() > 0.9 * want.count()


def test_transcript_windows_stream(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(1, base + timedelta(seconds=s), w) for s, w in [(0, "a"), (3, "b"), (4, "c"), (6, "d"), (60, "e"), (120, "f")]]
    df = spark.createDataFrame(rows, "recording_id bigint, ts timestamp, word string")
    _split(df, str(tmp_path / "w"), "ts", 2)
    got = _finish(streams.stream_transcript_windows(_stream(spark, str(tmp_path / "w"))), "texts", "append", tmp_path)
    assert [r.text for r in got.orderBy("window_start").collect()][:3] == ["a b c", "d", "e"]


def test_progress_counts_a_chunk_once(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(1, c, base + timedelta(seconds=i), s) for i, (c, s) in enumerate([(1, "success"), (2, "failed"), (1, "success"), (3, "success")])]
    df = spark.createDataFrame(rows, "job_id bigint, chunk_id bigint, ts timestamp, status string")
    _split(df, str(tmp_path / "p"), "ts", 2)
    got = _finish(streams.stream_progress(_stream(spark, str(tmp_path / "p"))), "progress", "complete", tmp_path)
    assert tuple(got.first()) == (1, 3, 2, 1)
    assert tuple(streams.stream_progress(df).first()) == (1, 3, 2, 1)


def test_sessions_and_log_counts_run_as_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    _split(events, str(tmp_path / "s"), "ts", 3)
    sessions = _finish(streams.stream_sessions(_stream(spark, str(tmp_path / "s")), "user_id", "6 hours"), "sessions", "append", tmp_path)
    assert sessions.exceptAll(streams.stream_sessions(events, "user_id", "6 hours")).count() == 0
    logs = _finish(
        streams.stream_log_counts(_stream(spark, str(tmp_path / "s")), F.col("event_type") == "error"), "logs", "append", tmp_path
    )
    assert logs.exceptAll(streams.stream_log_counts(events, F.col("event_type") == "error")).count() == 0
    assert logs.count() > 0


def test_sustained_alert_across_midnight(spark):
    base = datetime(2024, 1, 1, 23, 57)
    rates = [0.2, 0.2, 0.2, 0.2, 0.2, 0.2, 0.0, 0.2]
    rows = [(base + timedelta(minutes=i), r) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "window_start timestamp, rate double")
    got = [r.alert for r in streams.sustained(df).orderBy("window_start").collect()]
    assert got == [False, False, False, False, True, True, False, False]


def test_merge_sink_replaces_a_chunk(spark, tmp_path):
    schema = "recording_id bigint, chunk_id bigint, segment_id bigint, delivery bigint, text string"
    write = streams.overwrite_chunks(str(tmp_path / "m"))
    write(spark.createDataFrame([(1, 0, 0, 0, "old"), (1, 0, 5, 0, "stale"), (1, 1, 0, 0, "kept")], schema), 0)
    write(spark.createDataFrame([(1, 0, 0, 1, "new")], schema), 1)
    write(spark.createDataFrame([(1, 0, 1, 1, "more"), (1, 1, 1, 0, "second half")], schema), 2)
    write(spark.createDataFrame([(1, 0, 1, 1, "more"), (1, 1, 1, 0, "second half")], schema), 2)  # the batch runs again
    got = streams.delivered_chunks(spark, str(tmp_path / "m"))
    assert sorted(r.text for r in got.collect()) == ["kept", "more", "new", "second half"]


def test_compacted_micro_batches_stay_few(spark, tmp_path):
    schema = "recording_id bigint, chunk_id bigint, segment_id bigint, delivery bigint, text string"
    plain, few = str(tmp_path / "plain"), str(tmp_path / "few")
    keep, compact = streams.overwrite_chunks(plain), streams.overwrite_chunks(few, compact_every=4)
    for epoch in range(14):
        rows = [(1, c, s, epoch // 5, f"{epoch} {c} {s}") for c in range(epoch % 3, 3) for s in range(2)]
        batch = spark.createDataFrame(rows, schema).coalesce(1)
        keep(batch, epoch)
        compact(batch, epoch)
        if epoch == 5:
            early = streams.delivered_chunks(spark, few)  # planned before the next compaction, read after it
            want_early = sorted(map(tuple, streams.delivered_chunks(spark, plain).collect()))
        if epoch == 9:
            assert sorted(map(tuple, early.collect())) == want_early
    assert sorted(map(tuple, streams.delivered_chunks(spark, few).select("recording_id", "chunk_id", "segment_id", "delivery", "text").collect())) == sorted(
        map(tuple, streams.delivered_chunks(spark, plain).select("recording_id", "chunk_id", "segment_id", "delivery", "text").collect())
    )
    assert len(list((tmp_path / "few").glob("epoch=*"))) < 10 and len(list((tmp_path / "few-compacted").glob("upto=*"))) <= 2


def test_live_recording_emits_as_it_goes(spark, tmp_path):
    """Eight micro-batches of one uninterrupted recording and no row from the future."""
    base = datetime(2024, 1, 1)
    rows = [(1, base + timedelta(milliseconds=500 * i), 500 * i, i, 0, 500 * i, 500 * i + 400, f"w{i}") for i in range(480)]
    df = spark.createDataFrame(rows, "recording_id bigint, ts timestamp, sort_ms bigint, segment_id bigint, pos int, start_ms bigint, end_ms bigint, word string")
    _split(df, str(tmp_path / "l"), "ts", 8)
    got = _finish(streams.stream_bucketize(_stream(spark, str(tmp_path / "l"))), "live_buckets", "append", tmp_path).orderBy("bucket_index").collect()
    assert len(got) >= 45 and [r.bucket_index for r in got] == list(range(len(got)))
    assert " ".join(r.text for r in got).split() == [f"w{i}" for i in range(sum(r.word_count for r in got))]


def test_stateful_buckets_equal_batch(spark, small, tmp_path):
    clean = plans.Corpus(spark, small).clean.where("recording_id < 4")
    base = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    stamped = clean.withColumn("ts", F.timestamp_millis(F.unix_millis(base) + F.col("sort_ms")))
    late = stamped.withColumn("ts", F.timestamp_millis(F.unix_millis("ts") + F.lit(0)))
    end = stamped.orderBy("ts").limit(1).withColumns(
        {"ts": F.timestamp_millis(F.unix_millis(base) + F.lit(10**8)), "recording_id": F.lit(99).cast("bigint")}
    )
    after = end.withColumns({"ts": F.timestamp_millis(F.unix_millis("ts") + F.lit(10**8)), "recording_id": F.lit(98).cast("bigint")})
    _split(late.unionByName(end).unionByName(after), str(tmp_path / "b"), "ts", 6)
    got = _finish(streams.stream_bucketize(_stream(spark, str(tmp_path / "b"))), "open_buckets", "append", tmp_path)
    want = buckets.bucket_table(buckets.bucketize(clean)).select("recording_id", "bucket_index", "start_ms", "end_ms", "word_count", "text")
    assert got.where("recording_id < 4").exceptAll(want).count() == 0
    assert want.exceptAll(got).count() == 0


def test_latest_report_of_a_chunk_counts_in_the_stream(spark, tmp_path):
    base = datetime(2024, 1, 1)
    reports = [(1, 1, 0, "failed"), (1, 2, 1, "success"), (2, 1, 2, "success"), (1, 1, 3, "success"), (1, 2, 9, "failed"), (1, 2, 5, "success"), (1, 3, 6, "running"), (2, 1, 7, "success"), (1, 3, 8, "success")]
    rows = [(j, c, base + timedelta(seconds=s), status, i) for i, (j, c, s, status) in enumerate(reports)]
    df = spark.createDataFrame(rows, "job_id bigint, chunk_id bigint, ts timestamp, status string, i bigint")
    _split(df, str(tmp_path / "l"), "i", 3)  # in order of arrival, which is not that of time
    got = _finish(streams.stream_latest_progress(_stream(spark, str(tmp_path / "l"))), "latest", "update", tmp_path).collect()
    last = {r.job_id: tuple(r) for r in got}
    assert last == {r.job_id: tuple(r) for r in streams.stream_progress(df).collect()} == {1: (1, 3, 2, 1), 2: (2, 1, 1, 0)}


def test_sustained_alerts_of_the_stream_are_the_static_ones(spark, tmp_path):
    base = datetime(2024, 1, 1)
    # errors all along minutes 20 to 39, with a pause of all events in minutes 50 to 59
    rows = [(base + timedelta(minutes=m, seconds=s), "error" if 20 <= m < 40 and s < 30 else "ok") for m in range(80) if not 50 <= m < 60 for s in (0, 20, 40)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    _split(df, str(tmp_path / "a"), "ts", 4)
    is_error = F.col("kind") == "error"
    rates = streams.stream_error_rate(_stream(spark, str(tmp_path / "a")), is_error, mode="ratio")
    got = _finish(streams.stream_sustained(rates, 0.1), "alerts", "append", tmp_path)
    want = streams.sustained(streams.stream_error_rate(df, is_error, mode="ratio"), 0.1)
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() > 50
    assert 10 < got.where("alert").count() < 40


def test_bucket_state_is_called_by_block_and_not_by_second():
    """Ten minutes of one recording: a few state calls and one timer, whatever the number of seconds."""
    import pandas as pd

    calls = []

    class State(dict):
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("containsKey", "exists"):
                    return (args[0] if args else None) in self
                if name in ("getValue", "get"):
                    return dict.get(self, args[0] if args else None)
                if name == "keys":
                    return list(dict.keys(self))
                if name == "removeKey":
                    return self.pop(args[0])
                self[args[0] if len(args) > 1 else None] = args[-1]

            return call

        get = property(lambda self: self.__getattr__("get"))
        keys = property(lambda self: self.__getattr__("keys"))
        update = property(lambda self: self.__getattr__("update"))

    class Handle:
        getValueState = getMapState = staticmethod(lambda *_: State())  # noqa: N815
        registerTimer = staticmethod(lambda at: calls.append("timer"))  # noqa: N815

    class Mark:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)  # noqa: N815

    n = 1200
    rows = pd.DataFrame({"ts": pd.to_datetime([500 * i for i in range(n)], unit="ms"), "at_ms": [500 * i for i in range(n)], "sort_ms": [500 * i for i in range(n)], "segment_id": range(n), "pos": 0, "start_ms": [500 * i for i in range(n)], "end_ms": [500 * i + 400 for i in range(n)], "word": "w"})
    cutter = streams.BucketProcessor()
    cutter.init(Handle())
    list(cutter.handleInputRows((1,), iter([rows]), None))
    got = pd.concat(list(cutter.handleExpiredTimer((1,), Mark(), None)))
    assert got["word_count"].sum() == n and got["bucket_index"].tolist() == list(range(len(got)))
    assert len(calls) < 30 and calls.count("timer") == 1
