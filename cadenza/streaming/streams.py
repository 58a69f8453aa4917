"""Structured Streaming forms.  All but ``stream_bucketize`` also run on static DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from cadenza.operators.chunks import keep_core_segments


def stream_transcript_windows(
    words: DataFrame, seconds: int = 5, delay: str = "10 seconds", back_context: bool = False, key: str = "recording_id"
) -> DataFrame:
    """Text and word count per ``seconds`` of each recording; empty windows do not appear.

    ``words`` has key, ts, word.  ``back_context`` adds the last second of the window before.
    """
    if back_context:
        window = F.window("ts", f"{seconds + 1} seconds", f"{seconds} seconds", f"{seconds - 1} seconds")
    else:
        window = F.window("ts", f"{seconds} seconds")
    return (
        words.withWatermark("ts", delay)
        .groupBy(key, window.alias("w"))
        .agg(
            F.count(F.lit(1)).alias("word_count"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "word"))), lambda x: x["word"]), " ").alias("text"),
        )
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "word_count", "text")
    )


def stream_progress(chunk_events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct chunks done and failed per job; of repeated reports of a chunk the latest counts (a stream: the first)."""
    chunk = ["job_id", "chunk_id"]
    if chunk_events.isStreaming:
        once = chunk_events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(chunk)
    else:
        latest = F.max_by("status", F.struct("ts", "status")).alias("status")
        once = chunk_events.groupBy(*chunk).agg(latest)
    return (
        once.groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("status") == "success").alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


def stream_error_rate(events: DataFrame, is_error: Column, delay: str = "10 minutes", mode: str = "per_second") -> DataFrame:
    """Error rate over five minutes, every minute.  ``mode`` is ``per_second`` or ``ratio``."""
    errors = F.count_if(is_error)
    value = errors / 300.0 if mode == "per_second" else errors / F.count(F.lit(1))
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"))
        .agg(errors.alias("errors"), F.count(F.lit(1)).alias("requests"), value.alias("rate"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors", "requests", "rate")
    )


def sustained(rates: DataFrame, threshold: float = 0.05, slides: int = 5) -> DataFrame:
    """Add ``alert``: the rate was over ``threshold`` in this window and the ``slides - 1`` before.

    Windows follow each other by a minute; a missing window had no events and ends the run.
    The rows are cut by day with the last minutes of the day before repeated, so the check
    never gathers the whole history.
    """
    reach = slides - 1
    own = rates.withColumn("_day", F.to_date("window_start")).withColumn("_own", F.lit(True))
    again = rates.withColumn("_day", F.to_date(F.col("window_start") + F.expr(f"interval {reach} minutes"))).withColumn(
        "_own", F.lit(False)
    )
    again = again.where(F.to_date("window_start") != F.col("_day"))
    minute = (F.unix_timestamp(F.col("window_start").cast("timestamp")) / 60).cast("bigint")
    w = Window.partitionBy("_day").orderBy("_minute").rangeBetween(-reach, 0)
    over = F.count_if(F.col("rate") > threshold).over(w)
    return (
        own.unionByName(again)
        .withColumn("_minute", minute)
        .withColumn("alert", over == slides)
        .where("_own")
        .drop("_day", "_own", "_minute")
    )


def stream_log_counts(logs: DataFrame, is_error: Column, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Log-based counters: requests and errors per window."""
    return (
        logs.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_error).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "requests", "errors")
    )


def stream_sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Stretches of activity per key, split where nothing happens for ``gap``."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")
    )


def stream_merge_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Core segments of chunks as they complete; row-local, so the output is append-only."""
    return keep_core_segments(segments, chunks)


def overwrite_chunks(path: str, compact_every: int | None = None):
    """``foreachBatch`` sink for ``delivered_chunks``: each micro-batch is kept under its number.

    A micro-batch that runs again replaces only itself; what earlier ones brought stays.  With
    ``compact_every`` the folders are put together after every so many micro-batches.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={int(epoch)}")
        if compact_every and epoch and epoch % compact_every == 0:
            compact_chunks(batch.sparkSession, path)

    return write


def _bases(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(last epoch, folder) of the compacted states beside ``path``, oldest first; only whole ones."""
    return sorted((int(f.rpartition("=")[2]), f) for f in _folders(spark, f"{path}-compacted", "upto=") if _exists(spark, f"{f}/_SUCCESS"))


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = _hadoop(spark, path)
    return files.exists(where)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    where, files = _hadoop(spark, path)
    return [f"{path}/{s.getPath().getName()}" for s in files.listStatus(where) if s.getPath().getName().startswith(prefix)] if files.exists(where) else []


def _kept_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``delivered_chunks`` with their micro-batch: the newest compacted state and what came after it."""
    bases = _bases(spark, path)
    rows = spark.read.option("basePath", path).parquet(path)
    if bases:
        upto, folder = bases[-1]
        rows = rows.where(F.col("epoch") > upto).unionByName(spark.read.parquet(folder), allowMissingColumns=True)
    key = ["recording_id", "chunk_id"]
    if "delivery" in rows.columns:
        newest = rows.groupBy(*key).agg(F.max("delivery").alias("delivery"))
        rows = rows.join(newest, [*key, "delivery"], "left_semi")
    last = Window.partitionBy(*key, "segment_id").orderBy(F.desc("epoch"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def compact_chunks(spark: SparkSession, path: str) -> None:
    """Put the micro-batches of ``overwrite_chunks`` together into one state beside ``path``.

    Readers use the newest whole state and the micro-batches after it.  What the state before this one held
    goes only now, so that a reader that began before is not disturbed; the number of folders stays
    below twice the micro-batches between two compactions, and two states.
    """
    bases = _bases(spark, path)
    upto = max(int(f.rpartition("=")[2]) for f in _folders(spark, path, "epoch="))
    if bases and bases[-1][0] >= upto:
        return
    _kept_chunks(spark, path).write.mode("overwrite").parquet(f"{path}-compacted/upto={upto}")
    if bases:
        gone = [f for f in _folders(spark, path, "epoch=") if int(f.rpartition("=")[2]) <= bases[-1][0]] + [f for _, f in bases[:-1]]
        for folder in gone:
            where, files = _hadoop(spark, folder)
            files.delete(where, True)


def delivered_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``overwrite_chunks`` has kept: of each chunk those of its newest delivery.

    Rows may carry ``delivery``, a number that grows when a chunk is sent again; a delivery may
    come in any number of micro-batches.  Within it (and without that column) a segment that
    comes again replaces its earlier row.
    """
    return _kept_chunks(spark, path).drop("epoch")


# ---------------------------------------------------------------- stateful buckets

BUCKETS = StructType(
    [
        StructField("recording_id", LongType()),
        StructField("bucket_index", LongType()),
        StructField("start_ms", LongType()),
        StructField("end_ms", LongType()),
        StructField("word_count", LongType()),
        StructField("text", StringType()),
    ]
)
_OPEN = "bucket_index long, start_ms long, end_ms long, last_ms long, words array<string>"
_HELD = "rows array<struct<slot:long,sort_ms:long,segment_id:long,pos:long,start_ms:long,end_ms:long,word:string>>"
SLOT_MS = 1000
SLOTS_PER_BLOCK = 300


class BucketProcessor(StatefulProcessor):
    """Closes a bucket once a word reaches the span; the watermark releases words in time order.

    Words wait in slots of a second until the watermark has passed the slot, so late arrivals
    within the delay still take their place; then the rule is the batch rule.  What waits is stored
    in blocks of five minutes and a recording has one timer at a time, for its first waiting slot, so
    the state store is called a few times per block and batch, not per second of speech.  Later words
    do not move the timer: a recording that never pauses is cut as it goes, and what waits spans no
    more than the delay.  The open bucket, which is bounded by the span, goes out when the recording
    has been silent for ``idle_ms`` of event time.
    """

    def __init__(self, bucket_ms: int = 4000, idle_ms: int = 60_000):
        self.bucket_ms, self.idle_ms = bucket_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.waiting = handle.getMapState("waiting", "block long", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        numbers = ["sort_ms", "segment_id", "pos", "start_ms", "end_ms"]
        first = None
        for batch in rows:
            slots = (batch["at_ms"] // SLOT_MS).tolist()
            new: dict[int, list[tuple]] = {}
            for row in zip(slots, *[batch[n].tolist() for n in numbers], batch["word"], strict=True):
                new.setdefault(row[0] // SLOTS_PER_BLOCK, []).append(row)
            for block, words in new.items():
                self.waiting.updateValue((block,), (self._held(block) + words,))
            first = min([*slots, *([] if first is None else [first])])
        if first is not None:
            self.handle.registerTimer((first + 1) * SLOT_MS)
        return iter(())

    def _held(self, block: int) -> list[tuple]:
        held = self.waiting.getValue((block,))
        return [tuple(r) for r in held[0]] if held else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        opened = self.open.get()
        no, start, end, heard, words = tuple(opened) if opened else (0, None, None, 0, [])
        words, out, later = list(words or []), [], None
        for block in sorted(int(k[0]) for k in self.waiting.keys()):
            if (block * SLOTS_PER_BLOCK + 1) * SLOT_MS > mark:  # not even its first slot is over
                later = min(r[0] for r in self._held(block))
                break
            held = sorted(self._held(block))
            ready = [r for r in held if (r[0] + 1) * SLOT_MS <= mark]
            for slot, _, _, _, first, last, word in ready:
                start = first if start is None else start
                words.append(word)
                end = last
                if last - start >= self.bucket_ms:
                    out.append((key[0], no, start, last, len(words), " ".join(words)))
                    no, start, words = no + 1, last, []
                heard = (slot + 1) * SLOT_MS
            if len(ready) < len(held):
                later = held[len(ready)][0]
                if ready:
                    self.waiting.updateValue((block,), (held[len(ready):],))
                break
            self.waiting.removeKey((block,))
        if later is not None:
            self.handle.registerTimer((later + 1) * SLOT_MS)
        elif words and heard + self.idle_ms > mark:
            self.handle.registerTimer(heard + self.idle_ms)
        elif words:
            out.append((key[0], no, start, end, len(words), " ".join(words)))
            no, start, words = no + 1, end, []
        self.open.update((no, start, end, heard, words))
        if out:
            yield pd.DataFrame(out, columns=BUCKETS.names)

    def close(self) -> None:
        pass


def stream_bucketize(words: DataFrame, bucket_ms: int = 4000, idle_ms: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """Streaming form of bucketing.  ``words``: recording_id, ts and the columns of cleaned words.

    Needs the RocksDB state store.  Words later than the delay are dropped.
    """
    slim = words.select("recording_id", "ts", F.unix_millis("ts").alias("at_ms"), "sort_ms", "segment_id", "pos", "start_ms", "end_ms", "word")
    return (
        slim.withWatermark("ts", delay)
        .groupBy("recording_id")
        .transformWithStateInPandas(
            statefulProcessor=BucketProcessor(bucket_ms, idle_ms),
            outputStructType=BUCKETS,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


PROGRESS = StructType([StructField("job_id", LongType()), StructField("processed", LongType()), StructField("succeeded", LongType()), StructField("failed", LongType())])


class ProgressProcessor(StatefulProcessor):
    """The newest report of every chunk of a job, and the job's counts, which follow its corrections.

    Chunks are entries of a map state, so that a job of any size is read and written by the chunks that
    report; counts change by the difference that a report makes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk_id long", "micros long, status string")
        self.counts = handle.getValueState("counts", "processed long, succeeded long, failed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple[int, str]] = {}
        for batch in rows:
            for chunk, ts, status in zip(batch["chunk_id"], batch["ts"], batch["status"], strict=True):
                report = (int(ts.value) // 1000, str(status))
                newest[int(chunk)] = max(report, newest.get(int(chunk), report))
        counts = dict(zip(("processed", "success", "failed"), map(int, self.counts.get()), strict=True)) if self.counts.exists() else dict.fromkeys(("processed", "success", "failed"), 0)
        for chunk, report in newest.items():
            if self.chunks.containsKey((chunk,)):
                old = tuple(self.chunks.getValue((chunk,)))
                if (int(old[0]), old[1]) >= report:
                    continue
                if old[1] in counts:
                    counts[old[1]] -= 1
            else:
                counts["processed"] += 1
            if report[1] in counts:
                counts[report[1]] += 1
            self.chunks.updateValue((chunk,), report)
        self.counts.update((counts["processed"], counts["success"], counts["failed"]))
        yield pd.DataFrame([(key[0], counts["processed"], counts["success"], counts["failed"])], columns=PROGRESS.names)

    def close(self) -> None:
        pass


def stream_latest_progress(chunk_events: DataFrame) -> DataFrame:
    """``stream_progress`` as a stream of corrections: of repeated reports of a chunk the latest counts.

    ``chunk_events`` has job_id, chunk_id, ts and status.  Each micro-batch gives the present counts of every
    job that it reports on (update mode); the last row of a job equals the static form.  Reports may come
    in any order.  Needs the RocksDB state store.
    """
    if not chunk_events.isStreaming:
        return stream_progress(chunk_events)
    rows = chunk_events.where("job_id is not null and chunk_id is not null and ts is not null and status is not null")
    return rows.select("job_id", "chunk_id", "ts", "status").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=ProgressProcessor(), outputStructType=PROGRESS, outputMode="Update", timeMode="None"
    )


ALERTS = StructType(
    [
        StructField("window_start", TimestampType()),
        StructField("window_end", TimestampType()),
        StructField("errors", LongType()),
        StructField("requests", LongType()),
        StructField("rate", DoubleType()),
        StructField("alert", BooleanType()),
    ]
)


class SustainedProcessor(StatefulProcessor):
    """Marks windows whose rate and those of the windows before, a minute apart, are all over the threshold."""

    def __init__(self, threshold: float, slides: int):
        self.threshold, self.slides = threshold, slides

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.over = handle.getValueState("over", "minutes array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows)).sort_values("window_start")  # closed windows, one a minute
        over = [int(m) for m in self.over.get()[0]] if self.over.exists() else []
        alerts = []
        for start, rate in zip(windows["window_start"], windows["rate"], strict=True):
            minute = int(start.timestamp()) // 60
            # a window that is missing had no events and ends the run
            over = [m for m in over if m > minute - self.slides] + ([minute] if rate > self.threshold else [])
            alerts.append(len(over) == self.slides)
        self.over.update((over,))
        yield windows.assign(alert=alerts)[ALERTS.names]

    def close(self) -> None:
        pass


def stream_sustained(rates: DataFrame, threshold: float = 0.05, slides: int = 5) -> DataFrame:
    """``sustained`` for the stream of ``stream_error_rate``: each window with ``alert`` as soon as it is closed.

    Windows arrive closed and in order of time; the state is the last ``slides`` minutes over the
    threshold.  Needs append mode and the RocksDB state store.
    """
    if not rates.isStreaming:
        return sustained(rates, threshold, slides)
    return rates.withColumn("all_windows", F.lit(0)).groupBy("all_windows").transformWithStateInPandas(
        statefulProcessor=SustainedProcessor(threshold, slides), outputStructType=ALERTS, outputMode="Append", timeMode="None"
    )
