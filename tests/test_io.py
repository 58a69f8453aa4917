"""Readers, writers, listing, hooks and warehouse tables."""

import json
from decimal import Decimal
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import hooks, warehouse
from cadenza.plans import queries as plans
from cadenza.sources import documents, items, media, render, writers

SEG = "recording_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string, avg_logprob double, no_speech_prob double"


def segments(spark):
    return spark.createDataFrame(
        [(1, 0, 0, 1500, "Hello", -0.2, 0.1), (1, 1, 30_000, 35_000, 'a "b", c', -1.2, 0.1), (2, 0, 0, 10, "x", -0.6, 0.0)], SEG
    )


def test_srt_of_a_reprocessed_segment(spark):
    rows = segments(spark).withColumn("reprocessed", F.col("start_ms") == 30_000)
    lines = render.to_srt(rows, "confidence").where("recording_id = 1").orderBy(*render.LINE_ORDER).collect()
    assert [r.line for r in lines][4:8] == ["2", "00:00:30,000 --> 00:00:35,000", 'a "b", c [ENHANCED]', ""]


def test_lines_on_disk_make_the_document(spark, tmp_path):
    facts = segments(spark).select("recording_id").distinct().withColumns({"language": F.lit("en"), "duration_ms": F.lit(35_000)})
    lines = render.segment_json(segments(spark), facts)
    writers.write_lines(lines, str(tmp_path / "json"), partitions=3)
    parts = sorted((tmp_path / "json" / "recording_id=1").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert [s["text"] for s in document["segments"]] == ["Hello", 'a "b", c']
    back = documents.parse_segments(writers.document_text(lines)).orderBy("recording_id", "segment_id").collect()
    assert [(r.start, r.text) for r in back] == [(0.0, "Hello"), (30.0, 'a "b", c'), (0.0, "x")]


def test_aliased_keys_are_normalised(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps(
            {"recording_id": 5, "segments": [{"end": 2.0, "text": "hi", "confidence": -0.9, "words": [{"text": "hi", "start": 0.0, "end": 1.0, "confidence": 0.4}]}, {}]},
            indent=2,
        )
    )
    rows = documents.read_segments(spark, str(tmp_path)).orderBy("segment_id").collect()
    assert (rows[0].start, rows[0].avg_logprob, rows[0].words[0].word, rows[0].words[0].probability) == (0.0, -0.9, "hi", 0.4)
    assert (rows[1].text, rows[1].end) == ("", 0.0)


def test_written_parts_are_read_back(spark, tmp_path):
    rows = spark.range(50).select(F.lit(1).cast("bigint").alias("recording_id"), F.col("id").alias("segment_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"))
    facts = rows.select("recording_id").distinct().withColumns({"language": F.lit("en"), "duration_ms": F.lit(50_000)})
    writers.write_lines(render.segment_json(rows, facts), str(tmp_path / "parts"), partitions=3)
    assert len(list((tmp_path / "parts" / "recording_id=1").glob("part-*"))) > 1
    back = documents.read_segments(spark, str(tmp_path / "parts")).orderBy("segment_id").collect()
    assert [(r.recording_id, r.segment_id, r.text) for r in back] == [(1, i, f"t {i}") for i in range(50)]


def test_documents_as_other_tools_write_them(spark, tmp_path):
    segment = {"start": 1.0, "end": 2.0, "text": "hi", "confidence": -0.3}
    (tmp_path / "17.json").write_text(json.dumps({"transcription": {"segments": [segment, segment]}, "metadata": {}}, indent=2))
    (tmp_path / "talk.json").write_text(json.dumps({"chunk_id": 3, "segments": [segment]}))
    (tmp_path / "broken.json").write_text('{"segments": [')
    rows = documents.read_segments(spark, str(tmp_path)).collect()
    assert sorted(r.segment_id for r in rows if r.recording_id == 17) == [0, 1] and len(rows) == 3
    assert all(r.recording_id is not None and r.avg_logprob == -0.3 for r in rows)
    assert [r.path.rpartition("/")[2] for r in documents.unreadable(spark, str(tmp_path)).collect()] == ["broken.json"]


def test_rttm_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "A", 0, 1234), (1, 1, "B", 1000, 2000)], "recording_id bigint, turn_no bigint, speaker string, start_ms bigint, end_ms bigint")
    writers.write_lines(render.to_rttm(turns), str(tmp_path / "r"))
    back = documents.read_rttm(spark, str(tmp_path / "r")).orderBy("start_ms").collect()
    assert [(r.stem, r.speaker, r.start_ms, r.end_ms) for r in back] == [("recording_1", "A", 0, 1234), ("recording_1", "B", 1000, 2000)]


def test_write_outputs_checks_formats(spark, tmp_path):
    rows = segments(spark)
    rendered = {"srt": render.to_srt(rows), "txt": render.to_txt(rows, "paragraph"), "csv": render.segment_csv(rows, False)}
    done = writers.write_outputs(rendered, str(tmp_path), ["srt", "csv"])
    assert set(done) == {"srt", "csv"}
    assert spark.read.option("header", True).option("escape", '"').csv(done["csv"]).where("segment_id = 1").first().text == 'a "b", c'
    with pytest.raises(ValueError):
        writers.write_outputs(rendered, str(tmp_path), ["pdf"])


def test_reports_validate_both_ways(spark, small):
    lines = render.to_bucket_markdown(plans.Corpus(spark, small).records).where("recording_id < 5")
    whole = documents.validate_report(writers.document_text(lines))
    by_line = documents.validate_report_lines(lines)
    columns = ["recording_id", "valid", "section_count", "file_size"]
    assert sorted(whole.select(columns).collect()) == sorted(by_line.select(columns).collect())
    assert whole.where("not valid").count() == 0


def test_reports_on_disk_validate(spark, small, tmp_path):
    lines = render.to_bucket_markdown(plans.Corpus(spark, small).records).where("recording_id < 4")
    writers.write_lines(lines, str(tmp_path / "reports"), partitions=5)
    (tmp_path / "reports" / "recording_id=77").mkdir()
    (tmp_path / "reports" / "recording_id=77" / "part-0.txt").write_text("no title\n# later\n")
    got = {int(r.path.rpartition("=")[2]): (r.valid, r.has_title, r.section_count, r.file_size) for r in documents.read_and_validate_report(spark, str(tmp_path / "reports")).collect()}
    want = {r.recording_id: (r.valid, r.has_title, r.section_count, r.file_size) for r in documents.validate_report_lines(lines).collect()}
    assert got == want | {77: (False, False, 0, 16)}


def test_scan_media(spark, tmp_path):
    for name in ("b.MP3", "a.wav", "sub/c.mp4", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert names(media.scan_media(spark, str(tmp_path))) == ["a.wav", "b.MP3", "c.mp4"]
    assert names(media.scan_media(spark, str(tmp_path), recursive=False)) == ["a.wav", "b.MP3"]
    assert names(media.scan_media(spark, str(tmp_path), pattern="*.mp3")) == ["b.MP3"]
    assert names(media.scan_media(spark, str(tmp_path), max_files=1)) == ["a.wav"]
    plan = media.scan_media(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    for name in ("_take.wav", ".old.mp3", "sub/_x/y.wav", "_SUCCESS"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xyz")
    assert names(media.scan_media(spark, str(tmp_path))) == [".old.mp3", "_take.wav", "a.wav", "b.MP3", "y.wav", "c.mp4"]
    assert names(media.scan_media(spark, str(tmp_path), recursive=False)) == [".old.mp3", "_take.wav", "a.wav", "b.MP3"]
    assert media.scan_media(spark, str(tmp_path), pattern="_take.wav"[-4:]).where("size_bytes = 3").count() == 2


def test_warehouse_round_trip(spark, tmp_path):
    row = [("j1", "b1", Decimal("1.500"), Decimal("5.250"), "t", 3, 2, Decimal("0.1"), Decimal("0.01"), Decimal("1"), Decimal("2"), Decimal("1"), Decimal("0.9"), False, True, "high")]
    from cadenza import schemas

    warehouse.write_table(spark.createDataFrame(row, schemas.TIMING_BUCKETS), str(tmp_path), "timing_buckets")
    assert warehouse.read_table(spark, str(tmp_path), "timing_buckets").first().duration == Decimal("3.750")


def test_index_finds_terms_and_phrases(spark, tmp_path):
    from cadenza.operators import search

    path = str(tmp_path / "index")
    rows = [(1, 0, "The cat saw the dog"), (1, 1, "a dog, the cat"), (2, 0, None), (2, 1, ""), (2, 2, "the the THE")]
    df = spark.createDataFrame(rows, "recording_id bigint, bucket_index bigint, text string")
    search.append_text(df.where("recording_id = 1"), path)
    search.append_text(df.where("recording_id = 2"), path)
    got = lambda *a: sorted(tuple(r) for r in search.search_index(spark, path, *a).collect())
    assert got("THE") == [(1, 0, 2), (1, 1, 1), (2, 2, 3)] and got("dog cat the") == [(1, 0, 4), (1, 1, 3)]
    assert got("the cat", True) == [(1, 0, 1), (1, 1, 1)] and got("the the", True) == [(2, 2, 2)] and got("dog cat", True) == []
    assert got("") == [] and got("zebra") == []
    want = sorted((r.recording_id, r.bucket_index, r.hits) for r in warehouse.search_text(df, "the dog").collect())
    assert got("the dog") == want
    plan = search.search_index(spark, path, "cat")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters")[1].split("]")[0] and "term" in plan.split("PushedFilters")[1].split("]")[0]


def test_packed_documents_are_few_files_and_read_back(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(6_000).select((i / 2).cast("bigint").alias("recording_id"), (i % 2).alias("segment_id"), (i % 2 * 1_000).alias("start_ms"), (i % 2 * 1_000 + 900).alias("end_ms"), F.concat(F.lit("t "), i.cast("string")).alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"))
    lines = render.to_srt(rows)
    writers.write_packed({"srt": lines}, str(tmp_path))
    assert 0 < len(list((tmp_path / "srt").glob("part-*"))) <= 8  # 3,000 recordings
    got = [r.line for r in writers.read_document(spark, str(tmp_path), "srt", 1_234).collect()]
    want = [r.line for r in lines.where("recording_id = 1234").orderBy(*render.LINE_ORDER).collect()]
    assert got == want and "t 2468" in got
    assert writers.read_packed(spark, str(tmp_path), "srt").exceptAll(lines.select("recording_id", *render.LINE_ORDER, "line")).count() == 0


def test_deliveries_replace_by_key_and_report_checks(spark, tmp_path):
    from cadenza import schemas

    def row(job, bucket, confidence="0.9", severity="low", words=3):
        return (job, bucket, Decimal("1.500"), Decimal("5.250"), "t", words, 2, Decimal("0.1"), Decimal("0.01"), Decimal("1"), Decimal("2"), Decimal("1"), Decimal(confidence), False, False, severity)

    def buckets(*rows):
        return spark.createDataFrame(list(rows), schemas.TIMING_BUCKETS)

    path, name = str(tmp_path), "timing_buckets"
    jobs = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "recording_id bigint, duration_ms bigint")
    parents = warehouse.to_transcription_jobs(jobs)
    assert warehouse.current_table(spark, path, name).count() == 0
    assert warehouse.deliver(buckets(), path, name).count() == 0 and warehouse.current_table(spark, path, name).count() == 0
    assert warehouse.deliver(buckets(row("1", "a"), row("1", "b"), row("2", "a")), path, name, parents).count() == 0
    # job 1 comes again with one bucket; job 3 breaks three rules; job 9 is unknown; a key comes twice
    bad = warehouse.deliver(buckets(row("1", "c", words=7), row("3", "x", "1.5"), row("3", "y", "0.5", "odd"), row("9", "a"), row("3", "z"), row("3", "z"), row("3", "ok")), path, name, parents)
    assert sorted((r.job_id, r.bucket_id, r.failed_check) for r in bad.collect()) == [("3", "x", "confidence"), ("3", "y", "cadence_severity"), ("3", "z", "unique"), ("9", "a", "reference")]
    now = warehouse.current_table(spark, path, name)
    assert sorted((r.job_id, r.bucket_id, r.word_count) for r in now.collect()) == [("1", "c", 7), ("2", "a", 3), ("3", "ok", 3)]
    assert now.first().duration == Decimal("3.750")
    folders = warehouse._manifest(spark, f"{path}/{name}")[1]
    assert len({f.rpartition("/")[0] for f in folders.values()}) > 1  # untouched parts stay where they are


def test_failures_become_rows(spark):
    def fn(row: pd.DataFrame, state) -> pd.DataFrame:
        if int(row["x"].iloc[0]) == 2:
            raise ValueError("bad")
        return row.assign(y=row["x"] * state)

    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "recording_id bigint, x bigint")
    out = hooks.map_chunks(df, fn, "recording_id bigint, x bigint, y bigint", setup=lambda: 10)
    rows = out.orderBy("x").collect()
    assert [(r.y, r.error) for r in rows] == [(10, None), (None, "ValueError: bad"), (30, None)]
    assert tuple(hooks.failure_counts(out).first()) == (1, 2, 1)


def test_stored_documents_lie_in_few_files_and_are_read_back(spark):
    n = 300
    rows = spark.range(3 * n).select((F.col("id") % n).alias("recording_id"), F.floor(F.col("id") / n).alias("segment_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), F.concat(F.lit('} "[{ ü '), F.col("id").cast("string")).alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"))
    facts = rows.select("recording_id").distinct().withColumns({"language": F.lit("en"), "duration_ms": F.lit(50_000)})
    path, name = plans.stored("segments", render.segment_json(rows, facts))
    assert len(list(Path(path).rglob("part-*"))) < n / 10
    back = documents.read_segments(spark, path, name).collect()
    want = {(i % n, i // n, '} "[{ ü ' + str(i)) for i in range(3 * n)}
    assert len(back) == 3 * n and {(r.recording_id, r.segment_id, r.text) for r in back} == want
    assert documents.unreadable(spark, path, name=name).count() == 0


def test_packed_documents_of_several_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(items, "SLICE_BYTES", 200)
    monkeypatch.setattr(items, "LINES", 4)
    rows = spark.range(100).select(F.lit(7).cast("bigint").alias("recording_id"), F.col("id").alias("segment_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"), F.repeat(F.lit("a } b "), (F.col("id") % 9).cast("int") * 20).alias("text"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"))
    facts = rows.select("recording_id").distinct().withColumns({"language": F.lit("en"), "duration_ms": F.lit(50_000)})
    writers.write_packed({"segments": render.segment_json(rows, facts)}, str(tmp_path))
    back = documents.read_segments(spark, str(tmp_path), "segments").orderBy("segment_id").collect()
    assert [(r.recording_id, r.segment_id, r.text) for r in back] == [(7, r.segment_id, r.text) for r in rows.orderBy("segment_id").collect()]


def test_stored_reports_lie_in_few_files_and_validate(spark):
    n = 200
    heads = spark.range(n).select(F.col("id").alias("recording_id"), F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("item"), F.lit(0).alias("sub"), F.when(F.col("id") == 7, F.lit("no title")).otherwise(F.lit("# Title")).alias("line"))
    rest = heads.withColumns({"section": F.lit(1), "line": F.lit("## Enhanced Transcript ## Analysis Summary cadence word_gaps")})
    path, name = plans.stored("report", heads.unionByName(rest))
    assert len(list(Path(path).rglob("part-*"))) < n / 10
    got = {r.recording_id: (r.has_title, r.valid) for r in documents.read_and_validate_packed(spark, path, name).collect()}
    assert got == {i: (i != 7, i != 7) for i in range(n)}
