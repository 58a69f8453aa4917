"""Items of JSON documents of any layout, read in slices, against parsing them whole."""

import json
import random

import pytest

from cadenza.sources import documents, items

PATHS = [("segments",), ("transcription", "segments")]
TEXTS = ['a "q" }{ ][ \\', "plain é", 'x\\"}, {', "[{", '"segments": [{', "\\\\", "}"]


def segment(rng, i):
    words = [{"w": rng.choice(TEXTS), "p": [1, 2, {"z": 1}]} for _ in range(rng.randint(0, 3))]
    return {"id": i, "text": rng.choice(TEXTS) * rng.randint(1, 3), "words": words, "m": {"k": {"segments": [{"no": 1}]}}}


def written(folder, rng, count):
    """{file stem: (recording, segments)} of documents in many layouts."""
    want = {}
    other = {"a": {"segments": [{"bad": 1}]}, "tags": ["x", "]"], "other": [{"o": 1}], "e": []}
    for n in range(count):
        own = [segment(rng, i) for i in range(rng.randint(0, 7))]
        if n % 3 == 0:
            whole = {"recording_id": 500 + n, "metadata": other, "segments": own, "after": other}
        elif n % 3 == 1:
            whole = {"meta": other, "transcription": {"pre": [{"x": 2}], "n": {"y": 1}, "segments": own, "post": [{"x": 1}]}, "recording_id": 500 + n}
        else:
            whole = {"segments": own, "list": [[{"segments": [{"no": 2}]}]]}
        text = json.dumps(whole, indent=rng.choice([None, 2]), ensure_ascii=rng.choice([True, False])) + rng.choice(["", "\n", "\r\n \n"])
        (folder / f"{n}.json").write_text(rng.choice(["", "﻿"]) + text, encoding="utf-8")
        want[str(n)] = (500 + n if n % 3 < 2 else n, own)
    return want


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_items_whatever_the_slices(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(items, "SLICE_BYTES", size)
    want = written(tmp_path, random.Random(size), 24)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # files are split, too
    try:
        listed, whole = items.array_items(spark, str(tmp_path), PATHS)
        got = {}
        for r in sorted(listed.collect(), key=lambda r: (r.doc, r.item)):
            own = got.setdefault(r.doc.rpartition("/")[2][:-5], [])
            assert r.item == len(own)
            own.append((r.recording_id, json.loads(r.text)))
        facts = {r.doc.rpartition("/")[2][:-5]: r for r in whole.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, (recording, own) in want.items():
        assert got.get(name, []) == [(recording, s) for s in own]
        assert facts[name].balanced and facts[name].found and facts[name].recording_id == recording


def test_layouts_in_recording_folders(spark, tmp_path):
    own = [{"id": i, "start": float(i), "end": i + 0.5, "text": f"t {i}"} for i in range(4)]
    layouts = {1: json.dumps({"segments": own}, indent=2), 2: json.dumps({"segments": own}), 3: json.dumps({"transcription": {"segments": own}, "x": 1}, indent=1)}
    for n, text in layouts.items():
        (tmp_path / f"recording_id={n}").mkdir()
        (tmp_path / f"recording_id={n}" / "result.json").write_text(text)
    (tmp_path / "recording_id=4").mkdir()
    for part in range(2):  # two documents of one recording
        (tmp_path / "recording_id=4" / f"{part}.json").write_text(json.dumps({"segments": own[2 * part : 2 * part + 2]}, indent=2))
    rows = documents.read_segments(spark, str(tmp_path)).orderBy("recording_id", "segment_id").collect()
    assert [(r.recording_id, r.segment_id, r.text) for r in rows] == [(n, i, f"t {i}") for n in (1, 2, 3, 4) for i in range(4)]
    assert documents.unreadable(spark, str(tmp_path), "segments").count() == 0


def test_problems_are_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"segments": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "cut.json").write_text('{"segments": [{"id": 1}, {"id"')
    (tmp_path / "brace.json").write_text('{"segments": [{"id": 1}]')
    (tmp_path / "none.json").write_text('{"words": [{"id": 1}]}')
    (tmp_path / "item.json").write_text('{"segments": [{"id": 1}, {"id": nope}]}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "nothing.json").write_text('{"segments": []}')
    got = {r.path.rpartition("/")[2]: r.problem for r in documents.unreadable(spark, str(tmp_path), "segments").collect()}
    assert got.keys() == {"cut.json", "brace.json", "none.json", "item.json"}
    assert "item 1" in got["item.json"] and "segments" in got["none.json"] and got["cut.json"] == got["brace.json"]
    assert len(documents.read_segments(spark, str(tmp_path)).where("segment_id is not null").collect()) >= 4
