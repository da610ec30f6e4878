import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklore.operators import edits, planning
from tracklore.sources import engines, sheets, subtitles


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,500 --> 00:00:03,000\r\n<i>Hi</i>\r\nthere\r\n\r\n2\r\n00:00:00,000 --> 00:00:01,000 X1:1\r\nFirst\r\n\r\n3\r\n00:00:05,000 --> 00:00:05,000\r\nno length\r\n\r\n4\r\n00:00:06,000 --> 00:00:07,000\r\n\r\n".encode())
    rows = subtitles.read_srt(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.start_s, r.end_s, r.text) for r in rows] == [(0, 0.0, 1.0, "First"), (1, 1.5, 3.0, "<i>Hi</i> there")]
    assert subtitles.read_srt(spark, str(tmp_path), keep_newlines=True).where("seq = 1").first().text == "<i>Hi</i>\nthere"


def test_ass(spark, tmp_path):
    (tmp_path / "a.ass").write_text("[Events]\nFormat: x\nComment: 0,0:00:00.00,0:00:09.00,D,,0,0,0,,no\nDialogue: 0,0:00:01.50,0:00:02.25,D,,0,0,0,,{\\i1}Well, hi\\Nyou\n")
    (r,) = subtitles.read_ass(spark, str(tmp_path)).collect()
    assert (r.start_s, r.end_s, r.text) == (1.5, 2.25, "Well, hi you")


def test_track_choice(spark):
    t = spark.createDataFrame([("a", "en-US", False), ("a", "en", True), ("b", "en-GB", True), ("b", "en-AU", True), ("c", "de", False)], "source string, code string, auto boolean")
    assert {(r.source, r.code) for r in subtitles.pick_track(t, "en").collect()} == {("a", "en-US"), ("b", "en-AU")}
    d = spark.createDataFrame([(1000.0,), (80.0,)], "d double")
    assert [r[0] is None for r in d.select(subtitles.preview_range(F.col("d"))).collect()] == [False, True]
    assert d.select(subtitles.worth_ranging(F.col("d"), F.lit(0.0), F.lit(60.0))).first()[0]


def test_sheets(spark, tmp_path):
    rows = spark.createDataFrame([(0.125, "a\tb"), (1.005, 'say "x"'), (2.675, "c")], "start_s double, text string")
    sheets.write_sheet(rows, str(tmp_path / "o"), "start", "text")
    back = {r.start_ms: r.new_text for r in sheets.read_texts(spark, str(tmp_path / "o"), "text").collect()}
    assert back == {120: "a\tb", 1000: 'say "x"', 2670: "c"}
    (tmp_path / "cast.tsv").write_text("idx\tstart\tspeaker\tvoice\ttext\n0\t1.00\tS01\taf\tx\n1\t1.00\tS02\t\tx\n2\tbad\tS03\t\tx\n")
    assert [tuple(r)[:3] for r in sheets.read_cast(spark, str(tmp_path / "cast.tsv")).collect()] == [(1000, "S02", "")]
    (tmp_path / "bad.tsv").write_text("idx\tstart\tspeaker\tvoice\ttext\n0\t1.00\t-x\taf\tx\n")
    with pytest.raises(Exception, match="bad speaker label"):
        sheets.read_cast(spark, str(tmp_path / "bad.tsv")).collect()


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join([json.dumps({"start_s": 1.0, "text": "a"}), json.dumps({"text": "b"}), "{broken", json.dumps({"start_s": 2.0, "text": ""}), json.dumps({"start": 1.001, "text": "c"})]))
    assert [tuple(r) for r in sheets.read_previous(spark, str(tmp_path / "r.json")).collect()] == [("1.00", "c")]
    # an array, as a run writes it
    (tmp_path / "render.json").write_text(json.dumps([{"start": 1.005, "end": 2.0, "text": "x"}, {"start": 2.675, "text": "y"}, {"start": None, "text": "z"}, {"start": 9.0, "text": None}], indent=1))
    assert {tuple(r) for r in sheets.read_previous(spark, str(tmp_path / "render.json")).collect()} == {("1.00", "x"), ("2.67", "y")}
    (tmp_path / "broken.json").write_text("[{")
    assert sheets.read_previous(spark, str(tmp_path / "broken.json")).count() == sheets.read_previous(spark, str(tmp_path / "none.json")).count() == 0


def test_round_trip_of_an_earlier_run(spark, tmp_path):
    rows = [(k, i, i + 0.005, i + 0.9, f"line {k} {i}\nnext") for k in (1, 2) for i in range(5)]
    cues = spark.createDataFrame(rows, "track_id long, idx long, start_s double, end_s double, text string").withColumn("audio", F.lit("big"))
    sheets.write_records(cues, str(tmp_path / "runs"))
    assert "big" not in "".join(f.read_text() for f in (tmp_path / "runs").rglob("*.txt"))
    now = cues.drop("audio").withColumn("text", F.lit("?")).unionByName(spark.createDataFrame([(1, 9, 77.0, 78.0, "new")], "track_id long, idx long, start_s double, end_s double, text string"))
    got = {(r.track_id, r.idx): (r.text, r.matched, r.changed) for r in sheets.apply_previous(now, sheets.read_previous(spark, str(tmp_path / "runs"))).collect()}
    assert got == {(k, i): (t, True, True) for k, i, _, _, t in rows} | {(1, 9): ("new", False, False)}


def test_sheets_meet_cues_by_two_decimals(spark, tmp_path):
    cues = spark.createDataFrame([(1, 0, 1.234, 1234, "a"), (1, 1, 2.675, 2675, "b"), (1, 2, 9.0, 9000, "c")], "track_id long, idx long, start_s double, start_ms long, text string")
    sheets.write_sheet(cues.where("idx < 2").withColumn("new", F.upper("text")), str(tmp_path / "t"), "start", "new")
    sheet = sheets.for_cues(sheets.read_texts(spark, str(tmp_path / "t"), "new"), cues)
    got = edits.apply_texts(cues, sheet.drop("file")).orderBy("idx").collect()
    assert [(r.text, r.matched) for r in got] == [("A", True), ("B", True), ("c", False)]


def test_sheets_of_several_tracks(spark, tmp_path):
    for k in "ab":
        (tmp_path / f"{k}.tsv").write_text(f"start\ttext\n1.00\told\n1.00\t{k}\n")
    got = {(r.file[-5:], r.new_text) for r in sheets.read_texts(spark, str(tmp_path), "text").collect()}
    assert got == {("a.tsv", "a"), ("b.tsv", "b")}


def test_engines(spark):
    lines = spark.createDataFrame([(1, 0, "x" * 126, "v", 1.0), (1, 1, "x" * 126, "v", 2.0)], "track_id long, idx long, text string, voice string, speed double")
    got = engines.spoken(lines, engines.SilentRenderer).orderBy("idx").collect()
    assert [(r.rendered_dur, len(r.samples), r.rate, r.error) for r in got] == [(10.0, 1000, 100, None), (5.0, 500, 100, None)] and got[0].clip_key != got[1].clip_key

    class Picky(engines.SilentRenderer):
        def render(self, batch):
            if (batch["speed"] > 1.5).any():
                raise OSError("no")
            return super().render(batch)

    # a batch that fails is rendered line by line
    got = engines.spoken(lines, Picky).orderBy("idx").collect()
    assert got[0].rendered_dur == 10.0 and got[1].samples is None and "no" in got[1].error
    prompts = spark.createDataFrame([("ab",)], "prompt string")
    assert engines.asked(prompts, engines.EchoChat).first().reply == "ba"
    assert {r.voice for r in engines.unknown(spark.createDataFrame([("af_stub",), ("zz",)], "voice string"), engines.SilentRenderer()).collect()} == {"zz"}


def test_conversion(spark):
    class Louder(engines.Converter):
        def convert(self, samples, rate, reference):
            if reference == "bad":
                raise ValueError("bad clip")
            return samples * 2

    clips = spark.createDataFrame([(1, 0, [0.5, 1.0], 100, "a.wav"), (1, 1, [0.5], 100, None), (1, 2, [0.5], 100, "bad"), (1, 3, None, 100, "a.wav")], "track_id long, idx long, samples array<float>, rate int, reference string")
    got = engines.converted(clips, Louder).orderBy("idx").collect()
    assert [r.samples for r in got] == [[1.0, 2.0], [0.5], [0.5], None] and [r.error is None for r in got] == [True, True, False, True]


def test_watched_model_is_started_again():
    class Slow(engines.SilentRenderer):
        def render(self, batch):
            if "hang" in batch["text"].iloc[0]:
                time.sleep(60)
            if "die" in batch["text"].iloc[0]:
                os._exit(3)
            if "fail" in batch["text"].iloc[0]:
                raise ValueError("this line")
            return super().render(batch)

    batch = lambda t: pd.DataFrame({"text": [t], "voice": ["v"], "speed": [1.0], "emotion": [0.5]})
    model = engines.Watched(Slow, seconds=1.0, restarts=2)
    assert len(model.render(batch("x" * 126))[0]) == 1000
    for text, why in (("hang", "stopped"), ("fail", "this line"), ("die", "stopped")):
        with pytest.raises(RuntimeError, match=why):
            model.render(batch(text))
        assert len(model.render(batch("x" * 126))[0]) == 1000
    for _ in range(3):
        with pytest.raises(RuntimeError, match="stopped"):
            model.render(batch("die"))
    with pytest.raises(RuntimeError, match="too often"):
        model.render(batch("x"))


def test_numbered_batches(spark):
    class Upper(engines.ChatEngine):
        def ask(self, prompt):
            rows = prompt.split("Lines:\n")[1].split("\n")
            return "\n".join(r.upper() for r in rows if "skip" not in r)

    lines = spark.createDataFrame([(k, i, f"line  {i}" + (" skip" if i == 4 else "")) for k in (1, 2) for i in range(7)], "track_id long, idx long, text string")
    prompts = engines.numbered_prompts(lines, "Translate:", 3).where("track_id = 1 and batch = 1").first()
    assert prompts.prompt == "Translate:\nAround them:\n- line 0\n- line 1\n- line 2\n- line 6\nLines:\n1. line 3\n2. line 4 skip\n3. line 5" and prompts.idxs == [3, 4, 5]
    known = lines.selectExpr("*", "if(idx = 2, 'zwei', null) as translated", "12 as limit")
    prompt = engines.numbered_prompts(known, "T", 3, 1).where("track_id = 2 and batch = 1").first().prompt
    assert prompt == "T\nAround them:\n- zwei\n- line 6\nLines:\n1. (at most 12) line 3\n2. (at most 12) line 4 skip\n3. (at most 12) line 5"
    got = {(r.track_id, r.idx): r.reply for r in engines.asked_in_batches(lines, Upper, "Translate:", 3).collect()}
    assert got == {(k, i): None if i == 4 else f"LINE {i}" for k in (1, 2) for i in range(7)}


def test_manifest_and_records_of_a_run(spark, tmp_path):
    path = str(tmp_path / "manifest")
    first = spark.createDataFrame([("a", "k1", {"x": "1"}), ("b", "k2", {})], "artefact string, key string, inputs map<string,string>")
    assert planning.read_manifest(spark, path).count() == 0
    planning.write_manifest(planning.merged_manifest(planning.read_manifest(spark, path), first), path)
    again = spark.createDataFrame([("b", "k9", {"y": "2"}), ("c", "k3", None)], "artefact string, key string, inputs map<string,string>")
    planning.write_manifest(planning.merged_manifest(planning.read_manifest(spark, path), again, gone=["a"]), path)
    assert {(r.artefact, r.key) for r in planning.read_manifest(spark, path).collect()} == {("b", "k9"), ("c", "k3")}
    seen = spark.createDataFrame([("diarize", 10.0, 20.0), ("mux", 4.0, 0.0), ("unheard_of", 1.0, 1.0), ("synth_piper", 3.0, 10.0)], "stage string, seconds double, units double")
    old = spark.createDataFrame([("diarize", 1.0), ("synth_piper", -1.0)], "stage string, learned double")
    # 1.0 * 0.6 + 0.5 * 0.4; a rate that is no rate is replaced; no units and unknown stages teach nothing
    assert {r.stage: round(r.learned, 6) for r in planning.learned_rates(old, seen).collect()} == {"diarize": 0.8, "synth_piper": 0.3}
    with pytest.raises(ValueError, match="cast"):
        planning.check_options(cast=True, diarize=False)
    planning.check_options(cast=True, diarize=True)


def test_one_document_a_track(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "subtitles", "ok"), (1, 1, "voices", "weak"), (2, 0, "subtitles", "ok")], "track_id long, idx long, stage string, level string")
    sheets.write_records(rows, str(tmp_path / "checks"))
    got = {f.parent.name: json.loads(f.read_text()) for f in (tmp_path / "checks").rglob("*.txt")}
    assert got == {"track_id=1": [{"idx": 0, "stage": "subtitles", "level": "ok"}, {"idx": 1, "stage": "voices", "level": "weak"}], "track_id=2": [{"idx": 0, "stage": "subtitles", "level": "ok"}]}
