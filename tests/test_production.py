import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.functions import names as N
from tracklore.operators import faces, planning
from tracklore.operators import production as P
from tracklore.sources import engines, recordings


def test_load(spark):
    rows = [(1, 0, 0.0, 2.0, "- A there?\n- B here."), (1, 1, 2.1, 3.0, "<i>go</i> on"), (1, 2, 3.1, 4.0, "and on."), (1, 3, 4.5, 5.0, "♪ la ♪"), (1, 4, 9.0, 10.0, "End.")]
    got = P.load_cues(spark.createDataFrame(rows, "track_id long, seq long, start_s double, end_s double, text string")).orderBy("idx").collect()
    # a line in lower case goes on, even after a full stop
    assert [r.text for r in got] == ["A there?", "B here. go on and on.", "End."]
    assert got[0].start_s == 0.0 and got[-1].end_s == 10.0


def test_rounds(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "short one", 5.0), (1, 1, "x" * 90, 1.0)], "track_id long, idx long, text string, budget_s double")
    asked = []

    def keep(df):
        path = str(tmp_path / f"r{len(asked)}")
        asked.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    class Short(engines.ChatEngine):
        def ask(self, prompt):
            return prompt.split(": ", 1)[1][:40]

    got = P.translate_rounds(lines, lambda p: engines.asked(p, Short), "de", 3, keep)
    assert len(asked) == 3 and got.where("idx = 0").count() == 1 and got.where("idx = 1 and not acceptable").count() == 3


def test_samples(spark):
    df = spark.createDataFrame([([0.0, 0.001, 2.0, -1.0, 0.0],)], "s array<double>")
    one = lambda c: df.select(c).first()[0]
    s = F.col("s")
    assert one(P.peak_scaled(s)) == pytest.approx([0.0, 0.000495, 0.99, -0.495, 0.0])
    assert one(P.trimmed(s, 0.01)) == [2.0, -1.0] and one(P.trimmed(s, 9.0)) == []
    assert one(P.faded_out(s, 2)) == pytest.approx([0.0, 0.001, 2.0, -0.5, 0.0])
    assert len(one(P.crossfaded(s, s, 2))) == 8
    assert one(P.tail_level(s, 1000, 2)) == pytest.approx(0.5)


def test_cap_and_tail_by_hand(spark):
    rng = np.random.default_rng(0)
    for n, rate, seconds in ((900, 1000, 0.5), (900, 1000, 0.1), (900, 1000, 2.0), (900, 1000, 0.0), (120, 100, 0.02), (900, 50, 3.0)):
        x = rng.uniform(-1, 1, n)
        want, limit = x, int(seconds * rate)
        if 0 < limit < n:
            frame, back = max(1, rate // 100), min(rate // 4, limit)
            cut = limit
            if back > frame:
                window = np.abs(x[limit - back : limit])
                cut = limit - back + (int(np.argmin([window[k : k + frame].sum() for k in range(0, back // frame * frame, frame)])) + 1) * frame
            want, fade = x[:cut].copy(), min(rate // 50, cut)
            if fade > 1:
                want[-fade:] *= np.linspace(1, 0, fade)
        df = spark.createDataFrame([(x.tolist(),)], "s array<double>")
        assert df.select(P.capped(F.col("s"), rate, F.lit(seconds))).first()[0] == pytest.approx(want.tolist())
        start = seconds / 2
        low, first = 10 ** (-12 / 20), int(start * rate)
        ramp = max(0, min(rate * 60 // 1000, n - first))
        tail = x.copy()
        tail[first : first + ramp] *= np.linspace(1, low, ramp)
        tail[first + ramp :] *= low
        assert df.select(P.ducked_tail(F.col("s"), rate, F.lit(start), -12.0)).first()[0] == pytest.approx(tail.tolist())
    df = spark.createDataFrame([(None, "mix.wav", 30.0), ("voc.wav", "mix.wav", 1.0)], "v string, m string, d double")
    assert [tuple(r) for r in df.select(P.analysis_audio(F.col("v"), F.col("m")), P.voice_duck_ratio(F.col("d"))).collect()] == [("mix.wav", 20.0), ("voc.wav", 2.0)]
    assert df.select(N.packed_line(F.col("m"), F.lit("hi")), N.packed_line(F.col("m"), F.lit("")), N.voice_id(F.lit("af"), F.lit(None).cast("binary")), N.voice_id(F.lit("f.wav"), F.lit(b"x"))).first()[:4] == ("mix.wav||hi", "mix.wav", "af", hashlib.sha1(b"x").hexdigest()[:12])


def test_names(spark):
    df = spark.createDataFrame([("https://x/y", "af_heart", "a: b?/c", None), ("/tmp/x", "bm_x", "ok", "ref.wav")], "u string, v string, t string, r string")
    rows = df.select(N.is_url(F.col("u")), N.voice_gender(F.col("v")), N.title_name(F.col("t")), N.packed_voice(F.col("v"), F.col("r")), N.clip_name(F.lit(7))).collect()
    assert [tuple(r) for r in rows] == [(True, "F", "a bc", "af_heart", "line00007.wav"), (False, "M", "ok", "bm_x::ref.wav", "line00007.wav")]
    assert df.select(N.unpacked_voice(F.lit("a::b"))["reference"], N.cues_expected(F.lit(0), F.lit(120.0)), P.duck_ratio(F.lit(1.0), F.lit(False))).first()[:3] == ("b", 22, 2.0)


def test_artefacts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (r,) = P.fingerprints(spark, str(tmp_path)).collect()
    assert r.fingerprint.startswith("5:")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "artefact string, key string")
    assert [x.artefact for x in P.reusable(now, now.where("artefact = 'a'")).collect()] == ["a"]


def test_lists_and_counts(spark):
    runs = spark.createDataFrame([(True, False, True, "kokoro"), (False, True, False, "kokoro"), (False, True, True, "chatterbox")], "t boolean, c boolean, d boolean, e string")
    assert [r[0] for r in runs.select(P.stage_list(F.col("t"), F.col("c"), F.col("d"), F.col("e"))).collect()] == [
        ["separate", "diarize", "translate_llm", "prosody", "synth_kokoro", "mux"], ["separate", "prosody", "references", "synth_kokoro", "convert", "mux"], ["separate", "diarize", "prosody", "references", "synth_chatterbox", "mux"],
    ]
    e = spark.createDataFrame([("a", None), ("b", ["uk"]), ("c", ["en"])], "name string, langs array<string>")
    assert {r.name for r in P.engines_for(e, "uk").collect()} == {"a", "b"}
    before = spark.createDataFrame([(1, "a b c"), (1, "b c d")], "track_id long, text string")
    assert P.repaired_words(before, before.limit(1)).first().removed_words == 3
    assert spark.range(1).select(P.broken_take(F.lit(0.5), F.lit(0.0), F.lit("x" * 50))).first()[0]


def test_faces_by_hand(spark, tmp_path):
    rows = [(1, 0.5, 100.0, 50.0, [10.0, 30.0, 15.0, 25.0, 20.0, 20.0], [10.0, 20.0, 12.0, 12.0, 15.0, 16.5], {"jawOpen": 0.4, "mouthClose": 0.1}, 1.3, [3.0, 4.0]), (1, 0.6, 100.0, 50.0, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None, None, [1.0, 0.0]), (1, 0.7, 100.0, 50.0, [10.0, 30.0, 15.0, 15.0, 20.0, 20.0], [10.0, 20.0, 12.0, 12.0, 15.0, 16.5], None, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "track_id long, t double, width double, height double, xs array<double>, ys array<double>, blend map<string,double>, facing double, sface array<double>")
    got = faces.measured(df.selectExpr("*", "2 as right_eye", "3 as left_eye", "4 as lip_upper", "5 as lip_lower")).orderBy("t").collect()
    # lips 1.5 apart, eyes 10: 0.15 of an eye distance is open; expressions 0.3; the second face has no extent
    assert len(got) == 2 and got[0].mouth == pytest.approx(0.5 + 0.15) and got[0].bbox == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert (got[0].frontality, got[1].frontality) == (1.0, 0.5) and got[0].sface == pytest.approx([0.6, 0.8]) and got[0].face_size == pytest.approx((200 / 5000) ** 0.5)
    assert got[1].mouth == 0.0  # eyes at one point
    np.savez(tmp_path / "a.npz", track_id=np.array([0, 1], "int32"), t=np.array([0.5, 1.0], "f4"), bbox=np.zeros((2, 4), "f4"), face_size=np.ones(2, "f4"), frontality=np.ones(2, "f4"), sface=np.ones((2, 128), "f4"), mouth=np.array([0.25, 0.5], "f4"), fps=np.array([25.0]))
    scan = recordings.read_scans(spark, str(tmp_path / "a.npz"))
    assert [(r.face, r.t, r.mouth, len(r.sface), len(r.bbox)) for r in scan.collect()] == [(0, 0.5, 0.25, 128, 4), (1, 1.0, 0.5, 128, 4)]
    recordings.write_faces(scan.withColumn("track_id", F.lit(7)).drop("path"), str(tmp_path / "faces"))
    assert recordings.read_faces(spark, str(tmp_path / "faces")).where("track_id = 7 and mouth = 0.5").count() == 1


def test_wav_round_trip(spark):
    df = spark.createDataFrame([([0.0, 0.5, -0.5, 2.0], 8000), (None, 8000), ([], 8000)], "s array<double>, r int")
    got = df.select("s", recordings.wav_bytes(F.col("s"), F.col("r")).alias("w")).withColumn("back", recordings.wav_samples(F.col("w"))).collect()
    assert got[0].back == pytest.approx([0.0, 0.5, -0.5, 1.0], abs=1e-4) and bytes(got[0].w)[:4] == b"RIFF" and len(got[0].w) == 44 + 8
    assert got[1].w is None and got[1].back is None and got[2].back == []


def test_metadata_and_guards(spark):
    text = '{"title": "T", "license": "cc-by", "duration": 12.5, "subtitles": {"en-GB": [{"ext": "srt"}], "de": []}, "automatic_captions": {}, "x": 1}'
    a, b = spark.createDataFrame([(text,), ("broken",)], "j string").select(recordings.source_metadata(F.col("j")).alias("m")).collect()
    assert a.m.asDict() == {"title": "T", "license": "cc-by", "duration": 12.5, "language": None, "manual": ["de", "en-GB"], "automatic": []} and b.m is None
    with pytest.raises(ValueError, match="stem"):
        planning.check_options(cast=False, diarize=True, clone=True, stem=False)
    some = spark.createDataFrame([(1, "a"), (2, None)], "track_id long, text string")
    with pytest.raises(ValueError, match="track 2"):
        planning.check_cues(some)
    assert planning.check_cues(some.where("track_id = 1")).count() == 1
