import itertools

import pytest
from pyspark.sql import functions as F

from tracklore.functions import measure as M
from tracklore.functions import text as X
from tracklore.functions.rx import re2


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(f(F.col("c"))).collect()]


def test_clean_and_drop(spark):
    assert one(spark, X.clean_line, "<i>x</i> [door]", "BOB: hi  there", "a  b", None) == ["x", "hi there", "a b", None]
    assert one(spark, X.is_dropped, "Subtitles by team X", "♪ la ♪", "что это", "[door]", "", None, "fine") == [True] * 6 + [False]


def test_speakers(spark):
    f = lambda c: X.speaker_parts(F.split(c, "\n"))
    assert one(spark, f, "- A there?\n- B here.", "- A\nB", "one") == [["A there?", "B here."], ["A B"], ["one"]]


def test_runs_of_marks(spark):
    rank = {"?": 4, "!": 3, ".": 2, ";": 1, ":": 1, ",": 0}

    def plain(run):
        if set(run) == {"."}:
            return "..." if len(run) >= 3 else "."
        return max(run, key=rank.get)

    runs = ["".join(p) for n in (2, 3, 4) for p in itertools.product(".,!?;:", repeat=n)]
    assert one(spark, X.collapse_marks, *[f"a{r}b" for r in runs]) == [f"a{plain(r)}b" for r in runs]


def test_speakable(spark):
    assert one(spark, X.speakable, "Wait…what?!", "— \"Hi\" -- there ,you", ": x", "", "a — b") == ["Wait...what?", "Hi, there,you.", "x.", "", "a, b."]
    once = one(spark, X.speakable, "Wait…what?!", "a -- b", "so,, well;")
    assert one(spark, X.speakable, *once) == once


def test_overlaps(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["b"]), ([], ["b"]), (["x", "a"], ["x", "b"])], "a array<string>, b array<string>")
    got = rows.select(X.shared_tail(F.col("a"), F.col("b")), X.shared_prefix(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(2, 0), (0, 0), (0, 0), (0, 1)]


def test_replies(spark):
    assert one(spark, X.clean_reply, '"Okay: go on"\nmore', "Here: yes", "plain") == ['go on"', "yes", "plain"]
    assert one(spark, lambda c: X.numbered_replies(c, F.lit(2)), "1. a\n2) b\n3. c\n1: d\nx")[0] == {1: "d", 2: "b"}
    got = one(spark, X.brief_of, '```json\n{"summary": "s", "notes": "n", "glossary": [{"term": "A", "target": "B", "why": ""}, {"term": "", "target": "x"}]}\n```', "nothing")
    assert got[0]["glossary"][0]["term"] == "A" and len(got[0]["glossary"]) == 1 and got[1] is None


def test_russian(spark):
    assert one(spark, lambda c: c.rlike(X.rx(X.RUSSIAN, True)), "ЧТО там", "щось інше", "мы") == [True, False, True]


def test_marks_by_delivery(spark):
    rows = spark.createDataFrame([("who are you", 0.0, 0.0), ("who are you.", 0.0, 0.0), ("who are you.", 3.0, 0.0), ("get out.", 0.0, 6.0), ("done!", 9.0, 9.0), ("calm.", 0.0, 0.0)], "t string, s double, i double")
    assert [r[0] for r in rows.select(X.punctuate(F.col("t"), F.col("s"), F.col("i"))).collect()] == ["who are you?", "who are you.", "who are you?", "get out!", "done!", "calm."]


def test_marks_by_classes(spark):
    rows = spark.createDataFrame([("doó os",), ("do os",), ("doe os",)], "t string")
    marks = lambda **k: [r[0] for r in rows.select(X.punctuate(F.col("t"), F.lit(0.0), F.lit(0.0), **k)).collect()]
    assert marks() == ["doó os", "do os?", "doe os"]
    assert marks(classes=re2) == ["doó os?", "do os?", "doe os"]


def test_bands_and_durations(spark):
    rows = spark.createDataFrame([(0.9,), (0.85,), (0.7,), (0.6,), (0.5,)], "v double")
    assert [r[0] for r in rows.select(M.band(F.col("v"), 0.85, 0.60)).collect()] == ["ok", "ok", "weak", "weak", "unreliable"]
    times = spark.createDataFrame([(50.0,), (600.0,), (7500.0,)], "v double")
    assert [r[0] for r in times.select(M.duration_text(F.col("v"))).collect()] == ["50s", "10 min", "2h 5m"]


def test_probe_windows(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.0, 10.0)], "a double, b double")
    got = [r[0] for r in rows.select(M.probe_windows(F.col("a"), F.col("b"))).collect()]
    assert len(got[0]) == 1 and len(got[1]) == 3
    assert got[1][1]["from_s"] == pytest.approx(4.0) and got[1][2]["to_s"] == pytest.approx(9.9)
