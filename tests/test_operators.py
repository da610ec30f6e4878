import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.operators import audio, captions, casting, cues, edits, intervals, planning, rules, speakers, timing


def events(spark, *texts, step=2.0, length=2.0):
    return spark.createDataFrame([(1, i, i * step, i * step + length, t) for i, t in enumerate(texts)], "track_id long, seq long, start_s double, end_s double, text string")


def test_rolling_gives_each_word_once(spark):
    words = [f"w{i}" for i in range(60)]
    got = captions.dedupe_rolling(events(spark, *[" ".join(words[4 * k : 4 * k + 8]) for k in range(14)])).orderBy("seq").collect()
    assert " ".join(r.text for r in got).split() == words[:60]
    assert captions.inspect(events(spark, *[" ".join(words[4 * k : 4 * k + 8]) for k in range(14)])).first().rolling


def test_repeats_once(spark):
    once = captions.drop_repeats(events(spark, "a b.", "A  b.", "c.", "a b."))
    assert [r.text for r in once.orderBy("seq").collect()] == ["a b.", "c.", "a b."]
    assert captions.drop_repeats(once.select("track_id", "seq", "start_s", "end_s", "text")).count() == 3


def test_untangled(spark):
    rows = [r for r in captions.untangle(events(spark, "a", "b", "c", step=1.0, length=3.0)).orderBy("seq").collect()]
    assert [r.end_s for r in rows] == [1.0, 2.0, 5.0]


def test_normalize(spark):
    got = captions.normalize(events(spark, "a b.", "a b.", "c d.", "e f.", "g h.")).orderBy("seq").collect()
    assert [r.text for r in got] == ["a b.", "c d.", "e f.", "g h."]


def cue(spark, *rows):
    return spark.createDataFrame([(1, i, float(a), float(b), t) for i, (a, b, t) in enumerate(rows)], "track_id long, idx long, start_s double, end_s double, text string")


def test_fragments_keep_words(spark):
    random.seed(2)
    rows, at = [], 0.0
    for k in range(300):
        d = random.choice([0.5, 1.0, 2.0, 4.0])
        rows.append((at, at + d, random.choice(["Go on", "and then", "Stop.", "Yes"])))
        at += d + random.choice([0.0, 0.1, 0.5])
    got = cues.merge_fragments(cue(spark, *rows), 0.3, 7.0).orderBy("idx").collect()
    # row by row
    want, cur = [], None
    for a, b, t in rows:
        if cur and a - cur[1] <= 0.3 and (not cur[3].endswith(".") or t[0].islower()) and b - cur[0] <= 7.0:
            cur = [cur[0], b, f"{cur[2]} {t}", t]
        else:
            if cur:
                want.append(cur)
            cur = [a, b, t, t]
    want.append(cur)
    assert [(r.start_s, r.end_s, r.text) for r in got] == [tuple(x[:3]) for x in want]
    assert all(r.end_s - r.start_s <= 7.0 for r in got if len(r.members) > 1)


def test_fit_invariants(spark):
    rows = [(1, i, float(i * 4), i * 4 + 2.0, "x" * 20, d, 2.0, 0.0) for i, d in enumerate(np.linspace(0.2, 9, 60).tolist())]
    df = spark.createDataFrame(rows, "track_id long, idx long, start_s double, end_s double, text string, rendered_dur double, gap_s double, source_speech double")
    for r in timing.fit(df).collect():
        assert r.borrowed >= 0
        assert r.overrun == 0 or r.final_dur > r.window_s + r.borrowed + 0.15 - 1e-9
        assert r.outcome in {"clean", "filled", "borrowed", "resynth", "stretched", "overrun"}


def test_take_and_register(spark):
    takes = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 0.0, False), (1, 0, 1, 3.0, 0.5, 0.0, False), (1, 0, 2, 9.0, 0.0, 0.0, True), (1, 0, 3, 2.0, 0.0, 0.0, False)], "track_id long, idx long, take int, liveliness double, register_off double, dead_s double, broken boolean")
    assert timing.best_take(takes).first().take == 1
    ratios = spark.createDataFrame([(1, i, "S", 200.0, 100.0) for i in range(3)], "track_id long, idx long, speaker string, target_f0 double, median_f0 double")
    assert [r["shift"] for r in timing.register_ratio(ratios).collect()] == [6.0] * 3


def test_interval_joins_as_nested_loops(spark):
    random.seed(5)
    points = [(random.randint(0, 2), i, random.uniform(0, 100)) for i in range(200)]
    wins = [(random.randint(0, 2), i, s, s + random.uniform(0, 30)) for i, s in enumerate([random.uniform(-5, 90) for _ in range(25)])]
    p, w = spark.createDataFrame(points, "track_id int, frame_no int, t double"), spark.createDataFrame(wins, "track_id int, cue int, start_s double, end_s double")
    got = {(r.frame_no, r.cue) for r in intervals.interval_join(p, w, 7.0).collect()}
    assert got == {(i, c) for k, i, t in points for k2, c, a, b in wins if k == k2 and a <= t <= b}
    out = {r.frame_no for r in intervals.interval_anti(p, w, 7.0).collect()}
    assert out == {i for _, i, _ in points} - {i for i, _ in got}
    near = {r.frame_no for r in intervals.interval_semi(p, w, 7.0, 0.25, 6).collect()}
    assert near == {i for k, i, t in points if i % 6 == 0 or any(k == k2 and a - 0.25 <= t <= b + 0.25 for k2, _, a, b in wins)}


def test_interpolation(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0)], "track_id int, t double, value double")
    at = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 4.0), (1, 99.0)], "track_id int, t double")
    assert [r.value for r in intervals.interpolated(s, at).orderBy("t").collect()] == [0.0, 0.0, 2.0, 5.0]


def test_nearest_label(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, None), (1, 3, None), (1, 4, 7), (1, 5, None)], "track_id int, idx int, label int")
    assert [r.label for r in intervals.nearest_filled(rows).orderBy("idx").collect()] == [5, 5, 5, 7, 7, 7]


def test_nearest_label_as_a_search(spark):
    random.seed(6)
    # some rows twice: those with a label are nearest to those without
    rows = [(t, i, random.choice([None, None, 1, 2, 3])) for t in range(3) for i in random.sample(range(90), 60)]
    rows += [(9, 4, None), (9, 4, 7), (9, 0, 1), (9, 6, 2), (8, 1, None), (8, 2, None)]
    got = intervals.nearest_filled(spark.createDataFrame(rows, "track_id int, idx int, label int")).collect()

    def want(t, i, label):
        known = sorted((abs(j - i), j, m) for k, j, m in rows if k == t and m is not None)
        return label if label is not None or not known else known[0][2]

    assert sorted(map(str, got)) == sorted(f"Row(track_id={t}, idx={i}, label={want(t, i, m)})" for t, i, m in rows)


def brute_linkage(x, k=1, threshold=None):
    """Average linkage pair by pair from all distances of members."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if threshold is not None and h >= threshold:
            break
        groups[i] = groups[i] + groups.pop(j)
    label = np.empty(len(x), int)
    for n, g in enumerate(sorted(groups, key=min)):
        label[g] = n
    return label


def brute_silhouette(x, label):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    out = []
    for i, k in enumerate(label):
        own = [j for j in np.flatnonzero(label == k) if j != i]
        if not own or len(set(label)) < 2:
            out.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == o].mean() for o in set(label) - {k})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def brute_joined(x, label, target, alike, least):
    label = list(label)
    mean = lambda k: (v := np.mean([r for r, m in zip(x, label) if m == k], axis=0)) / np.linalg.norm(v)
    while len(set(label)) > 1:
        ids = sorted(set(label))
        s, i, j = max(((float(mean(i) @ mean(j)), -i, -j) for i in ids for j in ids if i < j))
        if s < alike and len(ids) <= max(target, 1):
            break
        label = [-i if m == -j else m for m in label]
    while len(set(label)) > 1:
        ids = sorted(set(label))
        small = min(ids, key=lambda k: (label.count(k), k))
        if label.count(small) >= least:
            break
        to = max((k for k in ids if k != small), key=lambda k: (float(mean(k) @ mean(small)), -k))
        label = [to if m == small else m for m in label]
    return label


def test_clusters_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 25, 40):
        x = rng.normal(size=(n, 5))
        x[: n // 3] = x[0] + rng.normal(size=(n // 3, 5)) * 0.2
        for k in (1, 2, 3, n):
            assert list(speakers.agglomerate(x, k)) == list(brute_linkage(x, min(k, n)))
        for t in (0.05, 0.4, 0.6, 1.5):
            assert list(speakers.agglomerate(x, threshold=t)) == list(brute_linkage(x, 1, t))
        label = rng.integers(0, 4, n)
        assert speakers._silhouette(x, np.unique(label, return_inverse=True)[1]) == pytest.approx(brute_silhouette(x, label), abs=1e-6)
        for target, alike, least in ((1, 0.9, 2), (3, 0.2, 3), (2, 2.0, 0), (5, 0.5, 4)):
            assert list(speakers.joined_labels(x, label, target, alike, least)) == brute_joined(x, label, target, alike, least)
    # equal rows: ties still part them as one
    same = np.repeat(np.eye(3), 4, axis=0)
    assert list(speakers.agglomerate(same, 3)) == [0] * 4 + [1] * 4 + [2] * 4 == list(speakers.agglomerate(same, threshold=0.5))
    best = max(range(2, 6), key=lambda k: (round(brute_silhouette(same, brute_linkage(same, k)), 9), -k))
    assert speakers.choose_k(same, 5) == best == 3


def peak_mb(f):
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def many_voices(n=3000):
    rng = np.random.default_rng(4)
    return np.repeat(rng.normal(size=(30, 8)), n // 30, axis=0) + rng.normal(size=(n, 8)) * 0.4


def test_linkage_holds_no_matrix_of_all_pairs():
    # 3,000 rows squared are 72 MB
    assert peak_mb(lambda: speakers.agglomerate(many_voices(), 6)) < 20


def test_number_of_clusters_holds_no_matrix_of_all_pairs():
    assert peak_mb(lambda: speakers.choose_k(many_voices(), 6)) < 20


def test_clusters_by_threshold_hold_no_matrix_of_all_pairs():
    assert peak_mb(lambda: speakers.agglomerate(many_voices(), threshold=0.60)) < 20


def test_speakers_hold_no_matrix_of_all_pairs(monkeypatch):
    made = []
    monkeypatch.setattr(speakers.Tree, "of", classmethod(lambda cls, x, of=speakers.Tree.of: made.append(len(x)) or of(x)))
    assert peak_mb(lambda: speakers.speaker_labels(many_voices())) < 20
    assert made == [3000]


def test_diarized_speakers_hold_no_matrix_of_all_pairs(monkeypatch):
    made = []
    monkeypatch.setattr(speakers.Tree, "of", classmethod(lambda cls, x, of=speakers.Tree.of: made.append(len(x)) or of(x)))
    assert peak_mb(lambda: speakers.diarized_labels(many_voices(), np.ones(3000, bool), np.full(3000, np.nan))) < 20
    assert made == [3000]


def test_linkage_by_rounds_and_by_chains():
    rng = np.random.default_rng(9)
    plain = [rng.normal(size=(60, 3)), np.abs(rng.normal(size=(50, 6))), np.repeat(rng.normal(size=(9, 4)), 5, axis=0)]
    tied = [np.eye(12), np.zeros((6, 3)), np.vstack([np.eye(4), np.zeros((2, 4))])]
    for x in plain + tied:
        chained = speakers.Linkage(x)
        chained.chain()
        merges = [np.concatenate(c) for c in zip(*chained.merges)]
        order = np.argsort(merges[0], kind="stable")
        one, two = speakers.Tree(len(x), *(c[order] for c in merges)), speakers.Tree.of(x)
        assert len(two.height) == len(x) - 1 and one.height == pytest.approx(two.height, abs=1e-9)
        for k in (1, 2, 3, 5) if len(x) > 12 else ():
            assert list(one.labels(k)) == list(two.labels(k)) == list(brute_linkage(x, k))


def test_an_emptied_label_is_gone():
    x = np.array([[1.0, 0.0], [0.9, 0.1], [-1.0, 0.0], [0.0, 1.0]])
    label = speakers.settled(x, np.array([5, 5, 7, 9]))
    assert list(label) == [5, 5, 7, 9]
    # both rows of label 1 are nearer to others; no later turn brings it back
    x = np.array([[1.0, 0.0], [1.0, 0.05], [0.0, 1.0], [0.05, 1.0], [1.0, 0.01], [0.01, 1.0]])
    label = speakers.settled(x, np.array([0, 0, 2, 2, 1, 1]))
    assert list(label) == [0, 0, 2, 2, 0, 2]


def test_two_voices_by_pitch():
    f = np.array([100.0, 105, 110, np.nan, 220, 230, 240])
    # gap 125, spreads 4.1 and 8.2 are below the floor of 15: score 8.3; cut between 110 and 220
    assert list(speakers.pitch_labels(np.array([9.0] * 7), f)) == [0, 0, 0, 9, 1, 1, 1]
    assert list(speakers.pitch_labels(np.array([9.0] * 6), f[:6])) == [9] * 6
    assert list(speakers.pitch_labels(np.array([9.0] * 7), np.array([100.0, 120, 140, 150, 160, 170, 180]))) == [9] * 7
    assert list(speakers.pitch_parted(np.array([0, 0, 0, 0, 1, 1]), np.array([100.0, 110, 200, 210, 100, 300]))) == [0, 0, 2, 2, 1, 1]


def test_diarized_composite(spark):
    rng = np.random.default_rng(0)
    voice = rng.normal(size=(1, 8))
    # one voice for both: only the pitch tells them apart
    x = voice + rng.normal(size=(20, 8)) * 0.3
    pitch = np.where(np.arange(20) % 2, 100.0, 230.0)
    label = speakers.diarized_labels(x, np.ones(20, bool), pitch)
    assert len(set(label[::2])) == len(set(label[1::2])) == 1 and label[0] != label[1]
    none = speakers.diarized_labels(np.zeros((0, 1)), np.zeros(4, bool), np.full(4, np.nan))
    assert list(none) == [0] * 4
    base = np.eye(3, 16)
    rows = [(1, i, None if i % 7 == 3 else (base[i // 10] + rng.normal(size=16) * 0.05).tolist(), None) for i in range(30)]
    got = speakers.diarized(spark.createDataFrame(rows, "track_id long, idx long, vec array<double>, f0 double")).orderBy("idx").collect()
    assert [r.speaker for r in got] == ["S00"] * 11 + ["S01"] * 9 + ["S02"] * 10  # row 10 has no vector: row 9 is as near as row 11


def test_clusters_of_clear_voices(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 16))
    rows = [(1, i, (base[i % 3] + rng.normal(size=16) * 0.05).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "track_id long, idx long, vec array<double>")
    for got in (speakers.clustered(df, k=3), speakers.clustered(df, threshold=0.6), speakers.cluster_speakers(df, 3), speakers.cluster_speakers(df)):
        assert [r.label for r in got.orderBy("idx").collect()] == [0, 1, 2] * 10
    assert speakers.auto_k(df).first().k == 3
    labelled = df.withColumn("label", F.expr("cast(idx % 6 as int)"))
    assert [r.label for r in speakers.merge_to(labelled, 3).orderBy("idx").collect()] == [0, 1, 2] * 10
    x = np.array([r[2] for r in rows])
    assert speakers.silhouette(labelled).first().silhouette == pytest.approx(brute_silhouette(x, np.arange(30) % 6), abs=1e-9)


def test_layout_by_hand(spark):
    """Room past the free time only over the next line of another speaker; a line without a speaker differs from any."""
    who = [("A", "B"), ("A", "A"), (None, "B"), ("A", None), ("A", ""), ("", "B"), (None, None)]
    rows = [(k, i, i * 10.0, i * 10.0 + 2.0, 2.0, 1.0, 3.5, s, 0.0) for k, pair in enumerate(who) for i, s in enumerate(pair)]
    df = spark.createDataFrame(rows, "track_id long, idx long, start_s double, end_s double, window_s double, gap_s double, final_dur double, speaker string, speech_onset double")
    got = timing.layout(df).where("idx = 0").orderBy("track_id").collect()
    # free: 2 + 1 - 0.12 = 2.88; over: 0.62, of which 0.45 may overlap
    assert [round(r.truncated, 3) for r in got] == [0.17, 0.62, 0.17, 0.62, 0.62, 0.17, 0.62]
    assert [round(r.overlapped, 3) for r in got] == [0.45, 0.0, 0.45, 0.0, 0.0, 0.45, 0.0]


def test_fit_counts_what_is_spoken(spark):
    # '"""---Hi"""' is spoken as 'Hi.': 3 / 12.6 * 0.55 = 0.13 s, so 0.5 s may be slowed; 12 characters would forbid it
    rows = [(1, 0, 0.0, 0.7, '"""---Hi"""', 0.5, 2.0, 0.0), (2, 0, 0.0, 0.7, "Hi there you.", 0.5, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, idx long, start_s double, end_s double, text string, rendered_dur double, gap_s double, source_speech double")
    assert [r.outcome for r in timing.fit(df).orderBy("track_id").collect()] == ["filled", "clean"]


def test_face_baselines_by_hand(spark):
    """Each face has its own baseline; few samples give the default, calm ones the floor."""
    rows = [(1, 0, float(i), v, 0.5, 0.1) for i, v in enumerate([0.0, 1.0, 0.0, 1.0, 0.0])] + [(1, 1, float(i), 0.3, 0.5, 0.1) for i in range(5)] + [(1, 2, 0.0, 0.3, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "track_id long, face long, t double, value double, level double, size double")
    wins = spark.createDataFrame([(1, 0, 100.0, 101.0)], "track_id long, cue long, start_s double, end_s double")
    got = {r.face: (r.n, r.baseline) for r in audio.mouth_baselines(df, wins, 10.0).collect()}
    sd = float(np.std([0.0 - 0.5, 1.0 - 0.0, 0.0 - 0.0, 1.0 - 0.0, 0.0 - 0.5]))
    assert got == {0: (5, pytest.approx(sd)), 1: (5, 0.02), 2: (1, 0.05)}
    inside = spark.createDataFrame([(1, 0, -1.0, 9.0)], "track_id long, cue long, start_s double, end_s double")
    small = df.withColumn("size", F.when(F.col("face") == 1, 0.02).otherwise(F.col("size")))
    # no sample lies outside of the line: default baselines; face 1 is small, face 2 has one frame
    base = audio.mouth_baselines(df, inside, 10.0)
    (r,) = audio.cue_scores(small, inside, base, 10.0).collect()
    assert (r.face, r.n) == (0, 5) and r.score == pytest.approx(min(sd / (0.15 + 1e-6), 1) * 0.5)


def test_face_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [3.0, 0.0]), (1, 0, [2.0, 9.0]), (1, 1, [1.0, 1.0])]
    (r,) = speakers.face_vectors(spark.createDataFrame(rows, "track_id long, face long, vec array<double>")).collect()
    assert (r.face, r.n) == (0, 3) and r.vec == pytest.approx([1.0, 0.0])


def test_references_by_hand(spark):
    rows = [(1, 0, "A", "one", 0.2, 5.0), (1, 1, "A", "two", 0.5, 6.0), (1, 2, "A", "three", 0.5, 0.9), (1, 3, "A", "four", 0.00001, 9.0), (1, 4, "A", "five", 0.1, 8.0), (1, 5, "B", "six", 0.5, 3.9), (1, 6, None, "seven", 0.5, 9.0), (1, 7, "A", "eight", 0.01, 2.0)]
    cues_ = spark.createDataFrame(rows, "track_id long, idx long, speaker string, text string, rms double, dur_s double").withColumn("dur_ms", F.expr("cast(dur_s * 1000 as bigint)"))
    picked = casting.pick_references(cues_)
    # scores: two 3.0, one 1.0, five 0.6: 6 + 5 s are not 12, five crosses; B lasts less than 4 s
    assert [r.idx for r in picked.orderBy("rank").collect()] == [1, 0, 4]
    assert [tuple(r) for r in casting.transcripts(picked).collect()] == [(1, "A", "two one five")]
    assert casting.transcripts(picked.withColumn("source_text", F.when(F.col("idx") == 0, "eins").otherwise(""))).first().transcript == "two eins five"
    refs = spark.createDataFrame([(1, "A", "a.wav")], "track_id long, speaker string, reference string")
    assert {r.reference for r in casting.reference_for(cues_, refs).collect()} == {"a.wav"}


def test_speech_in_cues(spark):
    frames_ = spark.createDataFrame([(1, i, e) for i, e in enumerate([0.5, 0.0, 0.0, 0.0, 0.2, 0.2, 0.001, 0.0, 0.0, 0.0] + [0.0] * 300)], "track_id long, frame_no long, energy double")
    cues_ = spark.createDataFrame([(1, 0, 0.04, 0.2), (1, 1, 2.0, 3.0), (1, 2, 50.0, 51.0)], "track_id long, cue long, start_s double, end_s double")
    assert {r.cue: round(r.speech_s, 4) for r in audio.speech_seconds(frames_, cues_).collect()} == {0: 0.04, 1: 0.0, 2: 0.0}
    # looked for from before the cue: frame 0 is loud
    assert {r.cue: round(r.onset_s, 4) for r in audio.onset(frames_, cues_).collect()} == {0: -0.04, 1: 0.0, 2: 0.0}
    assert audio.onset(frames_.where("frame_no > 0"), cues_).where("cue = 0").first().onset_s == pytest.approx(0.04)


def test_anchors(spark):
    rows = [(1, 0, [1.0, 0.0], 7), (1, 1, [0.0, 1.0], 3), (1, 2, [0.9, 0.1], None), (1, 3, [0.7, 0.7], None), (1, 4, None, None), (2, 0, [1.0, 0.0], None), (3, 0, [1.0, 0.0], 5), (3, 1, [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "track_id long, idx long, vec array<double>, anchor int")
    got = {(r.track_id, r.idx): r.label for r in speakers.anchored(df).collect()}
    # labels 3 and 7 become 0 and 1; row 3 is as near to both and takes that of the row before
    assert got == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 0): 0, (3, 0): 0, (3, 1): 0}


def test_chars_per_second_is_the_upper_median(spark):
    rng = random.Random(1)
    for n in (19, 20, 21, 40):
        d = [rng.uniform(0.6, 4.0) for _ in range(n)]
        df = spark.createDataFrame([(1, "x" * 10, x, 1.0) for x in d] + [(1, "x", 0.4, 1.0), (1, "x", 2.0, 1.2)], "k int, text string, rendered_dur double, engine_speed double")
        assert edits.chars_per_second(df, "k").first().cps == (15.0 if n < 20 else pytest.approx(sorted(10 / x for x in d)[n // 2]))


def test_a_sheet_of_other_cues_is_an_error(spark):
    df = spark.createDataFrame([(1, False)], "idx int, matched boolean")
    with pytest.raises(ValueError, match="matches none"):
        edits.require_matches(df, "cast.tsv")
    assert edits.require_matches(df.withColumn("matched", F.lit(True)), "cast.tsv").count() == 1


def test_lines_without_vector(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, [0.0, 1.0]), (1, 3, [0.0, 1.0]), (1, 4, [1.0, 0.0])], "track_id long, idx long, vec array<double>")
    assert speakers.cluster_speakers(df, 2).where("label is null").count() == 0


def test_face_tracks(spark):
    v = [1.0, 0.0]
    faces = [(1, 0, 0.0, [0.0, 0.0, 10.0, 10.0], v), (1, 0, 0.1, [1.0, 0.0, 11.0, 10.0], v), (1, 0, 0.1, [50.0, 0.0, 60.0, 10.0], v), (1, 0, 2.0, [1.0, 0.0, 11.0, 10.0], v), (1, 1, 2.1, [1.0, 0.0, 11.0, 10.0], v)]
    got = speakers.face_tracks(spark.createDataFrame(faces, "track_id long, scene long, t double, bbox array<double>, sface array<double>")).orderBy("scene", "t", "face").collect()
    assert [r.face for r in got] == [0, 0, 1, 2, 0]


def test_voices_beyond_the_pool(spark):
    who = spark.createDataFrame([(1, f"S0{i}", 10 - i, i, i + 1, 200.0) for i in range(4)], "track_id long, speaker string, lines long, first_idx long, rank int, speaker_f0 double")
    voices = spark.createDataFrame([("F", "a", 1), ("F", "b", 2)], "gender string, name string, ord int")
    assert [r.voice for r in casting.assign_voices(who, voices, "x").orderBy("rank").collect()] == ["a", "b", "a", "a"]


def test_ema_is_the_recursion(spark):
    values = [3.0, 5.0, 1.0, 8.0]
    rate = values[0]
    for v in values[1:]:
        rate = rate * 0.6 + v * 0.4
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("s", 9, -1.0)], "stage string, ord int, value double")
    assert planning.ema(rows, 0.6, "stage").first().rate == pytest.approx(rate)


def test_ladder_and_checks(spark):
    r = spark.createDataFrame([(True, True, True, 5, 3, 0.5, 0.9, 0.5), (False, True, True, 5, 3, 0.5, 0.9, 0.5), (True, True, True, 5, 3, 0.05, 0.9, 0.5)], "has_video boolean, installed boolean, scanned boolean, faces int, characters int, silhouette double, labelled double, top_share double")
    assert [x.reject for x in audio.reject_reason(r).collect()] == [None, "no video", "characters alike"]
    c = spark.createDataFrame([(0.1, 0.5, 2), (0.3, 0.5, 2), (0.5, 0.95, 1), (0.5, 0.95, 2), (0.5, 0.5, 2)], "q double, s double, k int")
    assert [x[0] for x in c.select(rules.speaker_check(F.col("q"), F.col("s"), F.col("k"))).collect()] == ["unreliable", "weak", "weak", "unreliable", "ok"]


def test_frames_of_samples(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5, 0.5, 9.0],), ([],)], "s array<double>")
    assert [r[0] for r in df.select(audio.framed(F.col("s"), 2)).collect()] == [[1.0, 0.5], []]
    assert df.select(audio.cut_samples(F.col("s"), F.lit(1.0), F.lit(3.0), 1)).first()[0] == [-1.0, 0.5]


def test_slope_and_scene(spark):
    tail = spark.createDataFrame([(1, i * 0.1, float(100 * 2 ** (i * 0.1))) for i in range(8)], "k int, t double, f0 double")
    assert audio.terminal_slope(tail, "k").first().f0_end_slope == pytest.approx(12.0)
    shots = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([10, 11, 80, 81, 10])], "track_id int, frame_no int, level double")
    assert [r.scene for r in audio.shot_cuts(shots).orderBy("frame_no").collect()] == [0, 0, 1, 1, 2]


