import datetime

import duckdb
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracklore.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    oracle.check(spark, duck, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def same_on(spark, tmp_path, name, **tables):
    c = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{t}.parquet")
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    oracle.check(spark, c, catalog.QUERIES[name], catalog.ORACLES[name], str(tmp_path))


def test_marks_where_a_word_goes_on_beyond_ascii(spark, tmp_path):
    said = ["doó os", "doñ. rrci", "wasé.", "who\u00a0", "ok, no\u00a0", "is it\u2028", "do", "done", "a, oké", "ſhall we", "", None]
    rows = [{"conv_id": 1, "turn": k, "role": "user", "text": t} for k, t in enumerate(said)]
    same_on(spark, tmp_path, "punctuated_cues", conversations=rows)


def levels_at_the_floor():
    # 0.02 is the floor itself: no level
    values = [0.02, 0.03, 5.0, 40.0, 0.02, 700.0, 1.5, 0.02, 0.01, 0.0, -3.0, 0.02, 0.05, None]
    start = datetime.datetime(2024, 1, 1)
    return [{"user_id": 1 + k // 28, "event_id": k, "event_type": "view", "value": v, "ts": start + datetime.timedelta(seconds=k)} for k, v in enumerate(values * 4)]


def test_a_level_at_the_floor_is_none(spark, tmp_path):
    same_on(spark, tmp_path, "intensity_by_speaker", events=levels_at_the_floor())


def test_gain_of_a_level_at_the_floor(spark, tmp_path):
    same_on(spark, tmp_path, "gain_emotion", events=levels_at_the_floor())


def test_gain_within_rounding_of_the_floor(spark, tmp_path):
    # 60 more than these rounds to the floor of 60.02 or to the next number
    values = [5.0, 0.02 + 1e-15, 40.0, 0.02 + 5e-15, 700.0, 0.02 + 9e-15, 1.5, 0.02 - 2e-15, 9.0, 2.0, 3.0]
    rows = [r | {"value": values[k % 11]} for k, r in enumerate(levels_at_the_floor())]
    same_on(spark, tmp_path, "gain_emotion", events=rows)


def test_gain_of_rows_without_user_event_or_time(spark, tmp_path):
    rows = levels_at_the_floor()
    for k, column in ((3, "user_id"), (9, "event_id"), (16, "ts"), (35, "ts"), (44, "user_id")):
        rows[k][column] = None
    same_on(spark, tmp_path, "gain_emotion", events=rows)


def test_fragments_of_turns_without_text(spark, tmp_path):
    # long runs of lines that go on, with turns that have no text between, before and after
    rows = [{"conv_id": c, "turn": k, "role": "user", "text": None if (k + c) % 3 == 0 else "and so it goes on and on " * (k % 5 + 1)} for c in range(6) for k in range(12)]
    rows += [{"conv_id": 7, "turn": 0, "role": "user", "text": None}]
    same_on(spark, tmp_path, "merge_fragments", conversations=rows)
