"""Properties of physical plans that matter at scale."""

import contextlib
import io

import pytest

from tracklore.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n not in {"dedupe_rolling", "merge_fragments", "cluster_by_pitch", "agglomerative", "character_clusters", "cluster_speakers", "diarized_speakers", "merge_close", "merge_to_characters", "face_numbers", "auto_k"}])
def test_python_only_where_a_fold_or_cluster_needs_it(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text


def test_scans_read_what_they_need(spark):
    text = plan(catalog.QUERIES["provenance_keys"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan(spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'purchase'"))


def test_one_exchange_for_windows_of_a_track(spark):
    assert plan(catalog.QUERIES["fit_outcomes"](spark, SF)).count("+- Exchange") <= 1


@pytest.mark.parametrize("name", ["nearest_label_fill", "anchors_assign", "envelope_interp"])
def test_no_window_from_each_row_to_the_last(spark, name):
    # Spark goes through all following rows anew for each row
    assert "currentrow$(), unboundedfollowing$()" not in plan(catalog.QUERIES[name](spark, SF))


def test_fragments_are_folded_in_one_pass(spark):
    text = plan(catalog.QUERIES["merge_fragments"](spark, SF))
    assert text.count("+- Scan parquet") + text.count(": Scan parquet") == text.count("Scan parquet") // 2 == 1
    assert "FlatMapGroups" not in text
