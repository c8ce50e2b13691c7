"""What keeps a query's memory from growing: nothing that is exploded goes to the driver, and rows are dealt before each becomes many."""

import os
import re

import numpy as np
import pytest

from tessitura.operators import chords as C
from tessitura.operators import folds
from tessitura.operators import hmm as V
from tessitura.operators import score as E
from tessitura.operators import tempo as T
from tessitura.operators import timejoin as J
from tessitura.plans import catalog

SF = "/root/testdata/sf0.001"


def broadcast_parts(plan: str):
    """The lines below each BroadcastExchange."""
    lines = plan.splitlines()
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line).group())
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[n + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            yield below


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["beat_agreement", "lead_sheet_summary", "chord_debug_json", "chord_scan_per_bar", "downbeats_without_beat", "stereo_resample"])
def test_no_exploded_rows_are_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    aggregated = ("HashAggregate", "SortAggregate")
    for part in broadcast_parts(plan):
        first = next((line for line in part if "Generate " in line or any(a in line for a in aggregated)), "")
        assert "Generate " not in first, f"{name} broadcasts exploded rows"


def test_rows_are_dealt_before_they_become_many(spark):
    """A row a track is few bytes; adaptive execution would make all its beats in one task."""
    tracks = spark.range(100).selectExpr("id AS track_id").distinct()
    made = J.spread_out(tracks).selectExpr("track_id", "explode(sequence(0, 130)) AS beat_idx")
    assert made.selectExpr("spark_partition_id() AS p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_joint_decoding_of_many_tracks_from_sparse_scores(spark):
    """Scores as maps say what whole arrays say; tracks of several lengths are decoded side by side, and blocks of frames leave the path."""
    rng = np.random.default_rng(5)
    arrays = {track: np.where(rng.random((length, 1647)) < 0.01, rng.integers(1, 9, (length, 1647)), 0.0) for track, length in ((1, 5), (2, 5), (3, 1), (4, 9))}
    dense = [(track, t, row.tolist()) for track, rows in arrays.items() for t, row in enumerate(rows)]
    sparse = [(track, t, {s: row[s] for s in range(1647) if row[s]}) for track, t, row in dense]
    whole = {tuple(r) for r in V.decode_joint(spark.createDataFrame(dense, "track_id bigint, frame int, scores array<double>")).collect()}
    assert whole == {tuple(r) for r in V.decode_joint(spark.createDataFrame(sparse, "track_id bigint, frame int, scores map<int, double>")).collect()}
    assert whole == {(track, t, int(s)) for track, rows in arrays.items() for t, s in enumerate(V.joint_path(rows, block=2))}


def test_the_chord_table_is_no_part_of_a_plan(spark):
    """As a literal of 53,248 names it was printed in every plan that adaptive execution makes, and kept by the driver."""
    sets = spark.createDataFrame([(145, 0), (145, 4), (0, 0), (None, 0)], "mask int, bass int")
    named = C.symbols(sets)
    assert len(named._jdf.queryExecution().optimizedPlan().toString()) < 5000
    assert {tuple(r) for r in named.collect()} == {(145, 0, "C"), (145, 4, "C/E"), (0, 0, None), (None, 0, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["chord_scan_per_bar", "melody_continuity", "melody_skyline", "windowed_tempo_map", "beat_grid_finished"])
def test_folds_have_no_group_for_each_track(spark, name):
    assert "FlatMapGroups" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tracks_are_folded_whole_across_batches(spark):
    rows = spark.range(1000).selectExpr("case when id % 7 < 6 then id % 7 end AS track_id", "id AS x")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        found = folds.fold_tracks(rows, lambda track, held: [(track, len(held), sum(x for (x,) in held))], "track_id bigint, n int, total bigint", rows_each=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = {t: [i for i in range(1000) if i % 7 == (6 if t is None else t)] for t in (*range(6), None)}
    assert sorted(map(tuple, found), key=str) == sorted(((t, len(x), sum(x)) for t, x in own.items()), key=str)
    assert not folds.fold_tracks(rows.where("false"), lambda track, held: [(track, 0, 0)], "track_id bigint, n int, total bigint").collect()


def test_tempi_of_windows_are_those_of_each_alone():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.uniform(0, 8, n)).tolist() for n in rng.integers(0, 30, 200)] + [[float(x) / 2 for x in range(16)], [], [0.0, 0.0, 0.0]]
    assert T.tempi_of(lists, onsets_each=500) == [T.tempo_of(x) for x in lists]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["musicxml_document", "voice_assignment"])
def test_scores_are_written_from_streams_dealt_to_all_tasks(spark, name):
    """A pandas group for each block of measures costs milliseconds, and adaptive execution brings the few bytes of many to one task."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    assert re.search(r"hashpartitioning\(track_id#\d+L?, measure#\d+, \d+\), REPARTITION_BY_NUM", plan)


def test_voices_of_shuffled_pieces(spark):
    rng = np.random.default_rng(4)
    rows = [(int(t), int(m), int(s), int(a), int(a + d), int(p), n) for n, (t, m, s, a, d, p) in enumerate(zip(*(rng.integers(0, k, 600) for k in (3, 40, 2, 12, 9, 30)), strict=True))]
    pieces = spark.createDataFrame(rows, "track_id bigint, measure int, staff int, start_tick int, end_tick int, pitch int, id int").repartition(7)
    want, held = {}, {}
    for t, m, s, a, z, _, n in sorted(rows, key=lambda r: (r[3], r[5], r[6])):
        ends = held.setdefault((t, m, s), [])
        free = [i for i, x in enumerate(ends) if x <= a]
        v = free[0] if free else len(ends)
        ends[v : v + 1] = [z]
        want[n] = v + 1
    got = E.voices(pieces)
    assert got.columns == [*pieces.columns, "voice"] and {r["id"]: r["voice"] for r in got.collect()} == want and max(want.values()) > 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_notes_of_a_score_are_quantised_once(spark):
    plan = catalog.musicxml_document(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/quantised-") >= 3
