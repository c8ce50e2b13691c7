"""Session helpers and the result cache on small inputs."""

from pyspark.sql import functions as F

from tessitura.operators import cache as H
from tessitura.operators import session as U


def test_model_choice(spark):
    files = spark.createDataFrame([(0, "pitch.onnx"), (0, "demucs_fp16.onnx"), (1, "htdemucs_6s.onnx"), (0, "htdemucs_6s.onnx"), (0, "notes.txt"), (0, "other_stems.onnx")], "dir_rank int, name string")
    assert tuple(U.choose_model(files).first()) == ("htdemucs_6s.onnx", 0)
    assert U.choose_model(files, "other_stems").first()["name"] == "other_stems.onnx"
    assert U.choose_model(files.where("name like '%fp16%' or name like 'other%'")).first()["name"] == "demucs_fp16.onnx"


def test_state_and_markers(spark):
    text = '{"volume": 0.5, "speed": 1.0, "markers": {"h": [{"time": 3.0, "desc": "b"}]}, "positions": {"h": 12.5}}'
    row = spark.range(1).select(U.parse_state(F.lit(text)).alias("s")).select("s.volume", U.add_marker(F.col("s.markers")["h"], F.lit(1.0), F.lit("a")).alias("m"), F.col("s.positions")["h"].alias("p")).first()
    assert row["volume"] == 0.5 and row["p"] == 12.5 and [(m["time"], m["desc"]) for m in row["m"]] == [(1.0, "a"), (3.0, "b")]


def test_recent_list(spark):
    row = spark.range(1).select(U.recent(F.array(*map(F.lit, "abc")), F.lit("c"), 3).alias("x"), U.first_nonblank(F.array(F.lit(None).cast("string"), F.lit(" "), F.lit("t"))).alias("y")).first()
    assert row["x"] == ["c", "a", "b"] and row["y"] == "t"


def test_loop_shift_and_resume(spark):
    row = spark.range(1).select(H.shift_loop(F.lit(8.0), F.lit(10.0), F.lit(5.0), F.lit(12.0)).alias("l"), H.resume_position(F.lit(0.4), F.lit(10.0)).alias("a"), H.resume_position(F.lit(20.0), F.lit(10.0)).alias("b")).first()
    assert tuple(row["l"]) == (10.0, 12.0) and row["a"] == 0 and row["b"] == 9.5


def test_cache_misses_are_computed_once(spark):
    wanted = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0)], "content_hash string, variant_key bigint, duration double")
    cached = spark.createDataFrame([("a", 1, 10.1, 4)], "content_hash string, variant_key bigint, duration double, version int")
    assert [r["content_hash"] for r in H.to_compute(wanted, cached).collect()] == ["b"]
    assert {r["content_hash"]: r["result"] for r in H.lookup(wanted, cached).collect()} == {"a": "hit", "b": "missing"}


def test_frame_validation(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1, float("nan")]), (3, [0.1])], "track_id bigint, probs array<double>")
    assert {r["track_id"]: r["ok"] for r in H.valid_frames(rows, 2).collect()} == {1: True, 2: False, 3: False}
