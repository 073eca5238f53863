import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.functions.expressions import recorded_at, setup_category, stable_id
from pitwall.operators import channels, events, islands, segments, setups, stats
from pitwall.sources import setup_files


def flagged(spark, groups):
    return spark.createDataFrame([(f"s{g}", "l", i, v) for g, flags in enumerate(groups) for i, v in enumerate(flags)], "session_id string, lap_id string, sample_index long, f boolean")


def closed(flags, most):
    out, i = list(flags), 0
    while i < len(out):
        if not out[i]:
            j = i
            while j < len(out) and not flags[j]:
                j += 1
            if i > 0 and j < len(out) and j - i <= most:
                out[i:j] = [True] * (j - i)
            i = j
        else:
            i += 1
    return out


def test_small_vectors(spark):
    df = islands.true_runs(flagged(spark, [[False, True, True, False, True]]), "f")
    runs = df.groupBy("run_id").agg(F.min("sample_index"), F.max("sample_index")).orderBy("run_id").collect()
    assert [tuple(r)[1:] for r in runs] == [(1, 2), (4, 4)]
    out = islands.close_gaps(flagged(spark, [[True, False, True, False, False, True]]), "f", 1).orderBy("sample_index").collect()
    assert [r.f for r in out] == [True, True, True, False, False, True]


def test_random_islands(spark):
    r = random.Random(3)
    groups = [[r.random() < 0.5 for _ in range(r.randint(1, 30))] for _ in range(60)]
    got = islands.close_gaps(flagged(spark, groups), "f", 2).orderBy("session_id", "sample_index").collect()
    found = {}
    for row in got:
        found.setdefault(row.session_id, []).append(row.f)
    assert all(found[f"s{g}"] == closed(flags, 2) for g, flags in enumerate(groups))


def test_gap_rounds_half_to_even(spark):
    df = spark.createDataFrame([("s", "l", i, 0.06) for i in range(4)], "session_id string, lap_id string, sample_index long, dt_s double")
    assert df.select(islands.gap_samples(0.15).alias("n")).first().n == 2
    assert df.select(islands.gap_samples(0.001).alias("n")).first().n == 1


def test_unwrap_equals_numpy(spark):
    r = np.random.default_rng(1)
    groups = {f"s{g}": r.uniform(-7, 7, 40) for g in range(20)}
    df = spark.createDataFrame([(s, i, float(v), 0.01) for s, vs in groups.items() for i, v in enumerate(vs)], "session_id string, sample_index long, yaw double, dt_s double")
    got = {}
    for row in channels.heading(df).orderBy("session_id", "sample_index").collect():
        got.setdefault(row.session_id, []).append(row.yaw_rad)
    for s, vs in groups.items():
        assert np.allclose(got[s], np.unwrap(vs), atol=1e-9)


def test_missing_values_are_never_true(spark):
    df = spark.createDataFrame([(None, None, 10.0, None, None, None)], "throttle double, brake_n double, speed_kmh double, front_slip_ratio_min double, rear_slip_ratio_max double, lap_time_s double")
    row = channels.flags(df).first()
    assert not any(row[c] for c in ("is_full_throttle", "is_braking", "is_coasting", "is_front_lock_candidate", "is_valid_sample")) and row.is_in_pit is None


def test_peak_of_a_plateau_is_its_first_sample(spark):
    brake = [0.0, 0.5, 0.9, 0.9, 0.6, 0.7, 0.2, 0.0]
    rows = [("s", "l", i, b, 0.1, i * 0.1, 100.0 - i, float(i), i / 10, 0.0, False, False, b >= 0.1) for i, b in enumerate(brake)]
    df = spark.createDataFrame(rows, "session_id string, lap_id string, sample_index long, brake_n double, dt_s double, lap_time_s double, speed_kmh double, actual_distance_m double, progress double, steer double, is_front_lock_candidate boolean, is_rear_wheelspin_candidate boolean, is_braking boolean")
    e = events.braking(df).first()
    assert (e.start_sample, e.end_sample, e.peak_brake) == (1, 6, 0.9)
    assert abs(e.release_duration_s - 0.5) < 1e-9 and abs(e.time_to_90pct_peak_s - 0.1) < 1e-9 and abs(e.release_monotonicity - 0.75) < 1e-9


def test_file_times(spark):
    names = ["AC_300726-155603_O_car_track.csv", "AC_310230-000000_x", "plain", "AC_010170-010101_"]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(recorded_at(F.col("n")).alias("t")).collect()]
    assert got == [datetime.datetime(2026, 7, 30, 15, 56, 3), None, None, datetime.datetime(1970, 1, 1, 1, 1, 1)]


def test_ids_equal_hashlib(spark):
    import hashlib

    row = spark.range(1).select(stable_id(F.lit("a"), F.lit(None), F.lit(7)).alias("i")).first()
    assert row.i == hashlib.sha256(b"a\x1fNone\x1f7").hexdigest()[:16]


def test_setup_values_and_files(spark, tmp_path):
    ini = tmp_path / "base.ini"
    ini.write_bytes("﻿[WING_1]\nVALUE=007\nValue=1.50\n[CAR]\nMODEL=gt\nABS=TRUE\n[WING_1]\nVALUE=8\n".encode())
    (tmp_path / "base.sp").write_text("[TYRES]\nX=1_000\n")
    rows = {(r.section, r.parameter): r for r in setup_files.bundle(spark, str(ini), str(tmp_path / "base.sp")).collect()}
    assert rows["WING_1", "VALUE"].value_text == "8" and rows["WING_1", "Value"].value_text == "1.5" and rows["CAR", "ABS"].value_numeric == 1.0
    assert rows["SP:TYRES", "X"].category == "tyres" and rows["SP:TYRES", "X"].value_numeric == 1000.0 and len({r.setup_id for r in rows.values()}) == 1
    assert rows["CAR", "MODEL"].value_numeric is None and rows["WING_1", "VALUE"].setup_label == "base"


def test_setup_differences(spark):
    rows = [("b", "S", "x", 1.0, "1", 0), ("b", "S", "x", 5.0, "5", 1), ("b", "S", "t", None, "soft", 2), ("a", "S", "x", 3.0, "3", 3), ("a", "S", "y", 2.0, "2", 4), ("a", "S", "t", None, "soft", 5)]
    table = spark.createDataFrame(rows, "setup_id string, section string, parameter string, value_numeric double, value_text string, ord long").withColumn("category", setup_category(F.col("section")))
    got = {r.parameter: r for r in setups.differences(table).collect()}
    assert (got["x"].base_setup_id, got["x"].absolute_numeric_change, got["x"].values_equal) == ("b", 2.0, False)
    assert got["t"].values_equal and got["t"].absolute_numeric_change is None and got["y"].base_value is None and not got["y"].values_equal


def test_segment_definitions(tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"coordinate": "nowhere", "segments": []}')
    with pytest.raises(ValueError):
        setup_files.load_definitions(str(path))
    assert segments.expand({"segments": [{"id": "a", "start": 0, "end": 1, "subsegments": [{"id": "b", "start": 0, "end": 0.5}]}]})[1][:3] == ("b", "b", "a")


def test_many_definitions_meet_by_cells(spark):
    r = random.Random(5)
    definitions = spark.createDataFrame([(n, f"s{n}", None, None, "actual_distance_m", r.uniform(0, 90), r.uniform(0, 90)) for n in range(40)], f"__n int, {segments.DEFINITION}")
    samples = spark.createDataFrame([(r.uniform(-10, 110) if k % 9 else None,) for k in range(300)], "actual_distance_m double")
    few, many = (sorted(map(tuple, segments.members(samples, definitions, "actual_distance_m", n).select("__at", "__n").collect())) for n in (1, 10**6))
    assert few == many and few


def test_statistics_of_groups_without_values(spark):
    passes = spark.createDataFrame([("s1", "l1", "x", "X", 2.0, 1.0, 1.0, 1.0, None, None, 0.0, False)], "session_id string, lap_id string, segment_id string, segment_name string, segment_time_s double, entry_speed_kmh double, minimum_speed_kmh double, exit_speed_kmh double, brake_start_position double, full_throttle_position double, coasting_time_s double, valid_for_comparison boolean")
    row = stats.segment_statistics(passes, spark.createDataFrame([("s1", None)], "session_id string, setup_id string")).first()
    assert row.setup_id is None and row.valid_pass_count == 0 and row.time_s_std == 0.0 and row.brake_start_count is None and row.brake_start_mean is None and row.best_3_mean_time_s == 2.0
    assert len(row) == 69
