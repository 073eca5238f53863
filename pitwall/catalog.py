"""Queries over the test tables for every operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall import adapter, roundtrip_oracles, roundtrips
from pitwall.functions.expressions import recorded_at, stable_id
from pitwall import oracles
from pitwall.operators import channels, events, islands, laps, segments, setups, stats
from pitwall.sources.files import scratch

DIGITS = 6


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, so that the order of additions doesn't show; no negative zero."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.frames(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _derived(spark, sf_dir):
    return channels.derive(_raw(spark, sf_dir))


def _staged(spark, sf_dir):
    """The samples written and read back, for queries that read them more than once."""
    path = scratch(spark, "derived")
    _derived(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _laps(spark, sf_dir):
    return laps.build(_derived(spark, sf_dir))


def _passes(spark, sf_dir):
    derived = _staged(spark, sf_dir)
    return segments.passes(derived, laps.build(derived), segments.expand(adapter.DEFINITIONS))


def _sessions(spark, sf_dir):
    """Sessions with a setup each: one of three, or none."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return users.select(F.col("user_id").cast("string").alias("session_id"), F.when(F.col("user_id") % 4 < 3, F.concat(F.lit("setup-"), (F.col("user_id") % 4).cast("string"))).alias("setup_id"))


def _pick(make: Callable, *columns: str) -> Callable:
    return lambda spark, sf_dir: _rounded(make(spark, sf_dir).select(*columns))


KEY = ("session_id", "sample_index")


def _true_runs(spark, sf_dir):
    df = islands.true_runs(_derived(spark, sf_dir), "is_braking")
    return df.groupBy("session_id", "lap_id", "run_id").agg(F.min("sample_index").alias("first_sample"), F.max("sample_index").alias("last_sample"), F.count("*").alias("n"))


def _gap_close(spark, sf_dir):
    df = _derived(spark, sf_dir).withColumn("closed", F.col("is_braking"))
    return islands.close_gaps(df, "closed", islands.gap_samples(0.15)).select(*KEY, "is_braking", "closed")


def _lap_counts(spark, sf_dir):
    derived = _staged(spark, sf_dir)
    counted = laps.with_event_counts(laps.build(derived), events.detect_all(derived))
    return counted.select("session_id", "lap_id", "braking_event_count", "shift_count", "lockup_event_count", "wheelspin_event_count")


def _rollup(spark, sf_dir):
    derived = _staged(spark, sf_dir)
    rolled = laps.sessions(derived, laps.build(derived))
    label = laps.session_label(F.lit("recording"), F.when(F.col("session_id").cast("long") % 2 == 0, F.concat(F.lit("driver "), "session_id")).otherwise(""), F.concat(F.lit("car "), "session_id"), F.when(F.col("session_id").cast("long") % 5 == 0, 1).otherwise(2))
    return rolled.withColumn("session_label", label)


def _segment_expand(spark, sf_dir):
    rows = segments.expand(adapter.DEFINITIONS)
    return spark.createDataFrame(rows, segments.DEFINITION)


def _statistics(spark, sf_dir):
    return stats.segment_statistics(_passes(spark, sf_dir), _sessions(spark, sf_dir))


def _counts(spark, sf_dir):
    derived = _staged(spark, sf_dir)
    return stats.dataset_counts(_sessions(spark, sf_dir), laps.build(derived), channels.position_jumps(derived))


def _categories(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = F.array(*[F.lit(n) for n in ("wing_front", "INTERNAL_GEAR_2", "Diff_power", "TYRES", "camber_lf", "ROD_LENGTH_RR", "engine", "arb_rear")])
    return setups.with_category(part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")).alias("section")))


def _merged(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.where("o_orderkey % 3 < 2").unionByName(orders.where("o_orderkey % 3 > 0"), allowMissingColumns=True).distinct()


def _ids(spark, sf_dir):
    cars = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return cars.select("s_suppkey", stable_id(F.lit("race.bin"), F.col("s_name"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey"))).alias("session_id"))


def _file_times(spark, sf_dir):
    c = F.col("c_custkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    stamp = F.concat(two(c % 31 + 1), two(c % 12 + 1), two(c % 100), F.lit("-"), two(c % 24), two(c % 60), two(c * 7 % 60))
    name = F.when(c % 9 == 0, F.concat(F.lit("lap_"), stamp)).otherwise(F.concat(F.lit("AC_"), stamp, F.lit("_R_car_track.rec")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", name.alias("file_name")).withColumn("recorded_at", F.date_format(recorded_at(F.col("file_name")), "yyyy-MM-dd HH:mm:ss"))


LAP_KEY = ("session_id", "lap_id", "lap_segment_index")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lap_segments": _pick(lambda s, d: channels.lap_segments(_raw(s, d)), *KEY, "lap_segment_index", "lap_id", "lap_time_s"),
    "dt_timestamp": _pick(lambda s, d: channels.timing(_raw(s, d)), *KEY, "timestamp_s", "dt_s"),
    "pedal_normalize": _pick(lambda s, d: channels.pedals(_raw(s, d)), *KEY, "throttle_raw", "brake_raw", "throttle", "brake_n"),
    "clutch_conditional_scale": _pick(lambda s, d: channels.pedals(_raw(s, d)), *KEY, "clutch_raw", "clutch_n"),
    "speed_norm": _pick(_derived, *KEY, "speed_ms", "speed_kmh"),
    "accel_lag": _pick(_derived, *KEY, "accel_world_x_ms2", "accel_world_z_ms2"),
    "long_lat_g": _pick(_derived, *KEY, "long_accel_ms2", "lat_accel_ms2", "long_g", "lat_g"),
    "yaw_unwrap": _pick(_derived, *KEY, "yaw_rad", "yaw_rate_rad_s"),
    "gear_physical": _pick(_derived, *KEY, "gear_raw", "gear_physical"),
    "wheel_row_aggs": _pick(_derived, *KEY, "front_mean_slip_ratio", "rear_mean_slip_ratio", "front_slip_ratio_min", "rear_slip_ratio_max", "front_total_load", "rear_total_load", "left_total_load", "right_total_load"),
    "sample_flags": _pick(_derived, *KEY, "is_moving", "is_full_throttle", "is_partial_throttle", "is_braking", "is_coasting", "is_brake_throttle_overlap", "is_front_lock_candidate", "is_rear_wheelspin_candidate", "is_valid_sample"),
    "lap_distance": _pick(_derived, *KEY, "actual_distance_m"),
    "lap_progress": _pick(_derived, *KEY, "normalized_actual_distance", "progress", "progress_source", "progress_confidence"),
    "position_jumps": _pick(lambda s, d: channels.position_jumps(_derived(s, d)), "severity", "code", "session_id", "lap_id", "sample_start", "sample_end", "message", "affected_channels"),
    "lap_summary": _pick(_laps, *LAP_KEY, "source_lap_number", "start_sample", "end_sample", "sample_count", "start_fuel", "end_fuel", "fuel_used", "actual_distance_m", "max_speed_kmh", "mean_speed_kmh", "min_speed_kmh", "max_rpm"),
    "lap_conditional_time": _pick(_laps, *LAP_KEY, "full_throttle_time_s", "partial_throttle_time_s", "braking_time_s", "coasting_time_s", "overlap_time_s", "front_lock_time_s", "rear_wheelspin_time_s"),
    "lap_percentages": _pick(_laps, *LAP_KEY, "full_throttle_pct", "partial_throttle_pct", "braking_pct", "coasting_pct"),
    "lap_integrals": _pick(_laps, *LAP_KEY, "front_slip_integral", "rear_slip_integral", "rear_tire_stress_proxy"),
    "lap_completeness": _pick(_laps, *LAP_KEY, "is_complete", "is_valid", "is_replay_fragment", "official_lap_time_s", "lap_time_s"),
    "lap_classification": _pick(_laps, *LAP_KEY, "lap_class", "classification_confidence", "classification_reasons"),
    "session_rollup": _pick(_rollup, "session_id", "frame_count", "lap_count_total", "lap_count_complete", "session_duration_s", "session_label"),
    "true_runs": _true_runs,
    "gap_close": _gap_close,
    "braking_events": lambda s, d: _rounded(events.braking(_derived(s, d)).drop("release_duration_s", "release_slope_per_s", "release_monotonicity")),
    "braking_release": _pick(lambda s, d: events.braking(_derived(s, d)), "event_id", "release_duration_s", "release_slope_per_s", "release_monotonicity"),
    "throttle_events": lambda s, d: _rounded(events.throttle(_derived(s, d))),
    "gear_shifts": lambda s, d: _rounded(events.shifts(_derived(s, d))),
    "lockup_events": lambda s, d: _rounded(events.lockups(_derived(s, d))),
    "wheelspin_events": lambda s, d: _rounded(events.wheelspin(_derived(s, d))),
    "lap_event_counts": _lap_counts,
    "segment_expand": _segment_expand,
    "segment_passes": lambda s, d: _rounded(_passes(s, d).drop("steering_sign_changes", "actual_path_length_m")),
    "segment_path": _pick(_passes, "session_id", "lap_id", "segment_id", "steering_sign_changes", "actual_path_length_m"),
    "segment_statistics": lambda s, d: _rounded(_statistics(s, d).drop("best_3_mean_time_s")),
    "segment_best3": _pick(_statistics, "setup_id", "segment_id", "best_3_mean_time_s"),
    "best_laps": _pick(lambda s, d: laps.best(_laps(s, d)), "lap_id", "session_id", "lap_time_s", "source_lap_number"),
    "dataset_counts": _counts,
    "setup_category": _categories,
    "setup_diffs": lambda s, d: _rounded(setups.differences(setups.with_category(adapter.setups(s.read.parquet(f"{d}/part.parquet")))).select(*setups.DIFF_COLUMNS)),
    "merge_distinct": _merged,
    "stable_ids": _ids,
    "filename_datetime": _file_times,
}
QUERIES |= roundtrips.QUERIES
ORACLES = oracles.ORACLES | roundtrip_oracles.ORACLES
