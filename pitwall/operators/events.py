"""Braking, throttle, shift, lock-up and wheel-spin events; none crosses a lap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.config import DEFAULT, Thresholds
from pitwall.functions.expressions import stable_id

from .channels import by_lap
from .islands import LAP, close_gaps, gap_samples, true_runs

RUN = (*LAP, "run_id")
PEAK_SHARE, RELEASE_TOLERANCE, HALF_THROTTLE, LIFT = 0.90, 0.01, 0.50, -0.20
I = "sample_index"
BASE_COLUMNS = (
    "event_id", "session_id", "lap_id", "event_type", "start_sample", "end_sample", "start_time_s", "end_time_s", "duration_s",
    "start_distance_m", "end_distance_m", "start_progress", "end_progress",
)


def _first(column: str | Column) -> Column:
    return F.min_by(column, I)


def _last(column: str | Column) -> Column:
    return F.max_by(column, I)


def _base() -> list[Column]:
    return [
        F.min(I).alias("start_sample"), F.max(I).alias("end_sample"), _first("lap_time_s").alias("start_time_s"), _last("lap_time_s").alias("end_time_s"),
        F.sum("dt_s").alias("duration_s"), _first("actual_distance_m").alias("start_distance_m"), _last("actual_distance_m").alias("end_distance_m"),
        _first("progress").alias("start_progress"), _last("progress").alias("end_progress"),
    ]


def _named(events: DataFrame, kind: str, more: tuple[str, ...]) -> DataFrame:
    typed = events.withColumn("event_type", F.lit(kind)).withColumn("event_id", stable_id(F.col("lap_id"), F.col("event_type"), F.col("start_sample")))
    return typed.select(*BASE_COLUMNS, *more)


def _when_time(flag: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(flag), F.col("dt_s"))), F.lit(0.0))


BRAKING = (
    "entry_speed_kmh", "release_speed_kmh", "minimum_speed_kmh", "peak_brake", "mean_brake", "brake_impulse_proxy_s", "time_to_90pct_peak_s",
    "release_duration_s", "release_slope_per_s", "release_monotonicity", "steer_at_start", "steer_at_release", "front_lock_time_s", "rear_wheelspin_time_s",
)


def braking(samples: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    runs = true_runs(close_gaps(samples.withColumn("__on", F.col("is_braking")), "__on", gap_samples(config.brake_gap_close_s)), "__on")
    whole = Window.partitionBy(*RUN)
    runs = runs.withColumn("__peak", F.max("brake_n").over(whole))
    runs = runs.withColumn("__peak_at", F.min(F.when(F.col("brake_n") == F.col("__peak"), F.col(I))).over(whole))
    change = F.col("brake_n") - F.lag("brake_n").over(whole.orderBy("sample_index"))
    runs = runs.withColumn("__falls", F.when(F.col(I) > F.col("__peak_at"), F.when(change <= RELEASE_TOLERANCE, 1.0).otherwise(0.0)))
    releasing = F.col(I) >= F.col("__peak_at")
    events = runs.groupBy(*RUN).agg(
        *_base(), _first("speed_kmh").alias("entry_speed_kmh"), _last("speed_kmh").alias("release_speed_kmh"), F.min("speed_kmh").alias("minimum_speed_kmh"),
        F.max("brake_n").alias("peak_brake"), F.avg("brake_n").alias("mean_brake"), F.sum(F.col("brake_n") * F.col("dt_s")).alias("brake_impulse_proxy_s"),
        F.min_by("lap_time_s", F.when(F.col("brake_n") >= F.lit(PEAK_SHARE) * F.col("__peak"), F.col(I))).alias("__near_peak"),
        F.sum(F.when(releasing, F.col("dt_s"))).alias("release_duration_s"), F.min_by("brake_n", F.when(releasing, F.col(I))).alias("__from"), _last("brake_n").alias("__to"),
        F.coalesce(F.avg("__falls"), F.lit(1.0)).alias("release_monotonicity"), _first("steer").alias("steer_at_start"), _last("steer").alias("steer_at_release"),
        _when_time("is_front_lock_candidate").alias("front_lock_time_s"), _when_time("is_rear_wheelspin_candidate").alias("rear_wheelspin_time_s"),
    )
    events = events.where((F.col("duration_s") >= config.minimum_brake_event_s) & (F.col("entry_speed_kmh") >= config.minimum_brake_entry_speed_kmh))
    slope = F.when(F.col("release_duration_s") > 0, (F.col("__to") - F.col("__from")) / F.col("release_duration_s"))
    return _named(events.withColumn("time_to_90pct_peak_s", F.col("__near_peak") - F.col("start_time_s")).withColumn("release_slope_per_s", slope), "braking", BRAKING)


THROTTLE = (
    "start_speed_kmh", "initial_throttle", "peak_throttle", "time_to_50pct_s", "time_to_full_throttle_s", "ramp_rate_per_s", "steer_at_pickup", "steer_at_full_throttle",
    "yaw_rate_at_pickup_rad_s", "rear_slip_at_pickup", "rear_slip_peak", "countersteer_proxy", "throttle_lift_within_event", "tc_activity_proxy",
)


def throttle(samples: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    runs = true_runs(samples.withColumn("__on", F.col("throttle") >= config.throttle_event_threshold), "__on")
    change = F.col("throttle") - F.lag("throttle").over(Window.partitionBy(*RUN).orderBy("sample_index"))
    runs = runs.withColumn("__change", change)
    full = F.when(F.col("throttle") >= config.full_throttle_threshold, F.col(I))
    slip = F.when(F.col("rear_slip_ratio_max").isNotNull(), F.greatest(F.col("rear_slip_ratio_max"), F.lit(0.0)))
    events = runs.groupBy(*RUN).agg(
        *_base(), _first("speed_kmh").alias("start_speed_kmh"), _first("throttle").alias("initial_throttle"), F.max("throttle").alias("peak_throttle"),
        F.min_by("lap_time_s", F.when(F.col("throttle") >= HALF_THROTTLE, F.col(I))).alias("__half"), F.min_by("lap_time_s", full).alias("__full"),
        _first("steer").alias("steer_at_pickup"), F.min_by("steer", full).alias("steer_at_full_throttle"), _first("yaw_rate_rad_s").alias("yaw_rate_at_pickup_rad_s"),
        _first("rear_slip_ratio_max").alias("rear_slip_at_pickup"), F.max("rear_slip_ratio_max").alias("rear_slip_peak"),
        (F.count_distinct(F.signum("steer")) > 1).alias("countersteer_proxy"), F.coalesce(F.bool_or(F.col("__change") < LIFT), F.lit(False)).alias("throttle_lift_within_event"),
        F.coalesce(F.sum(F.col("throttle") * slip * F.col("dt_s")), F.lit(0.0)).alias("tc_activity_proxy"),
    ).where(F.col("duration_s") >= config.minimum_throttle_event_s)
    events = events.withColumn("time_to_50pct_s", F.col("__half") - F.col("start_time_s")).withColumn("time_to_full_throttle_s", F.col("__full") - F.col("start_time_s"))
    ramp = F.col("peak_throttle") / F.greatest(F.when(F.col("time_to_full_throttle_s") > 0, F.col("time_to_full_throttle_s")).otherwise(F.col("duration_s")), F.lit(1e-6))
    return _named(events.withColumn("ramp_rate_per_s", ramp), "throttle_application", THROTTLE)


SHIFTS = ("from_gear", "to_gear", "direction", "speed_before_kmh", "speed_after_kmh", "rpm_before", "rpm_after", "rpm_drop", "long_g_before", "long_g_after", "neutral_samples_between")


def shifts(samples: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """A change between successive driving gears; the row before is the last one with a driving gear."""
    w = by_lap()
    driving = samples.where("gear_physical > 0")
    before = lambda c: F.lag(c).over(w)
    pairs = driving.select(
        *LAP, "sample_index", "lap_time_s", "dt_s", "actual_distance_m", "progress", F.col("gear_physical").alias("to_gear"), before("gear_physical").alias("from_gear"),
        F.col("speed_kmh").alias("speed_after_kmh"), before("speed_kmh").alias("speed_before_kmh"), F.col("rpm").alias("rpm_after"), before("rpm").alias("rpm_before"),
        F.col("long_g").alias("long_g_after"), before("long_g").alias("long_g_before"), before("sample_index").alias("__before"),
    ).where("from_gear IS NOT NULL AND from_gear <> to_gear")
    # The event is the sample with the new gear alone.
    events = pairs.select(
        *LAP, F.col("sample_index").alias("start_sample"), F.col("sample_index").alias("end_sample"), F.col("lap_time_s").alias("start_time_s"), F.col("lap_time_s").alias("end_time_s"),
        F.col("dt_s").alias("duration_s"), F.col("actual_distance_m").alias("start_distance_m"), F.col("actual_distance_m").alias("end_distance_m"),
        F.col("progress").alias("start_progress"), F.col("progress").alias("end_progress"), "from_gear", "to_gear",
        F.when(F.col("to_gear") > F.col("from_gear"), "up").otherwise("down").alias("direction"), "speed_before_kmh", "speed_after_kmh", "rpm_before", "rpm_after",
        (F.col("rpm_before") - F.col("rpm_after")).alias("rpm_drop"), "long_g_before", "long_g_after", (F.col("sample_index") - F.col("__before") - 1).alias("neutral_samples_between"),
    )
    return _named(events, "gear_shift", SHIFTS)


WHEEL_EVENT = ("primary_wheel", "extreme_slip_ratio", "entry_speed_kmh", "mean_brake", "mean_throttle", "mean_abs_steer")


def _wheel_event(samples: DataFrame, kind: str, flag: str, wheels: tuple[str, str], lowest: bool, config: Thresholds) -> DataFrame:
    runs = true_runs(close_gaps(samples.withColumn("__on", F.col(flag)), "__on", gap_samples(config.wheel_event_gap_close_s)), "__on")
    extreme = F.min if lowest else F.max
    a, b = (F.col(f"__{w}") for w in wheels)
    events = runs.groupBy(*RUN).agg(
        *_base(), *[extreme(f"wheel_{w}_slip_ratio").alias(f"__{w}") for w in wheels], _first("speed_kmh").alias("entry_speed_kmh"),
        F.avg("brake_n").alias("mean_brake"), F.avg("throttle").alias("mean_throttle"), F.avg(F.abs("steer")).alias("mean_abs_steer"),
    ).where(F.col("duration_s") >= config.minimum_wheel_event_s)
    ahead = b.isNull() | ((a <= b) if lowest else (a >= b))
    events = events.withColumn("primary_wheel", F.when(a.isNotNull() & ahead, wheels[0]).when(b.isNotNull(), wheels[1]))
    return _named(events.withColumn("extreme_slip_ratio", F.least(a, b) if lowest else F.greatest(a, b)), kind, WHEEL_EVENT)


def lockups(samples: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    return _wheel_event(samples, "front_lockup_candidate", "is_front_lock_candidate", ("fl", "fr"), True, config)


def wheelspin(samples: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    return _wheel_event(samples, "rear_wheelspin_candidate", "is_rear_wheelspin_candidate", ("rl", "rr"), False, config)


def detect_all(samples: DataFrame, config: Thresholds = DEFAULT) -> dict[str, DataFrame]:
    """The five event tables."""
    found = {"braking": braking, "throttle": throttle, "shifts": shifts, "lockups": lockups, "wheelspin": wheelspin}
    return {f"events/{name}": detect(samples, config) for name, detect in found.items()}
