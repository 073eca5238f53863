"""Raw frames to samples: timing, lap segments, pedals, motion, distance, wheels and flags.

All windows partition by session first, so a single exchange on session_id serves every later
step up to the events. Order is always explicit (sample_index).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.config import DEFAULT, GRAVITY, WHEEL_CHANNELS, WHEELS, Thresholds
from pitwall.functions.expressions import pedal, physical_gear, row_mean, row_sum, stable_id, yes

RAW_COLUMNS = (
    "session_id", "sample_index", "source_frame", "interval_ms", "source_lap_number", "lap_time_ms", "last_lap_ms",
    "position_x", "position_y", "position_z", "velocity_x", "velocity_y", "velocity_z", "yaw", "gas", "brake", "clutch",
    "steer", "gear_raw", "rpm", "drivetrain_speed", "fuel", "fuel_per_lap",
)
#: What derive() reads.
INPUT_COLUMNS = (*RAW_COLUMNS, *[f"wheel_{w}_{c}" for w in WHEELS for c in WHEEL_CHANNELS])
#: Channels that no recording holds, and channels that stand in for one.
UNKNOWN = ("is_in_pit", "is_off_track_candidate")
STAND_INS = {"progress": "share of the distance of its lap", "tc_activity_proxy": "throttle times rear slip", "actual_distance_m": "sum of horizontal steps"}
SAMPLE_COLUMNS = (
    "session_id", "sample_index", "source_frame", "timestamp_s", "dt_s", "lap_id", "lap_segment_index", "source_lap_number", "lap_time_s",
    "position_x", "position_y", "position_z", "actual_distance_m", "normalized_actual_distance", "progress", "progress_source", "progress_confidence",
    "velocity_x", "velocity_y", "velocity_z", "speed_ms", "speed_kmh", "accel_world_x_ms2", "accel_world_z_ms2", "long_accel_ms2", "lat_accel_ms2",
    "long_g", "lat_g", "yaw_rad", "yaw_rate_rad_s", "throttle_raw", "brake_raw", "clutch_raw", "throttle", "brake_n", "clutch_n",
    "steer", "gear_raw", "gear_physical", "rpm", "drivetrain_speed", "fuel", "fuel_per_lap",
    *[f"wheel_{w}_{c}" for w in WHEELS for c in WHEEL_CHANNELS],
    "front_mean_slip_ratio", "rear_mean_slip_ratio", "front_slip_ratio_min", "rear_slip_ratio_max",
    "front_total_load", "rear_total_load", "left_total_load", "right_total_load",
    "is_moving", "is_full_throttle", "is_partial_throttle", "is_braking", "is_coasting", "is_brake_throttle_overlap",
    "is_front_lock_candidate", "is_rear_wheelspin_candidate", "is_in_pit", "is_off_track_candidate", "is_valid_sample",
)
#: Names of the exported table that differ from ours.
EXPORT_NAMES = {**{f"{k}_{a}": f"{k}.{a}" for k in ("position", "velocity") for a in "xyz"}, "steer": "steerAngle", "drivetrain_speed": "drivetrainSpeed", "fuel_per_lap": "fuelPerLap"}


def by_session() -> Window:
    return Window.partitionBy("session_id").orderBy("sample_index")


def by_lap() -> Window:
    return Window.partitionBy("session_id", "lap_id").orderBy("sample_index")


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def lap_segments(raw: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """Add lap_time_s, lap_segment_index and lap_id: a new segment where the lap number changes or the lap time falls."""
    w = by_session()
    df = raw.withColumn("lap_time_s", F.col("lap_time_ms") / F.lit(1000.0))
    df = df.withColumn("__lap", F.coalesce(F.last("source_lap_number", ignorenulls=True).over(running(w)), F.lit(-1)))
    first = F.lag("sample_index").over(w).isNull()
    changed = F.col("__lap") != F.lag("__lap").over(w)
    fell = F.col("lap_time_ms") - F.lag("lap_time_ms").over(w) < F.lit(-config.time_reset_tolerance_ms)
    df = df.withColumn("__new", F.when(first | yes(changed) | yes(fell), 1).otherwise(0))
    df = df.withColumn("lap_segment_index", (F.sum("__new").over(running(w)) - 1).cast("long"))
    return df.withColumn("lap_id", stable_id(F.col("session_id"), F.col("lap_segment_index"))).drop("__lap", "__new")


def timing(df: DataFrame) -> DataFrame:
    """timestamp_s from the first frame on, and dt_s; a step that is not positive counts as the recording interval."""
    w = by_session()
    at = F.col("source_frame") * F.col("interval_ms") / F.lit(1000.0)
    interval = F.col("interval_ms") / F.lit(1000.0)
    df = df.withColumn("__at", at)
    step = F.col("__at") - F.lag("__at").over(w)
    return df.withColumn("timestamp_s", F.col("__at") - F.first("__at").over(running(w))).withColumn("dt_s", F.coalesce(F.when(step > 0, step), interval)).drop("__at")


def pedals(df: DataFrame) -> DataFrame:
    """Normalised pedals; the clutch is scaled by 255 only where the session's values say that it is not in 0..1 already."""
    top = F.max("clutch").over(whole(by_session()))
    clutch = F.when(top > 1.5, F.col("clutch") / F.lit(255.0)).otherwise(F.col("clutch"))
    return df.select(
        "*", F.col("gas").alias("throttle_raw"), F.col("brake").alias("brake_raw"), F.col("clutch").alias("clutch_raw"),
        pedal(F.col("gas")).alias("throttle"), pedal(F.col("brake")).alias("brake_n"),
        F.coalesce(F.least(F.greatest(clutch, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("clutch_n"),
    )


def motion(df: DataFrame) -> DataFrame:
    """Speed, world acceleration, and acceleration along and across the horizontal direction of travel."""
    w = by_session()
    vx, vy, vz = (F.coalesce(F.col(f"velocity_{a}"), F.lit(0.0)) for a in "xyz")
    df = df.withColumn("speed_ms", F.sqrt(vx * vx + vy * vy + vz * vz)).withColumn("speed_kmh", F.col("speed_ms") * F.lit(3.6))
    step = F.greatest(F.col("dt_s"), F.lit(1e-6))
    for axis in "xz":
        v = F.coalesce(F.col(f"velocity_{axis}"), F.lit(0.0))
        df = df.withColumn(f"accel_world_{axis}_ms2", F.coalesce((v - F.lag(v).over(w)) / step, F.lit(0.0)))
    level = F.sqrt(vx * vx + vz * vz)
    df = df.withColumn("__ux", F.when(level > 1.0, vx / level).otherwise(0.0)).withColumn("__uz", F.when(level > 1.0, vz / level).otherwise(0.0))
    ax, az = F.col("accel_world_x_ms2"), F.col("accel_world_z_ms2")
    df = df.withColumn("long_accel_ms2", ax * F.col("__ux") + az * F.col("__uz")).withColumn("lat_accel_ms2", F.col("__ux") * az - F.col("__uz") * ax)
    return df.withColumn("long_g", F.col("long_accel_ms2") / F.lit(GRAVITY)).withColumn("lat_g", F.col("lat_accel_ms2") / F.lit(GRAVITY)).drop("__ux", "__uz")


def heading(df: DataFrame) -> DataFrame:
    """Unwrapped yaw and its rate: each step is taken modulo a full turn into (-pi, pi] and the corrections summed."""
    w = by_session()
    df = df.withColumn("__yaw", F.coalesce(F.last("yaw", ignorenulls=True).over(running(w)), F.lit(0.0)))
    step = F.col("__yaw") - F.lag("__yaw").over(w)
    turn = F.lit(2 * math.pi)
    folded = F.pmod(step + F.lit(math.pi), turn) - F.lit(math.pi)
    folded = F.when((folded == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(folded)
    df = df.withColumn("__fix", F.when(F.abs(step) >= math.pi, folded - step).otherwise(0.0))
    df = df.withColumn("yaw_rad", F.col("__yaw") + F.sum("__fix").over(running(w)))
    rate = (F.col("yaw_rad") - F.lag("yaw_rad").over(w)) / F.greatest(F.col("dt_s"), F.lit(1e-6))
    return df.withColumn("yaw_rate_rad_s", F.coalesce(rate, F.lit(0.0))).drop("__yaw", "__fix")


def position_steps(df: DataFrame) -> DataFrame:
    """Add step_m, the horizontal step within the lap; the first is 0."""
    w = by_lap()
    dx, dz = (F.coalesce(F.col(f"position_{a}") - F.lag(f"position_{a}").over(w), F.lit(0.0)) for a in "xz")
    return df.withColumn("__dx", dx).withColumn("__dz", dz).withColumn("step_m", F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dz") * F.col("__dz"))).drop("__dx", "__dz")


def distance(df: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """Distance along the lap without jumps, its share of the lap, and the progress derived from it."""
    w = by_lap()
    df = df if "step_m" in df.columns else position_steps(df)
    df = df.withColumn("actual_distance_m", F.sum(F.when(F.col("step_m") > config.position_jump_threshold_m, 0.0).otherwise(F.col("step_m"))).over(running(w)))
    total = F.last("actual_distance_m").over(whole(w))
    df = df.withColumn("normalized_actual_distance", F.when(total > 0, F.col("actual_distance_m") / total))
    return df.select(
        "*", F.col("normalized_actual_distance").alias("progress"), F.lit("cumulative_distance_proxy").alias("progress_source"),
        F.when(F.col("normalized_actual_distance").isNotNull(), 0.55).otherwise(0.0).alias("progress_confidence"),
    )


def position_jumps(df: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """The quality-flag row of each step beyond the threshold."""
    return df.where(F.col("step_m") > config.position_jump_threshold_m).select(
        F.lit("warning").alias("severity"), F.lit("POSITION_JUMP").alias("code"), "session_id", "lap_id",
        F.col("sample_index").alias("sample_start"), F.col("sample_index").alias("sample_end"),
        F.lit(f"Position step exceeded {config.position_jump_threshold_m:g} m").alias("message"), F.lit("position.x,position.z").alias("affected_channels"),
    )


def wheels(df: DataFrame) -> DataFrame:
    slip = {w: F.col(f"wheel_{w}_slip_ratio") for w in WHEELS}
    load = {w: F.col(f"wheel_{w}_load") for w in WHEELS}
    return df.select(
        "*",
        row_mean(slip["fl"], slip["fr"]).alias("front_mean_slip_ratio"), row_mean(slip["rl"], slip["rr"]).alias("rear_mean_slip_ratio"),
        F.least(slip["fl"], slip["fr"]).alias("front_slip_ratio_min"), F.greatest(slip["rl"], slip["rr"]).alias("rear_slip_ratio_max"),
        row_sum(load["fl"], load["fr"]).alias("front_total_load"), row_sum(load["rl"], load["rr"]).alias("rear_total_load"),
        row_sum(load["fl"], load["rl"]).alias("left_total_load"), row_sum(load["fr"], load["rr"]).alias("right_total_load"),
    )


def flags(df: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """Boolean channels; a comparison with a missing value is false. What the recording doesn't hold stays unknown."""
    throttle, brake, speed = F.col("throttle"), F.col("brake_n"), F.col("speed_kmh")
    released = brake < config.pedal_zero_threshold
    braking = brake >= config.brake_active_threshold
    named: dict[str, Column] = {
        "is_moving": speed >= config.moving_speed_threshold_kmh,
        "is_full_throttle": (throttle >= config.full_throttle_threshold) & released,
        "is_partial_throttle": (throttle >= config.pedal_zero_threshold) & (throttle < config.full_throttle_threshold) & released,
        "is_braking": braking,
        "is_coasting": (throttle < config.pedal_zero_threshold) & released,
        "is_brake_throttle_overlap": (throttle >= config.pedal_zero_threshold) & braking,
        "is_front_lock_candidate": braking & (speed >= config.lockup_minimum_speed_kmh) & (F.col("front_slip_ratio_min") <= config.lockup_slip_ratio_threshold),
        "is_rear_wheelspin_candidate": (throttle >= config.wheelspin_minimum_throttle) & (speed >= config.wheelspin_minimum_speed_kmh) & (F.col("rear_slip_ratio_max") >= config.wheelspin_slip_ratio_threshold),
        "is_valid_sample": F.col("lap_time_s").isNotNull() & speed.isNotNull(),
    }
    unknown = [F.lit(None).cast("boolean").alias(n) for n in UNKNOWN]
    return df.select("*", *[yes(c).alias(n) for n, c in named.items()], *unknown)


def derive(raw: DataFrame, config: Thresholds = DEFAULT) -> DataFrame:
    """All sample channels, and last_lap_ms and step_m for what follows. Input columns: RAW_COLUMNS and the 28 wheel columns."""
    df = motion(pedals(timing(lap_segments(raw, config))))
    df = flags(wheels(distance(position_steps(heading(df)), config)), config)
    return df.withColumn("gear_physical", physical_gear(F.col("gear_raw")))


def samples(derived: DataFrame) -> DataFrame:
    """The 90 columns of the stored table."""
    return derived.select(*SAMPLE_COLUMNS)
