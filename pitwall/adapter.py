"""Any ordered event table as raw telemetry frames, so that every operator runs on tables without recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.config import WHEELS

SLIP = dict(zip(WHEELS, (13, 17, 23, 19), strict=True))
LOAD = dict(zip(WHEELS, (7, 11, 13, 17), strict=True))
#: Remainders of event_id at which a wheel's slip ratio and load are missing: one of an axle, or both.
ABSENT = {"fl": ((31, 0), (41, 0)), "fr": ((31, 0, 1), (41, 0, 2)), "rl": ((37, 0), (43, 0)), "rr": ((37, 0, 1), (43, 0, 3))}
#: Segments over the distance of a lap: adjacent bounds, a parent with children, and one across the start line.
DEFINITIONS = {
    "coordinate": "actual_distance_m",
    "segments": [
        {"id": "s1", "name": "Start", "start": 0, "end": 5},
        {"id": "s2", "name": "Middle", "start": 5, "end": 20, "subsegments": [{"id": "s2a", "name": "Entry", "start": 5, "end": 12}, {"id": "s2b", "start": 12, "end": 20}]},
        {"id": "s3", "name": "End", "start": 20, "end": 90},
        {"id": "s4", "name": "Line", "start": 15, "end": 3},
    ],
}


def frames(events: DataFrame) -> DataFrame:
    """Raw frames of each user as a session; pseudo-channels are derived from event_id, value and props."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e, v = F.col("event_id"), F.col("value")
    df = events.withColumn("sample_index", F.row_number().over(w).cast("long") - 1).withColumn("__laps", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(sofar))
    since = Window.partitionBy("user_id", "__laps").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    df = df.withColumn("__k", k).withColumn("__first", F.first("ts").over(since))
    # Channels drop out at some frames, and every tenth frame is missing.
    absent = lambda value, of, *at: F.when(~(e % of).isin(*at), value)
    return df.select(
        F.col("user_id").cast("string").alias("session_id"), "sample_index", (F.col("sample_index") + F.floor(F.col("sample_index") / 10)).alias("source_frame"), F.lit(60.0).alias("interval_ms"),
        F.floor(F.col("__laps") / 2).cast("long").alias("source_lap_number"), F.expr("timestampdiff(MICROSECOND, __first, ts) div 1000").alias("lap_time_ms"),
        (F.lit(1000) * (e * 11 % 5)).cast("long").alias("last_lap_ms"),
        F.sum(v / 20 * 0.6).over(sofar).alias("position_x"), F.lit(0.0).alias("position_y"), F.sum(v / 20 * 0.8).over(sofar).alias("position_z"),
        absent(v / 3.6 * 0.6, 59, 0).alias("velocity_x"), F.lit(0.0).alias("velocity_y"), (v / 3.6 * 0.8).alias("velocity_z"), absent((e * 29 % 628 - 314) / 100.0, 29, 0).alias("yaw"),
        absent(F.col("__k") * 255.0 / 100.0, 47, 0).alias("gas"), absent(F.greatest(F.lit(0), e * 37 % 100 - 50) * 255.0 / 50.0, 53, 0).alias("brake"), (e * 5 % 256).cast("double").alias("clutch"),
        ((e % 21 - 10) / 10.0).alias("steer"), (e % 7).alias("gear_raw"), (F.lit(1000.0) + e * 17 % 7000).alias("rpm"), (v / 3.6).alias("drivetrain_speed"),
        (F.lit(100.0) - F.col("sample_index") * 0.1).alias("fuel"), F.lit(2.5).alias("fuel_per_lap"),
        *[absent((e * SLIP[x] % 100 - 50) / 100.0, *ABSENT[x][0]).alias(f"wheel_{x}_slip_ratio") for x in WHEELS], *[absent((e * LOAD[x] % 4000).cast("double"), *ABSENT[x][1]).alias(f"wheel_{x}_load") for x in WHEELS],
        *[F.lit(None).cast("double").alias(f"wheel_{x}_{c}") for x in WHEELS for c in ("angular_velocity", "slip_angle", "position_x", "position_y", "position_z")],
    )


def setups(part: DataFrame) -> DataFrame:
    """Brands as setups, types as parameters, sizes as values; of a key the lowest part counts, some keys are left out."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    first = part.withColumn("__n", F.row_number().over(w)).where("__n = 1 AND p_partkey % 7 <> 0")
    return first.select(
        F.col("p_brand").alias("setup_id"), F.element_at(F.split("p_type", " "), 1).alias("section"), F.col("p_type").alias("parameter"),
        F.col("p_size").cast("double").alias("value_numeric"), F.col("p_size").cast("string").alias("value_text"), F.col("p_partkey").alias("ord"),
    )


def recorded(events: DataFrame) -> DataFrame:
    """The same sessions as cars of twelve recordings, with values that the format's short floats hold exactly.

    Cars with an index that leaves 2 by 3 have no extra frames. Slip ratios drop out at some frames.
    Events are dealt by file, as narrow rows and to so many partitions that hardly two files meet in one; windows and writer need no other exchange.
    """
    w = Window.partitionBy("file", "user_id").orderBy("ts", "event_id")
    sofar = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e, user = F.col("event_id"), F.col("user_id")
    file = F.concat(F.lit("AC_"), F.lpad((user % 12 + 1).cast("string"), 2, "0"), F.lit("0726-155603_R_car_track.rec"))
    df = events.withColumn("file", file).repartition(16 * events.sparkSession.sparkContext.defaultParallelism, "file")
    df = df.withColumn("source_frame", F.row_number().over(w).cast("long") - 1).withColumn("__laps", F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(sofar))
    since = Window.partitionBy("file", "user_id", "__laps").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__first", F.first("ts").over(since))
    df = df.withColumn("car_index", F.floor(user / 12).cast("int")).withColumn("__k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    return df.select(
        "file", "car_index", "source_frame", F.lit(60.0).alias("interval_ms"), F.lit("clear").alias("weather"), F.lit("ring").alias("track_id"), F.lit("short").alias("track_config"),
        F.concat(F.lit("car "), user.cast("string")).alias("car_id"), F.concat(F.lit("driver "), (user % 7).cast("string")).alias("driver_name"), F.lit("TST").alias("nation_code"),
        F.concat(F.lit("team "), (user % 3).cast("string")).alias("driver_team"), F.lit("plain").alias("car_skin_id"), (user % 3).cast("int").alias("wings"),
        F.when(F.col("car_index") % 3 < 2, F.col("car_index") % 3 + 6).otherwise(0).cast("int").alias("extra_version"),
        F.floor(F.col("__laps") / 2).cast("long").alias("source_lap_number"), F.expr("timestampdiff(MICROSECOND, __first, ts) div 1000 % 4294967296").alias("lap_time_ms"),
        (F.lit(1000) * (e * 11 % 5)).alias("last_lap_ms"), (F.lit(4294967295) - e % 5).alias("best_lap_ms"),
        F.sum((e % 8) / 4.0).over(sofar).alias("position_x"), ((e % 9) / 8.0).alias("position_y"), F.sum((e % 13) / 2.0 + F.when(e % 50 == 0, 12.0).otherwise(0.0)).over(sofar).alias("position_z"),
        ((e % 64) / 8.0 - 4.0).alias("velocity_x"), F.lit(0.0).alias("velocity_y"), ((e * 5 % 320) / 8.0).alias("velocity_z"),
        ((e % 5) / 4.0).alias("rotation_x"), ((e * 29 % 201 - 100) / 32.0).alias("rotation_y"), ((e % 3) / 4.0).alias("rotation_z"),
        F.least(F.lit(255), F.col("__k") * 3).alias("gas"), (F.greatest(F.lit(0), e * 37 % 100 - 50) * 5).alias("brake"), (e * 5 % 256).alias("clutch"), (e % 200).alias("handbrake"), (e % 4).alias("wipers"),
        (e * 7 % 65536).alias("raw_status"), (e * 3 % 65536).alias("status"), ((e % 21 - 10) / 8.0).alias("steer"), (e % 7).alias("gear_raw"), (F.lit(1000) + e * 17 % 1000).cast("double").alias("rpm"),
        (e % 100).cast("double").alias("drivetrain_speed"), ((e % 11) / 16.0).alias("bodywork_noise"), (F.lit(200) - F.col("source_frame") % 100).alias("fuel"), F.lit(3).alias("fuel_per_lap"), (e % 250).alias("boost"),
        *[F.when(~(e % ABSENT[x][0][0]).isin(*ABSENT[x][0][1:]), (e * SLIP[x] % 100 - 50) / 64.0).alias(f"wheel_{x}_slip_ratio") for x in WHEELS],
        *[(e * LOAD[x] % 2000).cast("double").alias(f"wheel_{x}_load") for x in WHEELS], *[((e * SLIP[x] % 16) / 16.0).alias(f"wheel_{x}_slip_angle") for x in WHEELS],
        *[(e * LOAD[x] % 128).cast("double").alias(f"wheel_{x}_angular_velocity") for x in WHEELS], *[((e * LOAD[x] % 9) / 8.0).alias(f"wheel_{x}_nd_slip") for x in WHEELS],
        *[((e * k + i) % 32 / 4.0).alias(f"wheel_{x}_position_{a}") for k, x in enumerate(WHEELS, 1) for i, a in enumerate("xyz")],
    )
