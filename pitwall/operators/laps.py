"""Laps and sessions: one aggregation over samples, neighbours by window over the few laps of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitwall.functions.expressions import yes

PIT_RATIO = 0.9


def time_in(flag: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(flag), F.col("dt_s"))), F.lit(0.0))


def share_of_moving(flag: str) -> Column:
    return F.lit(100.0) * F.count_if(F.col("is_moving") & F.col(flag)) / F.greatest(F.count_if("is_moving"), F.lit(1))


def summarise(derived: DataFrame) -> DataFrame:
    """Aggregates of each lap, and what its neighbours need: the first row's lap number and last lap time."""
    i = F.col("sample_index")
    fuel = lambda pick: F.when(F.max("fuel").isNotNull(), pick("fuel", i))
    front, rear = F.abs(F.least(F.col("front_slip_ratio_min"), F.lit(0.0))), F.greatest(F.col("rear_slip_ratio_max"), F.lit(0.0))
    front, rear = F.when(F.col("front_slip_ratio_min").isNotNull(), front), F.when(F.col("rear_slip_ratio_max").isNotNull(), rear)
    moving = F.when(F.col("is_moving"), F.col("speed_kmh"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return derived.groupBy("session_id", "lap_id", "lap_segment_index").agg(
        F.min_by("source_lap_number", i).alias("source_lap_number"), F.min_by("last_lap_ms", i).alias("first_last_lap_ms"),
        F.max("lap_time_s").alias("max_lap_time_s"), F.min(i).alias("start_sample"), F.max(i).alias("end_sample"), F.count("*").alias("sample_count"),
        fuel(F.min_by).alias("start_fuel"), fuel(F.max_by).alias("end_fuel"), F.max("actual_distance_m").alias("actual_distance_m"),
        F.max("speed_kmh").alias("max_speed_kmh"), F.avg(moving).alias("mean_speed_kmh"), F.min(moving).alias("min_speed_kmh"), F.max("rpm").alias("max_rpm"),
        time_in("is_full_throttle").alias("full_throttle_time_s"), share_of_moving("is_full_throttle").alias("full_throttle_pct"),
        time_in("is_partial_throttle").alias("partial_throttle_time_s"), share_of_moving("is_partial_throttle").alias("partial_throttle_pct"),
        time_in("is_braking").alias("braking_time_s"), share_of_moving("is_braking").alias("braking_pct"),
        time_in("is_coasting").alias("coasting_time_s"), share_of_moving("is_coasting").alias("coasting_pct"),
        time_in("is_brake_throttle_overlap").alias("overlap_time_s"), time_in("is_front_lock_candidate").alias("front_lock_time_s"),
        time_in("is_rear_wheelspin_candidate").alias("rear_wheelspin_time_s"),
        total(front * F.col("dt_s")).alias("front_slip_integral"), total(rear * F.col("dt_s")).alias("rear_slip_integral"),
        total(rear * F.coalesce(F.col("rear_total_load"), F.lit(0.0)) * F.col("dt_s")).alias("rear_tire_stress_proxy"),
    ).withColumn("fuel_used", F.col("start_fuel") - F.col("end_fuel"))


def complete(summary: DataFrame) -> DataFrame:
    """A lap is complete if the next segment carries the next lap number and an official time."""
    w = Window.partitionBy("session_id").orderBy("lap_segment_index")
    following = F.lead("source_lap_number").over(w)
    official = F.lead("first_last_lap_ms").over(w)
    done = yes((following == F.col("source_lap_number") + 1) & (official > 0))
    df = summary.withColumn("is_complete", done).withColumn("official_lap_time_s", F.when(F.col("is_complete"), official / F.lit(1000.0)))
    repeated = yes(F.lag("source_lap_number").over(w) == F.col("source_lap_number"))
    df = df.withColumn("is_replay_fragment", ~F.col("is_complete") & ((F.col("lap_segment_index") == 0) | repeated))
    return df.withColumn("lap_time_s", F.coalesce("official_lap_time_s", "max_lap_time_s")).withColumn("is_valid", F.col("is_complete") & ~F.col("is_replay_fragment"))


def classify(laps: DataFrame) -> DataFrame:
    typical = F.median("actual_distance_m").over(Window.partitionBy("session_id"))
    df = laps.withColumn("__typical", typical)
    kind = (
        F.when(F.col("is_replay_fragment"), "fragment").when(~F.col("is_complete"), "incomplete")
        .when(F.col("actual_distance_m") < F.lit(PIT_RATIO) * F.col("__typical"), "pit_or_error").otherwise("unclassified_complete")
    )
    # Reasons as stored in the table.
    reason = (
        F.when(F.col("lap_class") == "fragment", "replay_started_mid_lap_or_time_nonzero").when(F.col("lap_class") == "incomplete", "no_confirmed_next_lap_transition")
        .when(F.col("lap_class") == "pit_or_error", "path_length_short_relative_to_session").otherwise("complete_lap_without_semantic_pit_channel")
    )
    df = df.withColumn("lap_class", kind).drop("__typical")
    return df.withColumn("classification_confidence", F.when(F.col("lap_class").isin("fragment", "incomplete"), 0.95).otherwise(0.55)).withColumn("classification_reasons", reason)


LAP_COLUMNS = (
    "lap_id", "session_id", "lap_segment_index", "source_lap_number", "lap_time_s", "official_lap_time_s", "is_complete", "is_valid",
    "is_out_lap", "is_in_lap", "is_pit_lap", "is_replay_fragment", "start_sample", "end_sample", "sample_count", "start_fuel", "end_fuel", "fuel_used",
    "actual_distance_m", "max_speed_kmh", "mean_speed_kmh", "min_speed_kmh", "max_rpm", "full_throttle_time_s", "full_throttle_pct",
    "partial_throttle_time_s", "partial_throttle_pct", "braking_time_s", "braking_pct", "coasting_time_s", "coasting_pct", "overlap_time_s",
    "front_lock_time_s", "rear_wheelspin_time_s", "front_slip_integral", "rear_slip_integral", "rear_tire_stress_proxy",
    "lap_class", "classification_confidence", "classification_reasons",
)


def build(derived: DataFrame) -> DataFrame:
    """The 40 lap columns."""
    df = classify(complete(summarise(derived)))
    for name in ("is_out_lap", "is_in_lap", "is_pit_lap"):
        df = df.withColumn(name, F.lit(None).cast("boolean"))
    return df.select(*LAP_COLUMNS)


def with_event_counts(laps: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
    """Counts of braking, shift, lock-up and wheel-spin events; laps without any have 0."""
    named = {"events/braking": "braking_event_count", "events/shifts": "shift_count", "events/lockups": "lockup_event_count", "events/wheelspin": "wheelspin_event_count"}
    parts = [events[k].select("session_id", "lap_id", F.lit(c).alias("name")) for k, c in named.items() if k in events]
    if not parts:
        return laps.select("*", *[F.lit(0).cast("long").alias(c) for c in named.values()])
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    counts = every.groupBy("session_id", "lap_id").agg(*[F.count_if(F.col("name") == c).alias(c) for c in named.values()])
    joined = laps.join(counts, ["session_id", "lap_id"], "left")
    return joined.select(*laps.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in named.values()])


def sessions(derived: DataFrame, laps: DataFrame) -> DataFrame:
    """Roll-up of each session: frames, laps, complete laps, duration."""
    frames = derived.groupBy("session_id").agg(F.count("*").alias("frame_count"), F.max("timestamp_s").alias("session_duration_s"))
    counts = laps.groupBy("session_id").agg(F.count("*").alias("lap_count_total"), F.count_if("is_complete").alias("lap_count_complete"))
    return frames.join(counts, "session_id", "left").select("session_id", "frame_count", F.coalesce("lap_count_total", F.lit(0)).alias("lap_count_total"), F.coalesce("lap_count_complete", F.lit(0)).alias("lap_count_complete"), "session_duration_s")


def session_label(stem: Column, driver: Column, car_id: Column, cars: Column) -> Column:
    """The recording's name; with several cars, the driver's or else the car's name behind it."""
    return F.when(cars > 1, F.concat(stem, F.lit(" ("), F.coalesce(F.nullif(driver, F.lit("")), car_id), F.lit(")"))).otherwise(stem)


def best(laps: DataFrame, sessions: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The fastest complete laps of all sessions, ties in order of the sessions (``place``, ``car_index`` of ``sessions``, if it has them) and segments."""
    order = [c for c in ("place", "car_index") if sessions is not None and c in sessions.columns]
    placed = laps.where("is_complete")
    if order:
        placed = placed.join(sessions.select("session_id", *order), "session_id")
    return placed.orderBy(F.col("lap_time_s"), *order, "session_id", "lap_segment_index").limit(k).select(*laps.columns)
