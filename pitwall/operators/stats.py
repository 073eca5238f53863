"""Robust statistics of segment passes by setup, and dataset counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = (
    ("segment_time_s", "time_s"), ("entry_speed_kmh", "entry_speed_kmh"), ("minimum_speed_kmh", "minimum_speed_kmh"), ("exit_speed_kmh", "exit_speed_kmh"),
    ("brake_start_position", "brake_start"), ("full_throttle_position", "full_throttle"), ("coasting_time_s", "coasting_time_s"),
)
FASTEST = 3
KEYS = ("setup_id", "segment_id")


def compared(passes: DataFrame, sessions: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Passes with their session's setup, the group's counts, and only the valid ones where a group has any."""
    setups = sessions.select("session_id", "setup_id")
    joined = passes.join(setups, "session_id", "left")
    w = Window.partitionBy(*keys)
    counted = joined.withColumn("total_pass_count", F.count("*").over(w)).withColumn("valid_pass_count", F.count_if("valid_for_comparison").over(w))
    return counted.where(F.col("valid_for_comparison") | (F.col("valid_pass_count") == 0))


def robust(values: str, centre: str, prefix: str) -> list[Column]:
    """Nine statistics of a column; ``centre`` holds the group's median. Without values all are missing."""
    x = F.col(values)
    n = F.count(x)
    return [
        F.nullif(n, F.lit(0)).alias(f"{prefix}_count"), F.avg(x).alias(f"{prefix}_mean"), F.median(x).alias(f"{prefix}_median"),
        F.when(n == 1, 0.0).otherwise(F.stddev_samp(x)).alias(f"{prefix}_std"), F.median(F.abs(x - F.col(centre))).alias(f"{prefix}_mad"),
        F.min(x).alias(f"{prefix}_min"), F.percentile(x, 0.25).alias(f"{prefix}_p25"), F.percentile(x, 0.75).alias(f"{prefix}_p75"), F.max(x).alias(f"{prefix}_max"),
    ]


def segment_statistics(passes: DataFrame, sessions: DataFrame) -> DataFrame:
    """69 columns for each setup (or none) and segment. One exchange: medians, ranks and sums share their partitioning."""
    target = compared(passes, sessions)
    w = Window.partitionBy(*KEYS)
    for column, prefix in METRICS:
        target = target.withColumn(f"__median_{prefix}", F.median(column).over(w))
    rank = F.row_number().over(w.orderBy(F.col("segment_time_s").asc_nulls_last(), "session_id", "lap_id"))
    target = target.withColumn("__rank", rank)
    stats = [c for column, prefix in METRICS for c in robust(column, f"__median_{prefix}", prefix)]
    return target.groupBy(*KEYS).agg(
        F.min_by("segment_name", F.struct("session_id", "lap_id")).alias("segment_name"), F.first("valid_pass_count").alias("valid_pass_count"), F.first("total_pass_count").alias("total_pass_count"),
        *stats, F.avg(F.when(F.col("__rank") <= FASTEST, F.col("segment_time_s"))).alias("best_3_mean_time_s"),
    )


def dataset_counts(sessions: DataFrame, laps: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: sessions, complete and valid laps, setups, and quality flags by severity."""
    a = sessions.agg(F.count("*").alias("sessions"), F.count_distinct("setup_id").alias("setups"))
    b = laps.agg(F.count_if("is_complete").alias("complete_laps"), F.count_if("is_valid").alias("valid_laps"))
    c = quality.agg(F.count("*").alias("flag_count"), F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  each side is a single row
    return one(a).join(one(b), "__one").join(one(c), "__one").drop("__one")
