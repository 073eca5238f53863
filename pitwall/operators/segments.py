"""Passes through track segments: a range join of samples with the definitions, aggregated by lap and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COORDINATES = {"actual_distance_m": "actual_distance_m", "normalized_progress": "progress"}
PICKUP, FULL = 0.05, 0.98
#: Definitions up to this number are compared with every sample; more are met by an equi-join on cells of the coordinate.
COMPARED = 12
#: Cells of the coordinate at most, and rows of definitions by cell that are broadcast at most.
CELLS, BROADCAST_ROWS = 1_000, 100_000
DEFINITION = "segment_id string, segment_name string, parent_segment_id string, coordinate string, segment_start double, segment_end double"


def expand(definitions: dict) -> list[tuple]:
    """Rows of DEFINITION: each segment, then its subsegments, which name their parent. The name defaults to the id."""
    coordinate = definitions.get("coordinate", "actual_distance_m")
    if coordinate not in COORDINATES:
        raise ValueError(f"unsupported segment coordinate: {coordinate}")
    rows = []
    for segment in definitions.get("segments", []):
        for part, parent in [(segment, segment.get("parent_id")), *((s, segment.get("id")) for s in segment.get("subsegments", []))]:
            rows.append((part.get("id"), part.get("name", part.get("id")), parent, coordinate, float(part["start"]), float(part["end"])))
    return rows


def expand_table(tree: DataFrame) -> DataFrame:
    """The same for a table of (coordinate, segments array of id, name, start, end, subsegments), as read from JSON."""
    top = tree.select(F.coalesce("coordinate", F.lit("actual_distance_m")).alias("coordinate"), F.explode("segments").alias("s"))
    named = lambda c, parent: [F.col(f"{c}.id").alias("segment_id"), F.coalesce(f"{c}.name", f"{c}.id").alias("segment_name"), parent.alias("parent_segment_id"), "coordinate", F.col(f"{c}.start").cast("double").alias("segment_start"), F.col(f"{c}.end").cast("double").alias("segment_end")]
    children = top.select("coordinate", F.col("s.id").alias("parent"), F.explode("s.subsegments").alias("c"))
    return top.select(*named("s", F.lit(None).cast("string"))).unionByName(children.select(*named("c", F.col("parent"))))


def _inside(at, start, end):
    """Closed on both ends; a segment that starts behind its end runs across the start line."""
    return F.when(start <= end, (at >= start) & (at <= end)).otherwise((at >= start) | (at <= end))


def members(samples: DataFrame, definitions: DataFrame, coordinate: str, count: int) -> DataFrame:
    """Samples with each segment that holds them. A sample without position is in none."""
    at = F.col(COORDINATES[coordinate])
    placed = samples.withColumn("__at", at).where("__at IS NOT NULL AND NOT isnan(__at)")
    start, end = F.col("segment_start"), F.col("segment_end")
    if count <= COMPARED:
        return placed.join(F.broadcast(definitions), _inside(F.col("__at"), start, end))  # COMPARED rows at most
    # Cells of equal width over the range of bounds; beyond it a sample lies in the outermost cell.
    lo, hi = definitions.agg(F.min(F.least(start, end)), F.max(F.greatest(start, end))).first()
    number = max(16, min(CELLS, BROADCAST_ROWS // count))
    width = max((hi - lo) / number, 1e-9)
    cell = lambda x: F.least(F.greatest(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(-1)), F.lit(number)).cast("int")
    cells = F.when(start <= end, F.sequence(cell(start), cell(end))).otherwise(F.array_union(F.sequence(cell(start), F.lit(number)), F.sequence(F.lit(-1), cell(end))))
    spread = definitions.withColumn("__cell", F.explode(cells))
    spread = F.broadcast(spread) if count * (number + 2) <= 2 * BROADCAST_ROWS else spread
    return placed.withColumn("__cell", cell(F.col("__at"))).join(spread, "__cell").where(_inside(F.col("__at"), start, end)).drop("__cell")


PASS_COLUMNS = (
    "session_id", "lap_id", "source_lap_number", "segment_id", "segment_name", "parent_segment_id", "coordinate", "segment_start", "segment_end",
    "sample_count", "segment_time_s", "entry_speed_kmh", "exit_speed_kmh", "minimum_speed_kmh", "minimum_speed_position", "brake_start_position",
    "brake_end_position", "brake_duration_s", "peak_brake", "brake_impulse_proxy_s", "throttle_pickup_position", "full_throttle_position",
    "coasting_time_s", "partial_throttle_time_s", "front_lock_time_s", "rear_wheelspin_time_s", "rear_slip_integral", "max_abs_steer",
    "steering_sign_changes", "actual_path_length_m", "is_complete_lap", "is_valid_lap", "quality_score", "valid_for_comparison",
)


def passes(samples: DataFrame, laps: DataFrame, definitions: list[tuple]) -> DataFrame:
    """One row for each lap and segment with at least two samples; ``definitions`` are rows of DEFINITION with one coordinate."""
    spark = samples.sparkSession
    table = spark.createDataFrame([(n, *d) for n, d in enumerate(definitions)], f"__n int, {DEFINITION}")
    coordinate = definitions[0][3] if definitions else "actual_distance_m"
    inside = members(samples, table, coordinate, len(definitions))
    i, at, dt = F.col("sample_index"), F.col("__at"), F.col("dt_s")
    w = Window.partitionBy("session_id", "lap_id", "__n").orderBy("sample_index")
    dx, dz = (F.coalesce(F.col(f"position_{a}") - F.lag(f"position_{a}").over(w), F.lit(0.0)) for a in "xz")
    sign = F.signum(F.coalesce("steer", F.lit(0.0)))
    inside = inside.withColumn("__dx", dx).withColumn("__dz", dz).withColumn("__turn", F.coalesce(sign != F.lag(sign).over(w), F.lit(False)))
    first = lambda c, flag=None: F.min_by(c, i if flag is None else F.when(flag, i))
    last = lambda c, flag=None: F.max_by(c, i if flag is None else F.when(flag, i))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    spent = lambda flag: total(F.when(F.col(flag), dt))
    slip = F.when(F.col("rear_slip_ratio_max").isNotNull(), F.greatest(F.col("rear_slip_ratio_max"), F.lit(0.0)))
    definition = ["segment_id", "segment_name", "parent_segment_id", "coordinate", "segment_start", "segment_end"]
    grouped = inside.groupBy("session_id", "lap_id", "__n", *definition).agg(
        first("source_lap_number").alias("source_lap_number"), F.count("*").alias("sample_count"), (last("lap_time_s") - first("lap_time_s")).alias("segment_time_s"),
        first("speed_kmh").alias("entry_speed_kmh"), last("speed_kmh").alias("exit_speed_kmh"), F.min("speed_kmh").alias("minimum_speed_kmh"),
        F.min_by(at, F.when(F.col("speed_kmh").isNotNull(), F.struct("speed_kmh", "sample_index"))).alias("minimum_speed_position"),
        first(at, F.col("is_braking")).alias("brake_start_position"), last(at, F.col("is_braking")).alias("brake_end_position"), spent("is_braking").alias("brake_duration_s"),
        F.max("brake_n").alias("peak_brake"), total(F.col("brake_n") * dt).alias("brake_impulse_proxy_s"),
        first(at, F.col("throttle") >= PICKUP).alias("throttle_pickup_position"), first(at, F.col("is_full_throttle")).alias("full_throttle_position"),
        spent("is_coasting").alias("coasting_time_s"), spent("is_partial_throttle").alias("partial_throttle_time_s"), spent("is_front_lock_candidate").alias("front_lock_time_s"),
        spent("is_rear_wheelspin_candidate").alias("rear_wheelspin_time_s"), total(slip * dt).alias("rear_slip_integral"), F.max(F.abs("steer")).alias("max_abs_steer"),
        F.count_if("__turn").alias("steering_sign_changes"), F.sum(F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dz") * F.col("__dz"))).alias("actual_path_length_m"),
    ).where("sample_count >= 2")
    known = laps.select("session_id", "lap_id", F.col("is_complete").alias("is_complete_lap"), F.col("is_valid").alias("is_valid_lap"))
    joined = grouped.join(known, ["session_id", "lap_id"])
    return joined.withColumn("quality_score", F.when(F.col("is_valid_lap"), 1.0).otherwise(0.5)).withColumn("valid_for_comparison", F.col("is_valid_lap")).select(*PASS_COLUMNS)
