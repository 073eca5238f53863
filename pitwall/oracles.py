"""The catalogue's queries as SQL over the same tables, written independently of the DataFrame operators."""

from __future__ import annotations

WS = "PARTITION BY session_id ORDER BY sample_index"
WL = "PARTITION BY session_id, lap_id ORDER BY sample_index"
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
PI = "3.141592653589793"


def _mean(a: str, b: str) -> str:
    """Of what is there."""
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE ({a} + {b}) / 2 END"


def _sum(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {a} + {b} END"


def _id(*parts: str) -> str:
    return "substr(sha256(" + " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts) + "), 1, 16)"


RAW = f"""
e AS (
  SELECT user_id, event_id, ts, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS signups
  FROM events),
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, sample_index, sample_index + sample_index // 10 AS source_frame, CAST(60 AS DOUBLE) AS interval_ms,
    CAST(signups // 2 AS BIGINT) AS source_lap_number,
    (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id, signups ORDER BY ts, event_id))) // 1000 AS lap_time_ms,
    1000 * (event_id * 11 % 5) AS last_lap_ms,
    sum(value / 20 * CAST(0.6 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS position_x,
    sum(value / 20 * CAST(0.8 AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id {RUN}) AS position_z,
    CASE WHEN event_id % 59 <> 0 THEN value / CAST(3.6 AS DOUBLE) * CAST(0.6 AS DOUBLE) END AS velocity_x, value / CAST(3.6 AS DOUBLE) * CAST(0.8 AS DOUBLE) AS velocity_z,
    CASE WHEN event_id % 29 <> 0 THEN CAST(event_id * 29 % 628 - 314 AS DOUBLE) / 100 END AS yaw, CASE WHEN event_id % 47 <> 0 THEN k * 255 / 100 END AS gas,
    CASE WHEN event_id % 53 <> 0 THEN CAST(greatest(0, event_id * 37 % 100 - 50) AS DOUBLE) * 255 / 50 END AS brake, CAST(event_id * 5 % 256 AS DOUBLE) AS clutch,
    CAST(event_id % 21 - 10 AS DOUBLE) / 10 AS steer, event_id % 7 AS gear_raw, CAST(1000 + event_id * 17 % 7000 AS DOUBLE) AS rpm,
    CAST(100 AS DOUBLE) - sample_index * CAST(0.1 AS DOUBLE) AS fuel,
    CASE WHEN event_id % 31 <> 0 THEN CAST(event_id * 13 % 100 - 50 AS DOUBLE) / 100 END AS slip_fl, CASE WHEN event_id % 31 > 1 THEN CAST(event_id * 17 % 100 - 50 AS DOUBLE) / 100 END AS slip_fr,
    CASE WHEN event_id % 37 <> 0 THEN CAST(event_id * 23 % 100 - 50 AS DOUBLE) / 100 END AS slip_rl, CASE WHEN event_id % 37 > 1 THEN CAST(event_id * 19 % 100 - 50 AS DOUBLE) / 100 END AS slip_rr,
    CASE WHEN event_id % 41 <> 0 THEN CAST(event_id * 7 % 4000 AS DOUBLE) END AS load_fl, CASE WHEN event_id % 41 NOT IN (0, 2) THEN CAST(event_id * 11 % 4000 AS DOUBLE) END AS load_fr,
    CASE WHEN event_id % 43 <> 0 THEN CAST(event_id * 13 % 4000 AS DOUBLE) END AS load_rl, CASE WHEN event_id % 43 NOT IN (0, 3) THEN CAST(event_id * 17 % 4000 AS DOUBLE) END AS load_rr
  FROM e)"""

SEGMENTED = f"""
marked AS (
  SELECT *, lap_time_ms / CAST(1000 AS DOUBLE) AS lap_time_s,
    CASE WHEN lag(sample_index) OVER ({WS}) IS NULL OR source_lap_number <> lag(source_lap_number) OVER ({WS})
      OR lap_time_ms - lag(lap_time_ms) OVER ({WS}) < -5 THEN 1 ELSE 0 END AS starts
  FROM raw),
numbered AS (SELECT *, CAST(sum(starts) OVER ({WS} {RUN}) - 1 AS BIGINT) AS lap_segment_index FROM marked),
seg AS (SELECT *, {_id("session_id", "lap_segment_index")} AS lap_id FROM numbered)"""

TIMED = f"""
clocked AS (SELECT *, source_frame * interval_ms / 1000 AS at_s FROM {{source}}),
timed AS (
  SELECT *, at_s - first_value(at_s) OVER ({WS}) AS timestamp_s,
    CASE WHEN at_s - lag(at_s) OVER ({WS}) > 0 THEN at_s - lag(at_s) OVER ({WS}) ELSE interval_ms / 1000 END AS dt_s
  FROM clocked)"""

DERIVED = f"""
pedals AS (
  SELECT *, least(greatest(gas / 255, 0), 1) AS throttle, least(greatest(brake / 255, 0), 1) AS brake_n,
    coalesce(velocity_x, 0) AS vx, coalesce(velocity_z, 0) AS vz, sqrt(vx * vx + vz * vz) AS speed_ms,
    coalesce(last_value(yaw IGNORE NULLS) OVER ({WS} {RUN}), 0) AS yaw_f
  FROM timed),
moved AS (
  SELECT *, speed_ms * CAST(3.6 AS DOUBLE) AS speed_kmh,
    coalesce((vx - lag(vx) OVER ({WS})) / greatest(dt_s, 1e-6), 0) AS ax,
    coalesce((vz - lag(vz) OVER ({WS})) / greatest(dt_s, 1e-6), 0) AS az,
    CASE WHEN speed_ms > 1 THEN vx / speed_ms ELSE 0 END AS ux, CASE WHEN speed_ms > 1 THEN vz / speed_ms ELSE 0 END AS uz,
    coalesce(yaw_f - lag(yaw_f) OVER ({WS}), 0) AS turn,
    sqrt(pow(coalesce(position_x - lag(position_x) OVER ({WL}), 0), 2) + pow(coalesce(position_z - lag(position_z) OVER ({WL}), 0), 2)) AS step_m
  FROM pedals),
turned AS (
  SELECT *, ax * ux + az * uz AS long_accel_ms2, ux * az - uz * ax AS lat_accel_ms2,
    yaw_f - 2 * {PI} * sum(CASE WHEN turn > {PI} THEN 1 WHEN turn < -{PI} THEN -1 ELSE 0 END) OVER ({WS} {RUN}) AS yaw_rad,
    sum(CASE WHEN step_m > 10 THEN 0 ELSE step_m END) OVER ({WL} {RUN}) AS actual_distance_m,
    CASE WHEN gear_raw >= 2 THEN gear_raw - 1 ELSE 0 END AS gear_physical,
    {_mean('slip_fl', 'slip_fr')} AS front_mean, {_mean('slip_rl', 'slip_rr')} AS rear_mean, least(slip_fl, slip_fr) AS front_min, greatest(slip_rl, slip_rr) AS rear_max,
    {_sum('load_rl', 'load_rr')} AS rear_load
  FROM moved),
ranged AS (SELECT *, last_value(actual_distance_m) OVER ({WL} {ALL}) AS lap_distance FROM turned),
d AS (
  SELECT *, long_accel_ms2 / CAST(9.80665 AS DOUBLE) AS long_g, lat_accel_ms2 / CAST(9.80665 AS DOUBLE) AS lat_g,
    coalesce((yaw_rad - lag(yaw_rad) OVER ({WS})) / greatest(dt_s, 1e-6), 0) AS yaw_rate_rad_s,
    CASE WHEN lap_distance > 0 THEN actual_distance_m / lap_distance END AS progress,
    speed_kmh >= 50 AS is_moving, throttle >= CAST(0.98 AS DOUBLE) AND brake_n < CAST(0.05 AS DOUBLE) AS is_full_throttle,
    throttle >= CAST(0.05 AS DOUBLE) AND throttle < CAST(0.98 AS DOUBLE) AND brake_n < CAST(0.05 AS DOUBLE) AS is_partial_throttle,
    brake_n >= CAST(0.1 AS DOUBLE) AS is_braking, throttle < CAST(0.05 AS DOUBLE) AND brake_n < CAST(0.05 AS DOUBLE) AS is_coasting,
    throttle >= CAST(0.05 AS DOUBLE) AND brake_n >= CAST(0.1 AS DOUBLE) AS is_brake_throttle_overlap,
    coalesce(brake_n >= CAST(0.1 AS DOUBLE) AND speed_kmh >= 80 AND front_min <= CAST(-0.25 AS DOUBLE), false) AS is_front_lock_candidate,
    coalesce(throttle >= CAST(0.5 AS DOUBLE) AND speed_kmh >= 30 AND rear_max >= CAST(0.08 AS DOUBLE), false) AS is_rear_wheelspin_candidate,
    lap_time_s IS NOT NULL AND speed_kmh IS NOT NULL AS is_valid_sample
  FROM ranged)"""

CHAIN = "WITH " + RAW + "," + SEGMENTED + "," + TIMED.replace("{source}", "seg") + "," + DERIVED


def _spent(flag: str) -> str:
    return f"coalesce(sum(CASE WHEN {flag} THEN dt_s END), 0)"


def _share(flag: str) -> str:
    return f"100.0 * count(*) FILTER (WHERE is_moving AND {flag}) / greatest(count(*) FILTER (WHERE is_moving), 1)"


LAPS = f"""
sums AS (
  SELECT session_id, lap_id, lap_segment_index, arg_min(source_lap_number, sample_index) AS source_lap_number, arg_min(last_lap_ms, sample_index) AS first_last,
    max(lap_time_s) AS max_time, min(sample_index) AS start_sample, max(sample_index) AS end_sample, count(*) AS sample_count,
    arg_min(fuel, sample_index) AS start_fuel, arg_max(fuel, sample_index) AS end_fuel, max(actual_distance_m) AS actual_distance_m,
    max(speed_kmh) AS max_speed_kmh, avg(CASE WHEN is_moving THEN speed_kmh END) AS mean_speed_kmh, min(CASE WHEN is_moving THEN speed_kmh END) AS min_speed_kmh, max(rpm) AS max_rpm,
    {_spent("is_full_throttle")} AS full_throttle_time_s, {_spent("is_partial_throttle")} AS partial_throttle_time_s, {_spent("is_braking")} AS braking_time_s,
    {_spent("is_coasting")} AS coasting_time_s, {_spent("is_brake_throttle_overlap")} AS overlap_time_s, {_spent("is_front_lock_candidate")} AS front_lock_time_s,
    {_spent("is_rear_wheelspin_candidate")} AS rear_wheelspin_time_s, {_share("is_full_throttle")} AS full_throttle_pct, {_share("is_partial_throttle")} AS partial_throttle_pct,
    {_share("is_braking")} AS braking_pct, {_share("is_coasting")} AS coasting_pct, sum(abs(least(front_min, 0)) * dt_s) AS front_slip_integral,
    sum(greatest(rear_max, 0) * dt_s) AS rear_slip_integral, coalesce(sum(greatest(rear_max, 0) * rear_load * dt_s), 0) AS rear_tire_stress_proxy
  FROM d GROUP BY session_id, lap_id, lap_segment_index),
neighbours AS (
  SELECT *, lead(source_lap_number) OVER w AS next_lap, lead(first_last) OVER w AS official, lag(source_lap_number) OVER w AS previous_lap,
    median(actual_distance_m) OVER (PARTITION BY session_id) AS typical
  FROM sums WINDOW w AS (PARTITION BY session_id ORDER BY lap_segment_index)),
decided AS (SELECT *, coalesce(next_lap = source_lap_number + 1 AND official > 0, false) AS is_complete FROM neighbours),
l AS (
  SELECT *, NOT is_complete AND (lap_segment_index = 0 OR coalesce(previous_lap = source_lap_number, false)) AS is_replay_fragment, is_complete AS is_valid,
    CASE WHEN is_complete THEN official / CAST(1000 AS DOUBLE) END AS official_lap_time_s, CASE WHEN is_complete THEN official / CAST(1000 AS DOUBLE) ELSE max_time END AS lap_time_s
  FROM decided)"""


def _r(*columns: str) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, 6) + 0 AS {c.split(' AS ')[-1]}" for c in columns)


def _samples(exact: str, *rounded: str) -> str:
    return f"{CHAIN} SELECT session_id, sample_index{', ' + exact if exact else ''}{', ' + _r(*rounded) if rounded else ''} FROM d"


def _laps(exact: str, *rounded: str) -> str:
    return f"{CHAIN},{LAPS} SELECT session_id, lap_id, lap_segment_index{', ' + exact if exact else ''}{', ' + _r(*rounded) if rounded else ''} FROM l"


def _runs(name: str, flag: str, gap: float | None) -> str:
    """CTEs that give {name}: the samples of the runs of a flag with a run_id, short gaps closed."""
    closed = flag
    first = f"{name}_f AS (SELECT *, {flag} AS raw_on FROM d),"
    if gap is not None:
        closed = f"raw_on OR coalesce(following - preceding - 1 <= most, false)"
        first += f"""
{name}_m AS (SELECT session_id AS ms, lap_id AS ml, greatest(1, round_even({gap} / greatest(median(dt_s), 1e-6), 0)) AS most FROM d GROUP BY session_id, lap_id),
{name}_g AS (
  SELECT {name}_f.*, most, max(CASE WHEN raw_on THEN sample_index END) OVER ({WL} {RUN}) AS preceding,
    min(CASE WHEN raw_on THEN sample_index END) OVER ({WL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following
  FROM {name}_f JOIN {name}_m ON session_id = ms AND lap_id = ml),"""
    else:
        first += f"{name}_g AS (SELECT * FROM {name}_f),"
    return f"""{first}
{name}_c AS (SELECT *, {closed} AS closed FROM {name}_g),
{name}_s AS (SELECT *, CASE WHEN closed AND NOT coalesce(lag(closed) OVER ({WL}), false) THEN 1 ELSE 0 END AS run_start FROM {name}_c),
{name} AS (SELECT * FROM (SELECT *, sum(run_start) OVER ({WL} {RUN}) AS run_id FROM {name}_s) WHERE closed)"""


EVENT_BASE = """min(sample_index) AS start_sample, max(sample_index) AS end_sample, arg_min(lap_time_s, sample_index) AS start_time_s, arg_max(lap_time_s, sample_index) AS end_time_s,
    sum(dt_s) AS duration_s, arg_min(actual_distance_m, sample_index) AS start_distance_m, arg_max(actual_distance_m, sample_index) AS end_distance_m,
    first(progress ORDER BY sample_index) AS start_progress, last(progress ORDER BY sample_index) AS end_progress"""


def _event(kind: str, source: str, exact: str, *rounded: str) -> str:
    base = _r("start_time_s", "end_time_s", "duration_s", "start_distance_m", "end_distance_m", "start_progress", "end_progress", *rounded)
    return f"SELECT {_id('lap_id', repr(kind), 'start_sample')} AS event_id, session_id, lap_id, '{kind}' AS event_type, start_sample, end_sample{', ' + exact if exact else ''}, {base} FROM {source}"


BRAKING = f"""{_runs("b", "is_braking", 0.15)},
b_p AS (SELECT *, max(brake_n) OVER (PARTITION BY session_id, lap_id, run_id) AS peak FROM b),
b_i AS (SELECT *, min(CASE WHEN brake_n = peak THEN sample_index END) OVER (PARTITION BY session_id, lap_id, run_id) AS peak_at,
  brake_n - lag(brake_n) OVER (PARTITION BY session_id, lap_id, run_id ORDER BY sample_index) AS change FROM b_p),
b_e AS (
  SELECT session_id, lap_id, run_id, {EVENT_BASE}, arg_min(speed_kmh, sample_index) AS entry_speed_kmh, arg_max(speed_kmh, sample_index) AS release_speed_kmh,
    min(speed_kmh) AS minimum_speed_kmh, max(brake_n) AS peak_brake, avg(brake_n) AS mean_brake, sum(brake_n * dt_s) AS brake_impulse_proxy_s,
    arg_min(lap_time_s, sample_index) FILTER (WHERE brake_n >= CAST(0.9 AS DOUBLE) * peak) - arg_min(lap_time_s, sample_index) AS time_to_90pct_peak_s,
    arg_min(steer, sample_index) AS steer_at_start, arg_max(steer, sample_index) AS steer_at_release, {_spent("is_front_lock_candidate")} AS front_lock_time_s,
    {_spent("is_rear_wheelspin_candidate")} AS rear_wheelspin_time_s, sum(dt_s) FILTER (WHERE sample_index >= peak_at) AS release_duration_s,
    (arg_max(brake_n, sample_index) - max(peak)) / sum(dt_s) FILTER (WHERE sample_index >= peak_at) AS release_slope_per_s,
    coalesce(avg(CASE WHEN change <= CAST(0.01 AS DOUBLE) THEN 1.0 ELSE 0.0 END) FILTER (WHERE sample_index > peak_at), 1) AS release_monotonicity
  FROM b_i GROUP BY session_id, lap_id, run_id),
braking AS (SELECT * FROM b_e WHERE duration_s >= CAST(0.2 AS DOUBLE) AND entry_speed_kmh >= 50)"""

THROTTLE = f"""{_runs("t", "throttle >= CAST(0.05 AS DOUBLE)", None)},
t_d AS (SELECT *, throttle - lag(throttle) OVER (PARTITION BY session_id, lap_id, run_id ORDER BY sample_index) AS change FROM t),
t_e AS (
  SELECT session_id, lap_id, run_id, {EVENT_BASE}, arg_min(speed_kmh, sample_index) AS start_speed_kmh, arg_min(throttle, sample_index) AS initial_throttle, max(throttle) AS peak_throttle,
    arg_min(lap_time_s, sample_index) FILTER (WHERE throttle >= CAST(0.5 AS DOUBLE)) - arg_min(lap_time_s, sample_index) AS time_to_50pct_s,
    arg_min(lap_time_s, sample_index) FILTER (WHERE throttle >= CAST(0.98 AS DOUBLE)) - arg_min(lap_time_s, sample_index) AS time_to_full_throttle_s,
    arg_min(steer, sample_index) AS steer_at_pickup, arg_min(steer, sample_index) FILTER (WHERE throttle >= CAST(0.98 AS DOUBLE)) AS steer_at_full_throttle,
    arg_min(yaw_rate_rad_s, sample_index) AS yaw_rate_at_pickup_rad_s, first(rear_max ORDER BY sample_index) AS rear_slip_at_pickup, max(rear_max) AS rear_slip_peak,
    count(DISTINCT sign(steer)) > 1 AS countersteer_proxy, coalesce(bool_or(change < CAST(-0.2 AS DOUBLE)), false) AS throttle_lift_within_event,
    sum(throttle * greatest(rear_max, 0) * dt_s) AS tc_activity_proxy
  FROM t_d GROUP BY session_id, lap_id, run_id),
throttle_e AS (
  SELECT *, peak_throttle / greatest(CASE WHEN time_to_full_throttle_s > 0 THEN time_to_full_throttle_s ELSE duration_s END, 1e-6) AS ramp_rate_per_s
  FROM t_e WHERE duration_s >= CAST(0.1 AS DOUBLE))"""

SHIFTS = """
geared AS (
  SELECT *, lag(gear_physical) OVER w AS from_gear, lag(speed_kmh) OVER w AS speed_before_kmh, lag(rpm) OVER w AS rpm_before, lag(long_g) OVER w AS long_g_before, lag(sample_index) OVER w AS before_at
  FROM d WHERE gear_physical > 0 WINDOW w AS (PARTITION BY session_id, lap_id ORDER BY sample_index)),
shifts AS (
  SELECT session_id, lap_id, sample_index AS start_sample, sample_index AS end_sample, lap_time_s AS start_time_s, lap_time_s AS end_time_s, dt_s AS duration_s,
    actual_distance_m AS start_distance_m, actual_distance_m AS end_distance_m, progress AS start_progress, progress AS end_progress, from_gear, gear_physical AS to_gear,
    CASE WHEN gear_physical > from_gear THEN 'up' ELSE 'down' END AS direction, speed_before_kmh, speed_kmh AS speed_after_kmh, rpm_before, rpm AS rpm_after,
    rpm_before - rpm AS rpm_drop, long_g_before, long_g AS long_g_after, sample_index - before_at - 1 AS neutral_samples_between
  FROM geared WHERE from_gear <> gear_physical)"""


def _wheel(name: str, flag: str, a: str, b: str, lowest: bool) -> str:
    f, op = ("min", "<=") if lowest else ("max", ">=")
    return f"""{_runs(name + "r", flag, 0.045)},
{name} AS (
  SELECT session_id, lap_id, run_id, {EVENT_BASE}, CASE WHEN {f}(slip_{b}) IS NULL OR {f}(slip_{a}) {op} {f}(slip_{b}) THEN '{a}' ELSE '{b}' END AS primary_wheel,
    {"least" if lowest else "greatest"}({f}(slip_{a}), {f}(slip_{b})) AS extreme_slip_ratio, arg_min(speed_kmh, sample_index) AS entry_speed_kmh,
    avg(brake_n) AS mean_brake, avg(throttle) AS mean_throttle, avg(abs(steer)) AS mean_abs_steer
  FROM {name}r GROUP BY session_id, lap_id, run_id HAVING sum(dt_s) >= CAST(0.03 AS DOUBLE))"""


LOCKUPS, WHEELSPIN = _wheel("lockups", "is_front_lock_candidate", "fl", "fr", True), _wheel("spins", "is_rear_wheelspin_candidate", "rl", "rr", False)
WHEEL_COLUMNS = ("extreme_slip_ratio", "entry_speed_kmh", "mean_brake", "mean_throttle", "mean_abs_steer")

DEFINITIONS = """
definitions(n, segment_id, segment_name, parent_segment_id, segment_start, segment_end) AS (VALUES
  (0, 's1', 'Start', CAST(NULL AS VARCHAR), CAST(0 AS DOUBLE), CAST(5 AS DOUBLE)), (1, 's2', 'Middle', NULL, 5, 20), (2, 's2a', 'Entry', 's2', 5, 12),
  (3, 's2b', 's2b', 's2', 12, 20), (4, 's3', 'End', NULL, 20, 90), (5, 's4', 'Line', NULL, 15, 3))"""

PASSES = f"""{DEFINITIONS},
held AS (
  SELECT d.*, definitions.* FROM d JOIN definitions ON CASE WHEN segment_start <= segment_end
    THEN actual_distance_m >= segment_start AND actual_distance_m <= segment_end ELSE actual_distance_m >= segment_start OR actual_distance_m <= segment_end END),
walked AS (
  SELECT *, sqrt(pow(coalesce(position_x - lag(position_x) OVER w, 0), 2) + pow(coalesce(position_z - lag(position_z) OVER w, 0), 2)) AS walked_m,
    coalesce(sign(steer) <> lag(sign(steer)) OVER w, false) AS turned_over
  FROM held WINDOW w AS (PARTITION BY session_id, lap_id, n ORDER BY sample_index)),
grouped AS (
  SELECT session_id, lap_id, n, segment_id, segment_name, parent_segment_id, segment_start, segment_end, arg_min(source_lap_number, sample_index) AS source_lap_number, count(*) AS sample_count,
    arg_max(lap_time_s, sample_index) - arg_min(lap_time_s, sample_index) AS segment_time_s, arg_min(speed_kmh, sample_index) AS entry_speed_kmh, arg_max(speed_kmh, sample_index) AS exit_speed_kmh,
    min(speed_kmh) AS minimum_speed_kmh, first(actual_distance_m ORDER BY speed_kmh, sample_index) AS minimum_speed_position,
    arg_min(actual_distance_m, sample_index) FILTER (WHERE is_braking) AS brake_start_position, arg_max(actual_distance_m, sample_index) FILTER (WHERE is_braking) AS brake_end_position,
    {_spent("is_braking")} AS brake_duration_s, max(brake_n) AS peak_brake, sum(brake_n * dt_s) AS brake_impulse_proxy_s,
    arg_min(actual_distance_m, sample_index) FILTER (WHERE throttle >= CAST(0.05 AS DOUBLE)) AS throttle_pickup_position,
    arg_min(actual_distance_m, sample_index) FILTER (WHERE is_full_throttle) AS full_throttle_position, {_spent("is_coasting")} AS coasting_time_s,
    {_spent("is_partial_throttle")} AS partial_throttle_time_s, {_spent("is_front_lock_candidate")} AS front_lock_time_s, {_spent("is_rear_wheelspin_candidate")} AS rear_wheelspin_time_s,
    sum(greatest(rear_max, 0) * dt_s) AS rear_slip_integral, max(abs(steer)) AS max_abs_steer, count(*) FILTER (WHERE turned_over) AS steering_sign_changes, sum(walked_m) AS actual_path_length_m
  FROM walked GROUP BY session_id, lap_id, n, segment_id, segment_name, parent_segment_id, segment_start, segment_end HAVING count(*) >= 2),
p AS (
  SELECT grouped.*, is_complete AS is_complete_lap, is_valid AS is_valid_lap, CASE WHEN is_valid THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality_score, is_valid AS valid_for_comparison
  FROM grouped JOIN l USING (session_id, lap_id))"""

METRICS = (
    ("segment_time_s", "time_s"), ("entry_speed_kmh", "entry_speed_kmh"), ("minimum_speed_kmh", "minimum_speed_kmh"), ("exit_speed_kmh", "exit_speed_kmh"),
    ("brake_start_position", "brake_start"), ("full_throttle_position", "full_throttle"), ("coasting_time_s", "coasting_time_s"),
)
SESSIONS = "sess AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, CASE WHEN user_id % 4 < 3 THEN 'setup-' || (user_id % 4) END AS setup_id FROM events)"
_G = "PARTITION BY setup_id, segment_id"
STATISTICS = f"""{SESSIONS},
joined AS (SELECT p.*, setup_id FROM p LEFT JOIN sess USING (session_id)),
sized AS (SELECT *, count(*) OVER ({_G}) AS total_pass_count, count(*) FILTER (WHERE valid_for_comparison) OVER ({_G}) AS valid_pass_count FROM joined),
target AS (
  SELECT *, row_number() OVER ({_G} ORDER BY segment_time_s NULLS LAST, session_id, lap_id) AS rank, {", ".join(f"median({c}) OVER ({_G}) AS m_{p}" for c, p in METRICS)}
  FROM sized WHERE valid_for_comparison OR valid_pass_count = 0),
statistics AS (
  SELECT setup_id, segment_id, min(segment_name) AS segment_name, any_value(valid_pass_count) AS valid_pass_count, any_value(total_pass_count) AS total_pass_count,
    {", ".join(f"nullif(count({c}), 0) AS {p}_count, {_r(f'avg({c}) AS {p}_mean', f'median({c}) AS {p}_median', f'CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END AS {p}_std', f'median(abs({c} - m_{p})) AS {p}_mad', f'min({c}) AS {p}_min', f'quantile_cont({c}, 0.25) AS {p}_p25', f'quantile_cont({c}, 0.75) AS {p}_p75', f'max({c}) AS {p}_max')}" for c, p in METRICS)},
    round(avg(CASE WHEN rank <= 3 THEN segment_time_s END), 6) AS best_3_mean_time_s
  FROM target GROUP BY setup_id, segment_id)"""

PASS_ROUNDED = (
    "segment_start", "segment_end", "segment_time_s", "entry_speed_kmh", "exit_speed_kmh", "minimum_speed_kmh", "minimum_speed_position", "brake_start_position", "brake_end_position", "brake_duration_s",
    "peak_brake", "brake_impulse_proxy_s", "throttle_pickup_position", "full_throttle_position", "coasting_time_s", "partial_throttle_time_s", "front_lock_time_s", "rear_wheelspin_time_s",
    "rear_slip_integral", "max_abs_steer", "quality_score",
)
_CATEGORIES = (
    ("WING", "aero"), ("INTERNAL_GEAR", "gearing"), ("FINAL_RATIO", "gearing"), ("DIFF", "differential"), ("BRAKE", "brakes"), ("FRONT_BIAS", "brakes"), ("TRACTION_CONTROL", "driver_aids"),
    ("ABS", "driver_aids"), ("FUEL", "fuel"), ("TYRES", "tyres"), ("PRESSURE", "tyres"), ("CAMBER", "alignment"), ("TOE", "alignment"), ("ARB", "suspension"), ("SPRING", "suspension"),
    ("DAMP", "dampers"), ("BUMP_STOP", "suspension"), ("PACKER", "suspension"), ("ROD_LENGTH", "ride_height"),
)
_CATEGORY = "CASE " + " ".join(f"WHEN starts_with(upper(section), '{p}') THEN '{c}'" for p, c in _CATEGORIES) + " ELSE 'other' END"

ORACLES: dict[str, str] = {
    "lap_segments": f"WITH {RAW},{SEGMENTED} SELECT session_id, sample_index, lap_segment_index, lap_id, {_r('lap_time_s')} FROM seg",
    "dt_timestamp": f"WITH {RAW},{TIMED.replace('{source}', 'raw')} SELECT session_id, sample_index, {_r('timestamp_s', 'dt_s')} FROM timed",
    "pedal_normalize": _samples("", "gas AS throttle_raw", "brake AS brake_raw", "throttle", "brake_n"),
    "clutch_conditional_scale": f"WITH {RAW} SELECT session_id, sample_index, {_r('clutch AS clutch_raw', 'coalesce(least(greatest(CASE WHEN max(clutch) OVER (PARTITION BY session_id) > 1.5 THEN clutch / 255 ELSE clutch END, 0), 1), 0) AS clutch_n')} FROM raw",
    "speed_norm": _samples("", "speed_ms", "speed_kmh"),
    "accel_lag": _samples("", "ax AS accel_world_x_ms2", "az AS accel_world_z_ms2"),
    "long_lat_g": _samples("", "long_accel_ms2", "lat_accel_ms2", "long_g", "lat_g"),
    "yaw_unwrap": _samples("", "yaw_rad", "yaw_rate_rad_s"),
    "gear_physical": _samples("gear_raw, gear_physical"),
    "wheel_row_aggs": _samples("", "front_mean AS front_mean_slip_ratio", "rear_mean AS rear_mean_slip_ratio", "front_min AS front_slip_ratio_min", "rear_max AS rear_slip_ratio_max", _sum("load_fl", "load_fr") + " AS front_total_load", "rear_load AS rear_total_load", _sum("load_fl", "load_rl") + " AS left_total_load", _sum("load_fr", "load_rr") + " AS right_total_load"),
    "sample_flags": _samples("is_moving, is_full_throttle, is_partial_throttle, is_braking, is_coasting, is_brake_throttle_overlap, is_front_lock_candidate, is_rear_wheelspin_candidate, is_valid_sample"),
    "lap_distance": _samples("", "actual_distance_m"),
    "lap_progress": _samples("'cumulative_distance_proxy' AS progress_source, CASE WHEN progress IS NULL THEN 0.0::DOUBLE ELSE 0.55::DOUBLE END AS progress_confidence", "progress AS normalized_actual_distance", "progress"),
    "position_jumps": f"{CHAIN} SELECT 'warning' AS severity, 'POSITION_JUMP' AS code, session_id, lap_id, sample_index AS sample_start, sample_index AS sample_end, 'Position step exceeded 10 m' AS message, 'position.x,position.z' AS affected_channels FROM d WHERE step_m > 10",
    "lap_summary": _laps("source_lap_number, start_sample, end_sample, sample_count", "start_fuel", "end_fuel", "start_fuel - end_fuel AS fuel_used", "actual_distance_m", "max_speed_kmh", "mean_speed_kmh", "min_speed_kmh", "max_rpm"),
    "lap_conditional_time": _laps("", "full_throttle_time_s", "partial_throttle_time_s", "braking_time_s", "coasting_time_s", "overlap_time_s", "front_lock_time_s", "rear_wheelspin_time_s"),
    "lap_percentages": _laps("", "full_throttle_pct", "partial_throttle_pct", "braking_pct", "coasting_pct"),
    "lap_integrals": _laps("", "front_slip_integral", "rear_slip_integral", "rear_tire_stress_proxy"),
    "lap_completeness": _laps("is_complete, is_valid, is_replay_fragment", "official_lap_time_s", "lap_time_s"),
    "lap_classification": f"""{CHAIN},{LAPS},
classed AS (SELECT *, CASE WHEN is_replay_fragment THEN 'fragment' WHEN NOT is_complete THEN 'incomplete' WHEN actual_distance_m < CAST(0.9 AS DOUBLE) * typical THEN 'pit_or_error' ELSE 'unclassified_complete' END AS lap_class FROM l)
SELECT session_id, lap_id, lap_segment_index, lap_class, CASE WHEN lap_class IN ('fragment', 'incomplete') THEN 0.95::DOUBLE ELSE 0.55::DOUBLE END AS classification_confidence,
  CASE lap_class WHEN 'fragment' THEN 'replay_started_mid_lap_or_time_nonzero' WHEN 'incomplete' THEN 'no_confirmed_next_lap_transition' WHEN 'pit_or_error' THEN 'path_length_short_relative_to_session' ELSE 'complete_lap_without_semantic_pit_channel' END AS classification_reasons FROM classed""",
    "session_rollup": f"""{CHAIN},{LAPS},
frames AS (SELECT session_id, count(*) AS frame_count, max(timestamp_s) AS duration FROM d GROUP BY session_id),
counts AS (SELECT session_id, count(*) AS lap_count_total, count(*) FILTER (WHERE is_complete) AS lap_count_complete FROM l GROUP BY session_id)
SELECT session_id, frame_count, lap_count_total, lap_count_complete, {_r("duration AS session_duration_s")},
  CASE WHEN session_id::BIGINT % 5 = 0 THEN 'recording' ELSE 'recording (' || CASE WHEN session_id::BIGINT % 2 = 0 THEN 'driver ' || session_id ELSE 'car ' || session_id END || ')' END AS session_label
FROM frames JOIN counts USING (session_id)""",
    "true_runs": f"{CHAIN}, {_runs('r', 'is_braking', None)} SELECT session_id, lap_id, run_id::BIGINT AS run_id, min(sample_index) AS first_sample, max(sample_index) AS last_sample, count(*) AS n FROM r GROUP BY ALL",
    "gap_close": f"{CHAIN}, {_runs('r', 'is_braking', 0.15)} SELECT session_id, sample_index, is_braking, closed FROM r_c",
    "braking_events": f"{CHAIN}, {BRAKING} " + _event("braking", "braking", "", "entry_speed_kmh", "release_speed_kmh", "minimum_speed_kmh", "peak_brake", "mean_brake", "brake_impulse_proxy_s", "time_to_90pct_peak_s", "steer_at_start", "steer_at_release", "front_lock_time_s", "rear_wheelspin_time_s"),
    "braking_release": f"{CHAIN}, {BRAKING} SELECT {_id('lap_id', repr('braking'), 'start_sample')} AS event_id, {_r('release_duration_s', 'release_slope_per_s', 'release_monotonicity')} FROM braking",
    "throttle_events": f"{CHAIN}, {THROTTLE} " + _event("throttle_application", "throttle_e", "countersteer_proxy, throttle_lift_within_event", "start_speed_kmh", "initial_throttle", "peak_throttle", "time_to_50pct_s", "time_to_full_throttle_s", "ramp_rate_per_s", "steer_at_pickup", "steer_at_full_throttle", "yaw_rate_at_pickup_rad_s", "rear_slip_at_pickup", "rear_slip_peak", "tc_activity_proxy"),
    "gear_shifts": f"{CHAIN}, {SHIFTS} " + _event("gear_shift", "shifts", "from_gear, to_gear, direction, neutral_samples_between", "speed_before_kmh", "speed_after_kmh", "rpm_before", "rpm_after", "rpm_drop", "long_g_before", "long_g_after"),
    "lockup_events": f"{CHAIN}, {LOCKUPS} " + _event("front_lockup_candidate", "lockups", "primary_wheel", *WHEEL_COLUMNS),
    "wheelspin_events": f"{CHAIN}, {WHEELSPIN} " + _event("rear_wheelspin_candidate", "spins", "primary_wheel", *WHEEL_COLUMNS),
    "lap_event_counts": f"""{CHAIN},{LAPS}, {BRAKING}, {SHIFTS}, {LOCKUPS}, {WHEELSPIN}
SELECT session_id, lap_id, (SELECT count(*) FROM braking x WHERE x.lap_id = l.lap_id) AS braking_event_count, (SELECT count(*) FROM shifts x WHERE x.lap_id = l.lap_id) AS shift_count,
  (SELECT count(*) FROM lockups x WHERE x.lap_id = l.lap_id) AS lockup_event_count, (SELECT count(*) FROM spins x WHERE x.lap_id = l.lap_id) AS wheelspin_event_count FROM l""",
    "segment_expand": f"WITH {DEFINITIONS} SELECT segment_id, segment_name, parent_segment_id, 'actual_distance_m' AS coordinate, segment_start, segment_end FROM definitions",
    "segment_passes": f"{CHAIN},{LAPS},{PASSES} SELECT session_id, lap_id, source_lap_number, segment_id, segment_name, parent_segment_id, 'actual_distance_m' AS coordinate, sample_count, is_complete_lap, is_valid_lap, valid_for_comparison, {_r(*PASS_ROUNDED)} FROM p",
    "segment_path": f"{CHAIN},{LAPS},{PASSES} SELECT session_id, lap_id, segment_id, steering_sign_changes, {_r('actual_path_length_m')} FROM p",
    "segment_statistics": f"{CHAIN},{LAPS},{PASSES},{STATISTICS} SELECT * EXCLUDE (best_3_mean_time_s) FROM statistics",
    "segment_best3": f"{CHAIN},{LAPS},{PASSES},{STATISTICS} SELECT setup_id, segment_id, best_3_mean_time_s FROM statistics",
    "best_laps": f"{CHAIN},{LAPS} SELECT lap_id, session_id, {_r('lap_time_s')}, source_lap_number FROM l WHERE is_complete ORDER BY l.lap_time_s, session_id, lap_segment_index LIMIT 10",
    "dataset_counts": f"{CHAIN},{LAPS},{SESSIONS} SELECT (SELECT count(*) FROM sess) AS sessions, (SELECT count(DISTINCT setup_id) FROM sess) AS setups, (SELECT count(*) FROM l WHERE is_complete) AS complete_laps, (SELECT count(*) FROM l WHERE is_valid) AS valid_laps, (SELECT count(*) FROM d WHERE step_m > 10) AS flag_count, 0::BIGINT AS error_count, (SELECT count(*) FROM d WHERE step_m > 10) AS warning_count",
    "setup_category": f"SELECT p_partkey, section, {_CATEGORY} AS category FROM (SELECT p_partkey, ['wing_front', 'INTERNAL_GEAR_2', 'Diff_power', 'TYRES', 'camber_lf', 'ROD_LENGTH_RR', 'engine', 'arb_rear'][p_partkey % 8 + 1] AS section FROM part)",
    "setup_diffs": f"""WITH first_parts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1 AND p_partkey % 7 <> 0),
t AS (SELECT p_brand AS setup_id, split_part(p_type, ' ', 1) AS section, p_type AS parameter, p_size::DOUBLE AS num, p_size::VARCHAR AS txt, p_partkey AS ord FROM first_parts),
c AS (SELECT *, {_CATEGORY} AS category FROM t),
s AS (SELECT setup_id, min(ord) AS first_at FROM t GROUP BY setup_id),
pairs AS (SELECT a.setup_id AS base_setup_id, b.setup_id AS comparison_setup_id FROM s a JOIN s b ON a.first_at < b.first_at),
keys AS (SELECT DISTINCT base_setup_id, comparison_setup_id, section, parameter FROM pairs JOIN c ON setup_id IN (base_setup_id, comparison_setup_id))
SELECT base_setup_id, comparison_setup_id, k.section, k.parameter, coalesce(y.category, x.category) AS category, x.txt AS base_value, y.txt AS comparison_value,
  {_r("y.num - x.num AS absolute_numeric_change")}, coalesce(x.txt = y.txt, false) AS values_equal
FROM keys k LEFT JOIN c x ON x.setup_id = base_setup_id AND x.section = k.section AND x.parameter = k.parameter
LEFT JOIN c y ON y.setup_id = comparison_setup_id AND y.section = k.section AND y.parameter = k.parameter""",
    "merge_distinct": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 < 2 UNION SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 > 0",
    "stable_ids": f"SELECT s_suppkey, {_id(repr('race.bin'), 's_name', 's_suppkey', 'CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END')} AS session_id FROM supplier",
    "filename_datetime": r"""WITH n AS (
  SELECT c_custkey, lpad((c_custkey % 31 + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' ||
    lpad((c_custkey % 24)::VARCHAR, 2, '0') || lpad((c_custkey % 60)::VARCHAR, 2, '0') || lpad((c_custkey * 7 % 60)::VARCHAR, 2, '0') AS stamp FROM customer),
f AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'lap_' || stamp ELSE 'AC_' || stamp || '_R_car_track.rec' END AS file_name FROM n)
SELECT c_custkey, file_name, strftime(try_strptime(nullif(regexp_extract(file_name, '(?:^|_)AC_(\d{6}-\d{6})_', 1), ''), '%d%m%y-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS recorded_at FROM f""",
}
